"""Helpers that several corpus operators share."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidewell-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from the written rows, a column at a time."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused_name(columns: list[str]) -> str:
    """A column name that none of ``columns`` has, in whatever case."""
    taken, name = {c.lower() for c in columns}, "text_"
    while name in taken:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    """Null as empty; A-Z become a-z and nothing else changes."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text leaves remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0)) == 0


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_chars(texts, limit: int = 1_000_000):
    """Slices of a list of texts holding about ``limit`` characters, one text at least."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def text_list(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit integers (multiply and xor-shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


_MADE: dict = {}


def once(kind, *arguments):
    """``kind(*arguments)``, made once per process and kept: workers run many tasks."""
    key = (kind, *arguments)
    if key not in _MADE:
        if len(_MADE) > 8:
            _MADE.clear()
        _MADE[key] = kind(*arguments)
    return _MADE[key]


def without_collections(run):
    """``run`` without collections of cyclic garbage meanwhile: it makes many objects and no cycles."""

    @functools.wraps(run)
    def wrapped(*arguments):
        was = gc.isenabled()
        gc.disable()
        try:
            return run(*arguments)
        finally:
            if was:
                gc.enable()

    return wrapped


class TwoGenerations(dict):
    """A bounded cache: beyond ``size`` entries the older half is given up, unless met again."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.older = size, {}

    def missing(self, keys: set) -> list:
        """The keys not held, after moving those met again from the older half."""
        if len(self) > self.size:
            self.older = dict(self)
            self.clear()
        new = keys.difference(self)
        self.update((k, self.older[k]) for k in new.intersection(self.older))
        return [k for k in new if k not in self]


class HashIndex:
    """Non-negative int64 keys to their position, by open addressing in numpy arrays.

    ``find`` gives the position of each key of an array of any shape, or -1.
    """

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, dtype=np.int64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.at = np.full(1 << self.bits, -1, dtype=np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]
            won = self.keys[slot] == keys[left]
            self.at[slot[won]] = left[won]
            left, slot = left[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        flat = np.ascontiguousarray(keys, dtype=np.int64).ravel()
        slot = self._slot(flat)
        stored = self.keys[slot]
        out = np.where(stored == flat, self.at[slot], -1)
        rest = np.nonzero((stored != flat) & (stored >= 0))[0]
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            stored = self.keys[slot]
            hit = stored == flat[rest]
            out[rest[hit]] = self.at[slot[hit]]
            go = ~hit & (stored >= 0)
            rest, slot = rest[go], slot[go]
        return out.reshape(keys.shape)


def frame(**columns) -> pd.DataFrame:
    return pd.DataFrame(columns)
