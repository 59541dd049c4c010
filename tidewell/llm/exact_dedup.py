"""Exact dedup through a sharded minimal perfect hash over historical digests.

The history is a set of distinct text digests.  Digests are dealt to shards by
their own leading bits, so a shard's size follows from the number of distinct
digests alone, never from how often a text is repeated.  For each shard one task
builds a minimal perfect hash: at each level the keys still unplaced are hashed
to a bit array, keys alone on their bit stay there and the rest go on; a key's
slot is the number of set bits before its own.  A slot holds the full digest, the
winner's locator and the group's size.  A lookup compares all digest bytes with
the slot's, so a digest outside the history is always recognised as such.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut, lower_ascii, mix64

GAMMA = 2.0
#: A group with more than this part of all rows is hot; so there are fewer hot groups than its inverse.
HOT_SHARE = 1e-4
INDEX_SCHEMA = "shard int, levels binary, words binary, digests binary, winner binary, copies binary"


class PerfectHash:
    """A minimal perfect hash of distinct 32-byte digests."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.bits = np.unpackbits(words, bitorder="little")
        self.before = np.concatenate(([0], np.cumsum(self.bits, dtype=np.int64)))

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = mix64(keys[:, level % 4] ^ mix64(keys[:, (level + 1) % 4] + np.uint64(level + 1)))
        return (h % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        keys, sizes, rows, level = digests.view(np.uint64), [], [], 0
        while len(keys):
            size = (max(8, int(GAMMA * len(keys))) + 7) // 8 * 8
            at = cls._at(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            rows.append(np.packbits(alone, bitorder="little"))
            keys, level = keys[~alone[at]], level + 1
        return cls(np.array(sizes, dtype=np.int64), np.concatenate(rows) if rows else np.zeros(0, np.uint8))

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest; any slot or -1 for a digest that is not a key."""
        keys, out = digests.view(np.uint64), np.full(len(digests), -1, dtype=np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + self._at(keys[left], level, int(size))
            hit = self.bits[at] == 1
            out[left[hit]] = self.before[at[hit]]
            left, base = left[~hit], base + int(size)
        return out


def _digests(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype=np.uint8).reshape(-1, 32)


def _longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<i8")


def _build_shard(table: pa.Table) -> pa.Table:
    digests = _digests(table["digest"])
    index = PerfectHash.build(digests)
    slot = index.slots(digests)
    held, winner, copies = np.empty_like(digests), np.empty(len(slot), "<i8"), np.empty(len(slot), "<i8")
    held[slot] = digests
    winner[slot] = table["winner"].to_numpy()
    copies[slot] = table["copies"].to_numpy()
    return pa.table({
        "shard": pa.array([table["shard"][0].as_py()], pa.int32()),
        "levels": [index.sizes.astype("<i8").tobytes()],
        "words": [index.words.tobytes()],
        "digests": [held.tobytes()],
        "winner": [winner.tobytes()],
        "copies": [copies.tobytes()],
    })


def _look_up_shard(index: pa.Table, asked: pa.Table) -> pa.Table:
    n = asked.num_rows
    member, slot = np.zeros(n, dtype=bool), np.full(n, -1, dtype=np.int64)
    winner, copies = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if index.num_rows and n:
        row = {k: v[0] for k, v in index.to_pydict().items()}
        table = PerfectHash(_longs(row["levels"]), np.frombuffer(row["words"], np.uint8))
        held = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        digests = _digests(asked["digest"])
        slot = table.slots(digests)
        member = (slot >= 0) & (held[slot] == digests).all(axis=1)
        slot[~member] = -1
        winner[member] = _longs(row["winner"])[slot[member]]
        copies[member] = _longs(row["copies"])[slot[member]]
    return pa.table({
        "digest": asked["digest"], "member": member, "slot": slot,
        "old_winner": pa.array(winner, mask=~member), "old_copies": pa.array(copies, mask=~member),
    })


def with_digest(docs: DataFrame, text: str = "text", digest: str = "digest") -> DataFrame:
    """Add the SHA-256 bytes of each text after lower-casing A-Z; a null text counts as empty."""
    return docs.withColumn(digest, F.unhex(F.sha2(lower_ascii(F.col(text)), 256)))


def distinct_digests(digests: DataFrame, key: str = "doc_id", digest: str = "digest") -> DataFrame:
    """One row per digest: the largest key as winner, and the number of rows.

    The aggregation combines before its shuffle, so a text that is a third of all
    rows sends one row from each task.
    """
    return digests.groupBy(digest).agg(F.max(key).alias("winner"), F.count(F.lit(1)).alias("copies"))


def shard_of(digest: Column, shards: int) -> Column:
    head = F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long")
    return (head % shards).cast("int")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The perfect-hash index of ``history`` (digest, winner, copies; digests distinct).

    One row per shard; choose ``shards`` so that a shard's digests (about 50 bytes
    each) fit a task.  Rows with a null digest are not allowed.
    """
    rows = history.select(shard_of(F.col("digest"), shards).alias("shard"), "digest", "winner", "copies")
    return rows.groupBy("shard").applyInArrow(_build_shard, INDEX_SCHEMA)


def look_up(index: DataFrame, asked: DataFrame, shards: int) -> DataFrame:
    """For each distinct digest of ``asked``: member, slot, old_winner, old_copies.

    Non-members have slot -1 and null locators.
    """
    keyed = asked.select(shard_of(F.col("digest"), shards).alias("shard"), "digest")
    schema = "digest binary, member boolean, slot long, old_winner long, old_copies long"
    return index.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInArrow(_look_up_shard, schema)


def winners(history: DataFrame, incoming: DataFrame, shards: int) -> DataFrame:
    """Winner and size of every text of ``history`` and ``incoming`` (digest, winner, copies).

    Incoming digests are looked up in the index of the history.  Members fold into
    their slot's locator and size, non-members group separately among themselves.
    Returns digest, keep_id, group_size, member (null for texts only in the history).
    """
    found = look_up(build_index(history, shards), incoming, shards)
    asked = incoming.join(found, "digest").select(
        "digest",
        F.greatest("winner", "old_winner").alias("keep_id"),
        (F.col("copies") + F.coalesce("old_copies", F.lit(0))).alias("group_size"),
        "member",
    )
    unasked = history.join(incoming.select("digest"), "digest", "left_anti").select(
        "digest", F.col("winner").alias("keep_id"), F.col("copies").alias("group_size"), F.lit(None).cast("boolean").alias("member")
    )
    return asked.unionByName(unasked)


def exact_dedup(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    is_history: Column | None = None,
    shard_keys: int = 200_000,
) -> DataFrame:
    """Every row of ``docs`` with the group of texts it belongs to.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so
    null and empty texts are one group.  Of equal texts the row with the largest
    key stays; rows that repeat that key all count as kept.  Groups that hold over
    ``HOT_SHARE`` of all rows, at most 10,000 by that bound, reach their rows by a
    broadcast, so no task takes all copies of a text.  ``is_history`` marks
    the rows that are indexed first (default: half of them, by a hash of the key);
    the result does not depend on it.  Returns key, keep_id, group_size, kept and
    the digest bytes, one row per row of ``docs``; an empty table gives no rows.
    """
    marked = F.coalesce(F.crc32(F.col(key).cast("string")) % 2 == 0, F.lit(True)) if is_history is None else F.coalesce(is_history, F.lit(False))
    rows = with_digest(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), marked.alias("old")))
    digests = cut(rows.select("doc_id", "digest", "old"))
    # one pass aggregates both parts: a row per digest and part
    parts = cut(digests.groupBy("digest", "old").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("copies")))
    distinct, total = parts.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    shards = max(8, -(-distinct // shard_keys))
    history, incoming = (parts.where(F.col("old") == old).drop("old") for old in (True, False))
    groups = cut(winners(history, incoming, shards))
    hot = F.broadcast(groups.where(F.col("group_size") > total * HOT_SHARE).where("group_size > 1"))
    rest = digests.drop("old").join(hot.select("digest"), "digest", "left_anti").join(groups, "digest")
    return (
        digests.drop("old").join(hot, "digest").unionByName(rest)
        .select(
            F.col("doc_id").alias(key), "keep_id", "group_size",
            F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "digest", "member",
        )
    )
