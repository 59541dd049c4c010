"""Byte-level BPE by rounds over length-bucketed numpy matrices.

A batch's new pieces become rows of byte ids, padded to the length of their
bucket.  Each round looks up the rank of every adjacent pair in a hash table and
merges each row's leftmost pair of least rank; rows without a known pair leave the
matrix.  Pieces met before come from a bounded cache.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.common import HashIndex, TwoGenerations, by_chars, once, text_list

PAD = (1 << 20) - 1
NEVER = np.int32(1 << 30)
#: Pieces in each half of the cache.
CACHE = 100_000
#: Longer pieces merge by a heap: rounds take time by the square of the length.
LONG = 256
WIDTHS = (4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 128, LONG)


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and number."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


def _put(out: list, rows: np.ndarray, ids: np.ndarray) -> None:
    """Into ``out`` at each of ``rows`` the bytes of that row's ids, without the padding."""
    real = ids != PAD
    raw = ids[real].astype("<u4").tobytes()
    ends = (np.cumsum(real.sum(axis=1)) * 4).tolist()
    start = 0
    for row, end in zip(rows.tolist(), ends):
        out[row] = raw[start:end]
        start = end


LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Characters outside ASCII and Latin letters, and the separators on which libraries disagree.
BEYOND = re.compile(f"[^\\x00-\\x1b\\x20-\\x7f{LATIN[6:]}]")


def plain_pattern(pattern: str) -> re.Pattern | None:
    """The same matches on texts without BEYOND characters, for the faster ``re``; None if unsure."""
    known = pattern.replace(r"\s\p{L}\p{N}", rf"\s{LATIN}0-9").replace(r"\p{L}", f"[{LATIN}]").replace(r"\p{N}", "[0-9]")
    return None if r"\p" in known or "(?i" in known else re.compile(known)


class ByteBpe:
    """Encodes and decodes by the ranks, as ``tiktoken`` does for ordinary text."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks = read_ranks(raw)
        self.whole = {k: v.to_bytes(4, "little") for k, v in self.ranks.items()}
        self.pattern, self.plain = regex.compile(pattern), plain_pattern(pattern)
        self.token = dict((v, k) for k, v in self.ranks.items())
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {
            (self.ranks[t[:i]] << 20) | self.ranks[t[i:]]: rank
            for t, rank in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        }
        self.pairs = HashIndex(np.fromiter(pairs, dtype=np.int64, count=len(pairs)))
        self.merged = np.append(np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs)), NEVER)  # at -1: no such pair
        self.pair_rank = pairs
        self.cache = TwoGenerations(CACHE)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.merged[self.pairs.find((left.astype(np.int64) << 20) | right)]

    def _merge_rows(self, ids: np.ndarray, rows: np.ndarray, out: list) -> None:
        """Merge the padded matrix ``ids``; ``out`` gets each row's ids at its number in ``rows``."""
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        while len(ids):
            at = rank.argmin(axis=1)
            every = np.arange(len(ids))
            best = rank[every, at]
            done = best == NEVER
            if done.any():
                _put(out, rows[done], ids[done])
                ids, rank, rows, at, best = ids[~done], rank[~done], rows[~done], at[~done], best[~done]
                if not len(ids):
                    return
                every = every[: len(ids)]
            width = ids.shape[1]
            ids[every, at] = best
            # close the gap to the right of each merge
            move = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])
            ids = np.take_along_axis(ids, move, axis=1)
            if width == 2:
                _put(out, rows, ids)
                return
            rank = np.take_along_axis(rank, np.minimum(move[:, : width - 2], width - 2), axis=1)
            # only the pairs beside the merge have changed
            rank[every[at < width - 2], at[at < width - 2]] = self._rank(ids[every, at], ids[every, np.minimum(at + 1, width - 2)])[at < width - 2]
            left = at > 0
            rank[every[left], at[left] - 1] = self._rank(ids[every[left], at[left] - 1], ids[every[left], at[left]])

    def _merge_long(self, piece: bytes) -> bytes:
        """The same merges for one long piece, by a heap of (rank, position)."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        rank = lambda i: self.pair_rank.get((ids[i] << 20) | ids[after[i]]) if after[i] >= 0 else None
        heap = [(r, i) for i in range(len(ids)) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank(i) != r:
                continue
            gone = after[i]
            ids[i], ids[gone], after[i] = r, -1, after[gone]
            if after[i] >= 0:
                before[after[i]] = i
            for j in (i, before[i]):
                if j >= 0 and (new := rank(j)) is not None:
                    heapq.heappush(heap, (new, j))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        out: list = list(map(self.whole.get, pieces))
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        left = np.fromiter((x is None for x in out), bool, len(out))
        for i in np.nonzero(left & (length > LONG))[0].tolist():
            out[i] = self._merge_long(pieces[i])
        low = 0
        for width in WIDTHS:
            rows = np.nonzero(left & (length > low) & (length <= width))[0]
            low = width
            step = (1 << 18) // width
            for a in range(0, len(rows), step):
                some = rows[a : a + step]
                flat = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in some.tolist()]), np.uint8).reshape(-1, width)
                ids = np.where(np.arange(width) < length[some][:, None], self.byte_id[flat], np.int32(PAD))
                self._merge_rows(ids, some, out)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; each match of the pattern is encoded by itself."""
        matches = [(self.pattern if self.plain is None or BEYOND.search(t) else self.plain).findall(t) for t in texts]
        new = self.cache.missing(set(chain.from_iterable(matches)))
        self.cache.update(zip(new, self.encode_pieces([p.encode() for p in new])))
        return [b"".join(map(self.cache.__getitem__, m)) for m in matches]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _encoder(ranks, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = once(ByteBpe, ranks.value, pattern)
        for batch in batches:
            texts = text_list(batch.column(batch.num_columns - 1))
            for a, b in by_chars(texts):
                coded = bpe.encode(texts[a:b])
                columns = {
                    "n_tokens": pa.array([len(x) // 4 for x in coded], pa.int64()),
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in coded],
                    "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in coded],
                }
                if with_ids:
                    columns["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in coded], pa.list_(pa.int32()))
                kept = {n: batch.column(i).slice(a, b - a) for i, n in enumerate(batch.schema.names[:-1])}
                yield pa.RecordBatch.from_pydict(kept | columns)

    return run


def byte_bpe(docs: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each text and decode the ids again.

    ``ranks`` is a rank file's content (fixed by the vocabulary, so it is sent to
    the executors), ``pattern`` the regular expression whose matches are encoded
    one by one.  Returns key, n_tokens, ids_sha256, decoded_sha256 and, on request,
    ids (array of int).  Null and empty texts give no ids.  Nothing is shuffled;
    rows stay in their partition, and repeated rows are encoded each.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(_encoder(spark.sparkContext.broadcast(ranks), pattern, with_ids), schema).withColumnRenamed("key", key)


def _decoder(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = dict((v, k) for k, v in read_ranks(ranks.value).items())
        for batch in batches:
            raw = [b"".join(map(token.__getitem__, x or ())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"key": batch.column(0), "text": [x.decode("utf-8", "replace") for x in raw]})

    return run


def decode_ids(coded: DataFrame, ranks: bytes, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Texts of arrays of ids (key, text); null ids give an empty text."""
    spark: SparkSession = coded.sparkSession
    rows = coded.select(coded[key].alias("key"), coded[ids].alias("ids"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, text string"
    return rows.mapInArrow(_decoder(spark.sparkContext.broadcast(ranks)), schema).withColumnRenamed("key", key)
