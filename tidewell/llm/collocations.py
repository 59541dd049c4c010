"""Phrase collocations: frequent words as numbers, n-grams as fixed-width keys.

A phrase that occurs ``least`` times has no word that is rarer, so words that reach
it get numbers and all others break the pieces of a text.  Texts are encoded once,
as runs of 32-bit numbers with 0 for a break.  An n-gram is then a key of 4 n bytes,
big-endian, so keys sort as their words' numbers do.

Each task sorts its n-grams a block at a time, by radix over 16-bit digits, and
counts runs of equal keys.  Counted blocks are dealt by ranges of the key, sorted
within, and their runs summed: a key meets at most one row from each block there.
Lengths are counted from short to long, and an n-gram is only looked at if both
(n-1)-grams in it are frequent.  A bitmap of at most ``BITMAP_BITS`` bits says so to
the tasks; what it lets through wrongly is counted and falls by its count.
"""

from __future__ import annotations

from collections import ChainMap, Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import cut, mix64, shuffle_partitions, stored

#: [.,;:!?] and the line ends break pieces, tabs and blanks words; 0xFF is in no UTF-8 text.
BREAK = b"\xff"
_TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", BREAK * 10 + b" ")
#: Bytes of a text that are split at a time; distinct words that a task counts before it sends them on.
SLICE, HELD_WORDS = 1 << 20, 300_000
#: Numbers in a row of an encoded text, and n-grams that are sorted at a time.
ROW, BLOCK = 2048, 1 << 21
#: Words that go to every task: at most so many, of at most so many bytes each.  Rarer and longer ones reach their texts by a join.
HEAD_WORDS, HEAD_BYTES = 500_000, 64
BITMAP_BITS = 1 << 27


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, with ``BREAK`` between pieces, about ``SLICE`` bytes at a time."""
    data, start = text.lower().translate(_TABLE), 0
    while start < len(data):
        end = data.find(b" ", start + SLICE) if len(data) - start > SLICE else -1
        end = len(data) if end < 0 else end
        yield data[start:end].replace(BREAK, b" \xff ").split()
        start = end


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to counts (lang, word, f), one row a word and task unless it meets very many words."""
    held: dict[str, Counter] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            counts.pop(BREAK, None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), _binary(list(counts)), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "f"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = held.setdefault(lang, Counter())
            for words in tokens(text):
                counts.update(words)
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield from flushed()
                    counts = held.setdefault(lang, Counter())
    yield from flushed()


def word_counts(rows: DataFrame) -> DataFrame:
    """How often each word (its bytes) occurs in each language of ``rows`` (lang, text as bytes)."""
    return rows.mapInArrow(_word_counts, "lang string, word binary, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def numbered(words: DataFrame) -> DataFrame:
    """``words`` (lang, word, f) with id: from 1 on without gaps, by language and word.

    Rows are dealt by ranges and sorted; only the number of rows of each range goes to the driver.
    """
    parts = shuffle_partitions(words.sparkSession)
    placed = stored(words.repartitionByRange(parts, "lang", "word").sortWithinPartitions("lang", "word").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).cast("int")
    sizes = dict(placed.groupBy(part.alias("part")).count().collect())
    if sum(sizes.values()) >= 1 << 32:
        raise ValueError("over 2**32 frequent words; raise the least count")
    before, first = [], 1
    for p in range(max(sizes, default=0) + 1):
        before.append(first)
        first += sizes.get(p, 0)
    offset = F.element_at(F.array(*(F.lit(b).cast("long") for b in before)), part + 1)
    return placed.select("lang", "word", "f", (offset + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"))


# encoding


def _by_lang(table: pa.Table) -> dict[str, dict[bytes, int]]:
    found: dict[str, dict[bytes, int]] = {}
    for lang, word, number in zip(*(table[c].to_pylist() for c in ("lang", "word", "id")), strict=True):
        found.setdefault(lang, {})[word] = number
    return found


def _unresolved(head: Broadcast):
    """(lang, text, digest) to the distinct words (lang, digest, word) of each text that the head doesn't hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = head.value.get(lang, {})
                for words in tokens(text):
                    left = [w for w in set(words) if w not in known and w != BREAK]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(left), pa.string()), pa.array([digest] * len(left), pa.string()), _binary(left)], ["lang", "digest", "word"])

    return run


def _encoded(head: Broadcast):
    """(lang, text) and, if given, more words of the text with their numbers, to rows of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, rows = [], 0, []
            for lang, text, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = head.value.get(lang, {})
                if more and more[0]:
                    known = ChainMap({x["word"]: x["id"] for x in more[0]}, known)
                for words in tokens(text):
                    held.append(np.fromiter(map(known.get, words, repeat(0)), np.uint32, len(words)))
                held.append(np.zeros(1, np.uint32))
                size += len(text)
                if size > SLICE:
                    rows += _rows(np.concatenate(held))
                    held, size = [], 0
                    if len(rows) > 64:
                        yield pa.RecordBatch.from_arrays([_binary(rows)], ["ids"])
                        rows = []
            rows += _rows(np.concatenate(held)) if held else []
            yield pa.RecordBatch.from_arrays([_binary(rows)], ["ids"])

    return run


def _rows(ids: np.ndarray) -> list[bytes]:
    """Rows of about ``ROW`` numbers, cut only at breaks."""
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] > 0) | (ids[:-1] > 0)
    ids = ids[keep]
    breaks = np.nonzero(ids == 0)[0]
    cuts = np.unique(breaks[np.minimum(np.searchsorted(breaks, np.arange(ROW, len(ids), ROW)), len(breaks) - 1)]) if len(breaks) else []
    return [part.tobytes() for part in np.split(ids, cuts) if part.any()]


def encoded(rows: DataFrame, dictionary: DataFrame, head_words: int = HEAD_WORDS) -> DataFrame:
    """The texts of ``rows`` (lang, text) as rows of 32-bit numbers, 0 for a break.

    The most frequent words of the dictionary go to every task.  If it holds more,
    the other words of each distinct text are joined with it, and each text gets
    those it has.  A text's words are all that ever meets in one row.
    """
    spark, short = rows.sparkSession, dictionary.where(F.octet_length("word") <= HEAD_BYTES)
    if short.count() > head_words:
        short = short.orderBy(F.desc("f"), "id").limit(head_words)
    head_rows = short.select("lang", "word", "id").toArrow()
    head = spark.sparkContext.broadcast(_by_lang(head_rows))
    if dictionary.count() == head_rows.num_rows:
        return rows.mapInArrow(_encoded(head), "ids binary")
    marked = rows.select("lang", "text", F.sha2(F.col("text"), 256).alias("digest"))
    asked = marked.mapInArrow(_unresolved(head), "lang string, digest string, word binary").distinct()
    given = asked.join(dictionary.select("lang", "word", "id"), ["lang", "word"]).groupBy("lang", "digest").agg(F.collect_list(F.struct("word", "id")).alias("more"))
    return marked.join(given, ["lang", "digest"], "left").select("lang", "text", "more").mapInArrow(_encoded(head), "ids binary")


# counting


def _hashes(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each n-gram, given as columns of numbers."""
    found = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        found = mix64(found + c.astype(np.uint64) + np.uint64(0x9E3779B9))
    return found


def _places(columns: list[np.ndarray], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of the bitmap and the bit in it that stand for each n-gram."""
    h = _hashes(columns)
    return (h >> np.uint64(6)) & np.uint64(words - 1), h & np.uint64(63)


def _radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their columns: stable passes over 16-bit digits, from the last to the first (numpy sorts these by radix)."""
    order = np.arange(len(columns[0]))
    for c in reversed(columns):
        for shift in (0, 16):
            digit = ((c >> np.uint32(shift)) & np.uint32(0xFFFF)).astype(np.uint16)
            if digit.any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _keys(columns: list[np.ndarray]) -> pa.Array:
    return _fixed(np.ascontiguousarray(np.stack(columns, axis=1).astype(">u4")), 4 * len(columns))


def _fixed(data: np.ndarray, width: int) -> pa.Array:
    raw = data.tobytes()
    offsets = np.arange(0, len(raw) + 1, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _columns(keys: pa.Array, n: int) -> list[np.ndarray]:
    """The numbers of keys of 4 n bytes, a column for each place."""
    at = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset :]
    data = np.frombuffer(keys.buffers()[2] or b"", np.uint8)[at[0] : at[0] + 4 * n * len(keys)]
    return list(data.view(">u4").reshape(-1, n).T.astype(np.uint32))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Encoded rows, one after the other with a break between, about ``BLOCK`` numbers at a time."""
    held, size = [], 0
    for batch in batches:
        for raw in batch.column(0):
            held += [np.frombuffer(raw.as_buffer(), np.uint32), np.zeros(1, np.uint32)]
            size += len(held[-2])
            if size >= BLOCK:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _counted_blocks(n: int, shorter: Broadcast | None):
    """Encoded rows to (key, f): the n-grams of each block, sorted, and the lengths of their runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in _blocks(batches):
            places = max(0, len(ids) - n + 1)
            known = np.ones(places, bool)
            for j in range(n):
                known &= ids[j : j + places] > 0
            at = np.nonzero(known)[0]
            if shorter is not None and len(at):
                bits = shorter.value
                for start in (0, 1):
                    word, bit = _places([ids[at + start + j] for j in range(n - 1)], len(bits))
                    at = at[(bits[word] >> bit) & np.uint64(1) > 0]
            columns = [ids[at + j] for j in range(n)]
            order = _radix_order(columns)
            columns = [c[order] for c in columns]
            new = np.ones(len(at), bool)
            if len(at):
                new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
            first = np.nonzero(new)[0]
            runs = np.diff(np.append(first, len(at)))
            for s in range(0, len(first), 1 << 16):
                some = first[s : s + (1 << 16)]
                yield pa.RecordBatch.from_arrays([_keys([c[some] for c in columns]), pa.array(runs[s : s + (1 << 16)], pa.int64())], ["key", "f"])

    return run


def _summed_runs(n: int, least: int):
    """Sorted (key, f) to one row a key, with the sum of its run; keys under ``least`` go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack(_columns(batch.column(0), n), axis=1)
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
            new[0] = last is not None and (keys[0] != last).any()
            starts = np.append(0, np.nonzero(new)[0]) if not new[0] else np.nonzero(new)[0]
            sums = np.add.reduceat(batch.column(1).to_numpy(), starts)
            rows = keys[starts]
            if last is None or not new[0]:
                sums[0] += held
            else:
                rows, sums = np.concatenate([last[None], rows]), np.append(held, sums)
            last, held = rows[-1].copy(), int(sums[-1])
            done = sums[:-1] >= least
            yield pa.RecordBatch.from_arrays([_keys(list(rows[:-1][done].T)), pa.array(sums[:-1][done], pa.int64())], ["key", "f"])
        if last is not None and held >= least:
            yield pa.RecordBatch.from_arrays([_keys(list(last[None].T)), pa.array([held], pa.int64())], ["key", "f"])

    return run


def counted(ids: DataFrame, n: int, least: int, shorter: Broadcast | None) -> DataFrame:
    """(key, f) of the n-grams that occur ``least`` times."""
    blocks = stored(ids.mapInArrow(_counted_blocks(n, shorter), "key binary, f long"))
    dealt = blocks.repartitionByRange(shuffle_partitions(ids.sparkSession), "key").sortWithinPartitions("key")
    return stored(dealt.mapInArrow(_summed_runs(n, least), "key binary, f long"))


def _bits(n: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                word, bit = _places(_columns(batch.column(0), n), words)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array((np.uint64(1) << bit).view(np.int64))], ["word", "bits"])

    return run


def bitmap(grams: DataFrame, n: int) -> Broadcast:
    """Bits for the keys of ``grams``: about 16 a key, ``BITMAP_BITS`` at most (then more n-grams are counted in vain)."""
    words = 1 << 10
    need = min(16 * grams.count(), BITMAP_BITS)
    while words * 64 < need:
        words *= 2
    set_ = grams.select("key").mapInArrow(_bits(n, words), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    found = np.zeros(words, np.uint64)
    found[set_["word"].to_numpy()] = set_["bits"].to_numpy().view(np.uint64)
    return grams.sparkSession.sparkContext.broadcast(found)


# scores


def _part(key: Column, first: int, length: int) -> Column:
    """``length`` words of a key, from place ``first`` (0 is the first)."""
    return F.substring(key, 4 * first + 1, 4 * length)


def _wide(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def scored(candidates: DataFrame, grams: DataFrame, most_words: int, scale: int) -> DataFrame:
    """key, words, a and, of the cut that scores least, score, l and r.

    ``grams`` has the counts f of all keys, single words included.  Products are
    decimals, so they are exact beyond 64 bits.
    """
    cuts = [
        F.when(F.col("words") > k, F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), part.alias("part")))
        for k in range(1, most_words)
        for side, part in (("l", _part(F.col("key"), 0, k)), ("r", F.substring(F.col("key"), 4 * k + 1, 4 * most_words)))
    ]
    asked = candidates.select("key", "words", "a", F.explode(F.filter(F.array(*cuts), lambda x: x.isNotNull())).alias("x")).select("key", "words", "a", "x.*")
    met = asked.join(grams.select(F.col("key").alias("part"), "f"), "part")
    of = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}")
    wide = met.groupBy("key", "words", "a").agg(*(of(k, side) for k in range(1, most_words) for side in "lr"))
    scores = [
        F.when(F.col("words") > k, F.struct(
            F.expr(f"(cast({scale} as decimal(10,0)) * cast(a as decimal(19,0))) div (cast(l{k} as decimal(19,0)) + cast(r{k} as decimal(19,0)))").alias("score"),
            F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"),
        ))
        for k in range(1, most_words)
    ]
    best = F.array_min(F.filter(F.array(*scores), lambda x: x.isNotNull()))
    return wide.select("key", "words", "a", best.alias("best")).select("key", "words", "a", "best.score", "best.l", "best.r")


def uncovered(candidates: DataFrame, share: tuple[int, int], most_words: int) -> DataFrame:
    """Candidates (key, words, a) that lie in no longer one of at least ``share`` of their count."""
    inner = [
        F.when(F.col("words") > length, F.when(F.col("words") >= first + length, _part(F.col("key"), first, length)))
        for length in range(2, most_words)
        for first in range(most_words - length + 1)
    ]
    if not inner:
        return candidates
    within = candidates.where("words > 2").select("a", F.explode(F.filter(F.array(*inner), lambda x: x.isNotNull())).alias("inner"))
    over = within.groupBy("inner").agg(F.max("a").alias("over"))
    joined = candidates.join(over, candidates["key"] == over["inner"], "left")
    covered = _wide(F.col("over")) * share[1] >= _wide(F.col("a")) * share[0]
    return joined.where(F.col("over").isNull() | ~covered).select("key", "words", "a")


def _number(key: Column) -> Column:
    return F.conv(F.hex(key), 16, 10).cast("long")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, most_words: int = 4, top: int = 2000,
    share: tuple[int, int] = (80, 100), scale: int = 2_000_000, head_words: int = HEAD_WORDS,
) -> DataFrame:
    """The phrases of each language that hold together best: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), broken into pieces at ``.,;:!?`` and line ends and
    into words at blanks and tabs.  A phrase of 2 to ``most_words`` words counts a
    times within pieces, overlaps included; from ``least`` on it is a candidate.  A
    cut into parts that count l and r scores floor(scale * a / (l + r)); the lowest
    score stands, of equal ones that of the shortest first part.  A candidate inside
    a longer one that counts at least share[0] / share[1] as often is dropped.  The
    first ``top`` by score, a and phrase (bytes) come back; n counts all words.

    A null text counts as empty and a null language as ``und``; a language without
    candidates, like an empty table, gives no rows.  Repeated rows count each time.
    Other columns, whatever their names, are ignored.
    """
    if most_words < 2:
        raise ValueError("phrases have two words or more")
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    words = stored(word_counts(rows))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    dictionary = stored(numbered(words.where(F.col("f") >= least)))
    ids = stored(encoded(rows, dictionary, head_words))
    levels, shorter = [], None
    for n in range(2, most_words + 1):
        found = counted(ids, n, least, shorter)
        levels.append(found.select("key", F.lit(n).alias("words"), F.col("f").alias("a")))
        if n < most_words:
            shorter = bitmap(found, n)
    candidates = levels[0]
    for more in levels[1:]:
        candidates = candidates.unionByName(more)
    singles = dictionary.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("key"), "f")
    grams = singles.unionByName(candidates.select("key", F.col("a").alias("f")))
    kept = uncovered(candidates, share, most_words)
    named = scored(kept, grams, most_words, scale).withColumn("first", _number(_part(F.col("key"), 0, 1)))
    placed = named.join(dictionary.select(F.col("id").alias("first"), "lang"), "first").drop("first")
    # the best of each of many parts, then of each language; all that tie with the last of them stay
    best = (F.desc("score"), F.desc("a"))
    parted = Window.partitionBy("lang", F.pmod(F.xxhash64("key"), F.lit(shuffle_partitions(docs.sparkSession)))).orderBy(*best)
    front = placed.withColumn("at", F.rank().over(parted)).where(F.col("at") <= top)
    front = cut(front.withColumn("at", F.rank().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("at") <= top).drop("at"))
    each = front.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("words") - 1), lambda i: F.call_function("substring", "key", 4 * i + 1, F.lit(4)))))
    spelled = each.join(dictionary.select(F.col("id"), "word"), _number(F.col("col")) == F.col("id"))
    phrases = spelled.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("word").cast("string").alias("word")))).alias("spelled"))
    full = front.join(phrases.select("key", F.array_join(F.col("spelled.word"), " ").alias("phrase")), "key").join(totals, "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best, "phrase"))
    return full.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
