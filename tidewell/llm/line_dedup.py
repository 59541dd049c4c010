"""Line dedup by an exact set-similarity join, in DataFrame operations alone.

A line is the set of its words.  Words are put in one order for all lines, rarest
first: the buckets of their hash are counted over the whole table and give each word
a frequency class; within a class the hash settles the order.  A word's 64-bit sort
key stands for the word until pairs are verified.
Two sets of n and m words with Jaccard similarity of num/den or more share at least
``need`` = num (n + m) / (num + den) words, so

- the rarest n - ceil(num n / den) + 1 words of each share one (prefix filter);
- from a shared word at places i and j on, enough are left: min(n - i, m - j) >= need
  (positional filter), which also bounds the lengths (length filter);
- at most n + m - 2 need words are in one set alone, and the 64-bit parity sketches of
  the two sets differ in no more bits than that; long sets have sketches of 128 bits as well.

What passes is verified on the full sets of words.  A line goes if an earlier line,
by (document, line number), is that similar, whether or not that line stays itself.

Lines of one set are one row of the join.  Where many sets share a word, each is
first held against the first of them and the two before it, which settles most
members of a large group of near copies by a number of pairs that grows with the
lines alone; only lines not settled so meet all earlier ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.storagelevel import StorageLevel

from tidewell.llm.common import UPPER, cut, shuffle_partitions, stored

BLANKS = "\t\x0b\x0c\r"
#: Blanks, and what ``lower`` may change besides A-Z: letters with a lower form, and those that a newer Unicode may give one.
ODD = r"[\p{IsUppercase}\p{Lt}\p{Cn}\x09\x0B\x0C\x0D&&[^A-Z]]"
#: Words are counted in 2 ** BITS buckets of their hash.
BITS = 17
#: Sets of more words than this have two further sketches of 64 bits, since one alone fills up.
LONG = 90
#: Sets that hold one of more rare words than this are first held against a few others of that word.
HOT = 256
POSTING = ("sid", "at", "b", "b2", "b3")
#: Rows of one or two longs that are sent to every task; beyond this the rows are shuffled to them.
BROADCAST_ROWS = 400_000


def _plain(line: Column) -> Column:
    """A-Z lower-cased and blanks made spaces; lines in which ``lower`` changes nothing else go a shorter way."""
    simple = F.octet_length(line) == F.length(line)
    for c in BLANKS:
        simple = simple & ~F.contains(line, F.lit(c))
    simple = simple | ~F.regexp_like(line, F.lit(ODD))
    return F.when(simple, F.lower(line)).otherwise(F.translate(line, UPPER + BLANKS, UPPER.lower() + " " * len(BLANKS)))


def _numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``rows`` (key, text, ...) with ``rid``; rid and text of each document once; the bits that a line number takes.

    ``rid`` is a number of its own for each document, null keys first and otherwise in
    the order of the keys.  Keys that are whole numbers, differ and span few enough
    bits give it themselves; else the distinct pairs of a key and its text's hash are
    ranged and numbered, so repeated keys with different texts are documents apart.
    """
    spark, whole = rows.sparkSession, isinstance(rows.schema["key"].dataType, IntegralType)
    low, high, widest = rows.agg(*((F.min("key"), F.max("key")) if whole else (F.lit(None), F.lit(None))), F.max(F.octet_length("text"))).first()
    bits = max(1, int(widest or 1).bit_length())
    if whole and (int(high or 0) - int(low or 0) + 2).bit_length() + bits <= 62 and rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        own = rows.withColumn("rid", F.coalesce(F.col("key").cast("long") - F.lit(int(low or 0)) + 1, F.lit(0)))
        return own, own.select("rid", "text"), bits
    tied = rows.withColumn("tie", F.xxhash64("text"))
    ranged = tied.select("key", "tie").distinct().repartitionByRange(shuffle_partitions(spark), "key", "tie").sortWithinPartitions("key", "tie")
    placed = cut(ranged.select(F.col("key").alias("k"), F.col("tie").alias("t"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    # a row per partition: the prefix sum over them stays small however many documents there are
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select(F.col("part"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ids = placed.join(F.broadcast(base), "part").select("k", "t", (F.col("at") + F.col("base")).alias("rid"))
    own = tied.join(ids, F.col("key").eqNullSafe(F.col("k")) & (F.col("tie") == F.col("t"))).drop("tie", "k", "t")
    return own, stored(own.select("rid", "text").dropDuplicates(["rid"])), bits


def _lines(rows: DataFrame, bits: int) -> DataFrame:
    """pos (rid and line number from 0) and line of each line that holds a word."""
    each = rows.select("rid", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.btrim("line", F.lit(BLANKS + " ")) != "")
    return each.select(F.shiftleft("rid", bits).bitwiseOR(F.col("line_no").cast("long")).alias("pos"), _plain(F.col("line")).alias("line"))


def _bucket(word: Column) -> Column:
    return F.shiftrightunsigned(F.hash(word), 32 - BITS)


def _classes(rows: DataFrame) -> Column:
    """Each bucket's frequency class, 0 (rare) to 31, in a key's upper bits: 2 ** BITS numbers however large the table.

    The classes only order the words, so ``lower`` will do here for letters other than A-Z.
    """
    lines = rows.select(F.explode(F.split("text", "\n")).alias("line"))
    words = lines.select(F.explode(F.split(F.lower("line"), " ")).alias("word"))
    counted = cut(words.groupBy(_bucket(F.col("word")).alias("bucket")).agg(F.count(F.lit(1)).alias("n")))
    usual = (counted.agg(F.sum("n")).first()[0] or 0) / (1 << BITS) + 1
    rank = F.greatest(F.lit(0), F.least(F.lit(31), F.lit(8) + F.round(F.log2((F.col("n") + 1) / F.lit(usual)) * 2))).cast("int")
    least = max(0, min(31, 8 + round(2 * math.log2(1 / usual))))
    found = counted.where(rank != least).agg(F.collect_list("bucket"), F.collect_list(rank)).first()
    table = [least] * (1 << BITS)
    for bucket, c in zip(*found):
        table[bucket] = c
    return F.split(F.lit(",".join(str(c << 56) for c in table)), ",").cast("array<bigint>")  # folded to one constant


def _keys(line: Column, classes: Column) -> Column:
    """The sorted sort keys of a line's distinct words; each stands for its word."""

    def key(w: Column) -> Column:
        # never null, which lets the array be sorted as plain numbers
        return F.coalesce(F.get(classes, _bucket(w)), F.lit(0).cast("long")).bitwiseOR(F.shiftrightunsigned(F.xxhash64(w), 8))

    return F.sort_array(F.array_remove(F.array_distinct(F.transform(F.split(line, " "), key)), key(F.lit(""))))


def _sketch(keys: Column, shift: int, part: int | None = None) -> Column:
    """Parities of how many keys have each value of the six bits from ``shift`` on; ``part``: of the keys with this lowest bit only."""

    def add(a: Column, k: Column) -> Column:
        with_k = a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(k, shift).bitwiseAND(F.lit(63)).cast("int")))
        return with_k if part is None else F.when(k.bitwiseAND(F.lit(1)) == part, with_k).otherwise(a)

    return F.aggregate(keys, F.lit(0).cast("long"), add)


def _close(e, num: int, den: int) -> Column:
    """Whether a posting (sid, at, b, b2, b3) and an earlier one, whose columns ``e`` gives by these names, pass the positional, length and sketch filters."""
    (n, i), (m, j) = _split(F.col("at")), _split(e("at"))
    need = F.floor(((n + m) * num + num + den - 1) / F.lit(num + den))
    apart = lambda b: F.bit_count(F.col(b).bitwiseXOR(e(b)))
    near = (e("sid") < F.col("sid")) & (F.least(n - i, m - j) >= need) & (apart("b") <= n + m - 2 * need)
    return near & ((n <= LONG) | (m <= LONG) | (apart("b2") + apart("b3") <= n + m - 2 * need))


def _small(df: DataFrame) -> DataFrame:
    """``df``, which was written before, marked to be sent to every task if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _verified(pairs: DataFrame, rows: DataFrame, bits: int, num: int, den: int) -> DataFrame:
    """The later ``sid`` of the pairs (sid, e, apart) that really are similar; words are read again for their lines only.

    Each set is first held against the earlier one whose sketch is the least apart, and
    only those that this does not settle against the others.
    """
    pairs = stored(pairs.distinct())
    used = cut(pairs.select("sid").unionByName(pairs.select(F.col("e").alias("sid"))).distinct())
    documents = cut(used.select(F.shiftright("sid", bits).alias("rid")).distinct())
    lines = _lines(rows.select("rid", "text").join(_small(documents), "rid", "left_semi"), bits)
    found = stored(lines.join(_small(used), lines["pos"] == used["sid"], "left_semi"))
    nearest = pairs.groupBy("sid").agg(F.min(F.struct("apart", "e")).alias("best")).select("sid", F.col("best.e").alias("e"))
    settled = cut(_alike(nearest, found, num, den))
    left = pairs.select("sid", "e").join(_small(settled), "sid", "left_anti").join(nearest, ["sid", "e"], "left_anti")
    return cut(settled.unionByName(_alike(left, found, num, den).distinct()))


def _alike(pairs: DataFrame, found: DataFrame, num: int, den: int) -> DataFrame:
    """The ``sid`` of the pairs (sid, e) whose lines in ``found`` are similar."""
    # lines travel as text, which is far smaller than arrays of their words
    later, earlier = (found.select(F.col("pos").alias(at), F.col("line").alias(x)) for at, x in (("sid", "line"), ("e", "e_line")))
    words = {x: F.array_distinct(F.array_remove(F.split(x, " "), "")) for x in ("line", "e_line")}
    # hashes of words tell most pairs apart; the words themselves are held against each other for the rest
    hashes = {x: F.array_distinct(F.transform(F.array_remove(F.split(x, " "), ""), lambda w: F.xxhash64(w))) for x in words}
    enough = lambda w: F.size(F.array_intersect(*w.values())) * (num + den) >= num * (F.size(w["line"]) + F.size(w["e_line"]))
    both = pairs.join(later, "sid").join(earlier, "e").select("sid", F.when(enough(hashes), enough(words)).otherwise(False).alias("similar"))
    # written before they are chosen from, else the filter would work the words out once more
    return cut(both).where("similar").select("sid")


def _gone(rows: DataFrame, bits: int, num: int, den: int) -> DataFrame:
    """rid and line_no of each line of ``rows`` (rid, text) that an earlier one matches by num/den or more."""
    spark, classes = rows.sparkSession, _classes(rows)
    keyed = _lines(rows, bits).select("pos", _keys(F.col("line"), classes).alias("keys"))
    n = F.size("keys")
    prefix = F.slice("keys", 1, n - F.floor((n * num + den - 1) / F.lit(den)).cast("int") + 1)
    wide = {f"b{p + 2}": F.when(n > LONG, _sketch(F.col("keys"), 1, p)).otherwise(F.lit(0).cast("long")) for p in (0, 1)}
    tokens = F.transform(prefix, lambda k: k.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    placed = stored(keyed.select("pos", F.xxhash64("keys").alias("s"), n.alias("n"), _sketch(F.col("keys"), 0).alias("b"), *(x.alias(c) for c, x in wide.items()), tokens.alias("tokens")))
    # one row per set, known by the hash of its keys, its size and its sketch, and named by its first position;
    # a set below this size has no partner but itself
    sets = placed.where(F.col("n") * den >= num * (F.col("n") + 1)).groupBy("s", "n", "b", "b2", "b3", "tokens").agg(F.min("pos").alias("sid"))
    postings = sets.select("sid", "n", "b", "b2", "b3", F.posexplode("tokens").alias("i", "token"))
    size = F.shiftleft(F.least("i", F.lit(1 << 20)).cast("long"), 32).bitwiseOR(F.col("n").cast("long"))
    dealt = postings.select("token", "sid", "b", "b2", "b3", size.alias("at")).repartition(shuffle_partitions(spark), "token").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        similar = _similar(dealt, rows, bits, num, den)
    finally:
        dealt.unpersist()
    firsts = placed.groupBy("s", "n", "b").agg(F.min("pos").alias("sid"), F.count(F.lit(1)).alias("copies"))
    judged = firsts.join(similar.withColumn("gone", F.lit(True)), "sid", "left").where("copies > 1 or gone")
    named = placed.select("pos", "s", "n", "b").join(judged, ["s", "n", "b"]).where("gone or pos <> sid")
    return named.select(F.shiftright("pos", bits).alias("rid"), F.col("pos").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("line_no"))


def _split(at: Column) -> tuple[Column, Column]:
    return at.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftright(at, 32)


def _similar(dealt: DataFrame, rows: DataFrame, bits: int, num: int, den: int) -> DataFrame:
    """The ``sid`` of each set that an earlier set is similar to."""
    hot = cut(dealt.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT).select("token"))
    if hot.isEmpty():
        return _verified(_near(dealt, dealt, num, den), rows, bits, num, den)
    # words that are not hot keep their place; only the postings of hot ones travel again
    hot = _small(hot)
    crowded = dealt.join(hot, "token", "left_semi")
    settled = _verified(_first_pairs(crowded, num, den), rows, bits, num, den)
    known = _small(settled)
    cold = dealt.join(hot, "token", "left_anti")
    pairs = _near(cold, cold, num, den).unionByName(_near(crowded.join(known, "sid", "left_anti"), crowded, num, den))
    return cut(settled.unionByName(_verified(pairs.join(known, "sid", "left_anti"), rows, bits, num, den)))


def _first_pairs(crowded: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (sid, e, apart) of each set with the first of those that share a word and with the two before it."""
    order = Window.partitionBy("token").orderBy("sid")
    row = F.struct(*POSTING)
    some = crowded.withColumns({"first": F.first(row).over(order), "last": F.lag(row, 1).over(order), "last2": F.lag(row, 2).over(order)})
    # held against each other before they become rows, so rows are no more than the pairs that pass
    passed = [F.when(_close(lambda c, x=x: F.col(x)[c], num, den), F.struct(F.col(x)["sid"].alias("e"), F.bit_count(F.col("b").bitwiseXOR(F.col(x)["b"])).alias("apart"))) for x in ("first", "last", "last2")]
    return some.select("sid", F.inline(F.array_compact(F.array(*passed))))


def _near(later: DataFrame, earlier: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (sid, e, apart) of two tables' postings of one word that pass the filters."""
    other = earlier.select(*(F.col(c).alias(f"e_{c}") for c in ("token", *POSTING)))
    both = later.join(other, (F.col("token") == F.col("e_token")) & _close(lambda c: F.col(f"e_{c}"), num, den))
    return both.select("sid", F.col("e_sid").alias("e"), F.bit_count(F.col("b").bitwiseXOR(F.col("e_b"))).alias("apart"))


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", num: int = 4, den: int = 5) -> DataFrame:
    """key, line_no (from 0) of each line that an earlier line matches by num/den or more.

    Words are maximal runs without ASCII blanks, A-Z lower-cased; a line's repeated
    words count once.  Lines without words never go.  Of lines with equal sets all
    but the first go.  Null texts have no lines; null keys sort before others.  Rows
    that repeat a key and text are one document; rows that repeat a key with another
    text are documents of their own, in the order of a hash of the text.  An empty
    table gives no rows.
    """
    rows, once, bits = _numbered(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    gone = _gone(once, bits, num, den)
    return gone.join(rows.select("rid", "key").distinct(), "rid").select(F.col("key").alias(key), "line_no")


def line_report(docs: DataFrame, key: str = "doc_id", text: str = "text", num: int = 4, den: int = 5) -> DataFrame:
    """key, n_lines, n_removed and removed_lines (array of line numbers) of each row of ``docs``."""
    rows, once, bits = _numbered(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    gone = _gone(once, bits, num, den).groupBy("rid").agg(F.sort_array(F.collect_list("line_no")).alias("lines"))
    newlines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    counted = rows.select("rid", "key", F.coalesce(newlines, F.lit(0)).cast("long").alias("n_lines"))
    removed = F.coalesce("lines", F.array().cast("array<int>"))
    return counted.join(gone, "rid", "left").select(F.col("key").alias(key), "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed_lines"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` with the removed lines cut out of the text; columns unchanged, a null text stays null."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    rows, once, bits = _numbered(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), whole))
    gone = _gone(once, bits, num, den).groupBy("rid").agg(F.collect_set("line_no").alias("lines"))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("lines"), i))
    shorter = F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return rows.join(gone, "rid", "left").select(*(shorter.alias(c) if c == text else F.col("whole")[c].alias(c) for c in docs.columns))
