"""Fill-in-the-middle transformation of documents, in column functions only.

A text is cut into units, runs of ASCII letters or single other characters.  The
delimiter is a control character; where the text itself holds it, it is escaped.
``regexp_replace`` puts a delimiter behind each unit (an escaped character is one
unit), their number is the number of units, and ``substring_index`` takes the parts
before, between and after two of them.  The parts are unescaped and put together
around the markers.  A row needs nothing but itself, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The delimiter, the character that escapes it and itself, and what each becomes.
MARK, ESCAPE = "\x01", "\x02"
MARK_CODE, ESCAPE_CODE = ESCAPE + "1", ESCAPE + "2"
UNIT = r"[A-Za-z]+|\x02[12]|[^A-Za-z]"
#: Fixed markers before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


def _replaced(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def _index(text: Column, mark: str, count: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(mark), count)


def marked_units(text: Column) -> Column:
    """The text, escaped, with a delimiter behind each unit."""
    escaped = _replaced(_replaced(text, ESCAPE, ESCAPE_CODE), MARK, MARK_CODE)
    return F.regexp_replace(escaped, UNIT, "$0" + MARK)


def unmarked(part: Column) -> Column:
    """A part of ``marked_units`` as it stood in the text."""
    return _replaced(_replaced(_replaced(part, MARK, ""), MARK_CODE, MARK), ESCAPE_CODE, ESCAPE)


def unit_count(marked: Column) -> Column:
    return F.octet_length(marked) - F.octet_length(_replaced(marked, MARK, ""))


def drawn(key: Column, seed: int, group: int) -> Column:
    """Group ``group`` (from 0) of eight hex digits of the SHA-256 of ``seed:key``, as a number; a null key is written null."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.sha2(name, 256), 8 * group + 1, 8), 16, 10).cast("long")


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of."""
    head, middle = _index(output, MIDDLE, F.lit(1)), _after(output, MIDDLE)
    one, other = (PREFIX, SUFFIX), (SUFFIX, PREFIX)
    first = lambda marks: F.substring(_index(head, marks[1], F.lit(1)), len(marks[0]) + 1, 2**31 - 1)
    psm = F.concat(first(one), middle, _after(head, SUFFIX))
    spm = F.concat(_after(head, PREFIX), middle, first(other))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def _after(text: Column, mark: str) -> Column:
    """What follows the only ``mark`` of ``text``."""
    return _index(text, mark, F.lit(-1))


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, rate: int = 90, spm: int = 20,
) -> DataFrame:
    """key, n (units), form, prefix_chars, middle_chars and output of each row of ``docs``.

    The cuts, and with ``rate`` percent whether the text is transformed, follow from
    a hash of the seed and the key; ``spm`` percent of those put the suffix first.
    A text that is empty or holds one of the markers stays plain, with null lengths.
    A null text counts as empty, a null key has a hash of its own, and rows that
    repeat a key are cut by the same hash, each by its own number of units.  Other
    columns, whatever their names, are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    units = rows.select("key", "text", marked_units(F.col("text")).alias("marked")).withColumn("n", unit_count(F.col("marked")))
    first, second = (F.pmod(drawn(F.col("key"), seed, g), F.col("n") + 1).cast("int") for g in (0, 1))
    holds = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        holds = holds | F.contains("text", F.lit(marker))
    plain = (F.col("n") == 0) | holds | (drawn(F.col("key"), seed, 2) % 100 >= rate)
    ranked = units.select(
        "key", "text", "marked", "n", F.least(first, second).alias("low"), F.greatest(first, second).alias("high"),
        F.when(plain, PLAIN).when(drawn(F.col("key"), seed, 3) % 100 < spm, SPM).otherwise(PSM).alias("form"),
    )
    cut = lambda part: F.when(F.col("form") != PLAIN, unmarked(part))
    middle = _index(_index(F.col("marked"), MARK, F.col("high")), MARK, F.col("low") - F.col("high"))
    parts = ranked.select(
        "key", "text", "n", "form",
        cut(_index(F.col("marked"), MARK, F.col("low"))).alias("prefix"),
        cut(middle).alias("middle"),
        cut(_index(F.col("marked"), MARK, F.col("high") - F.col("n") - 1)).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), F.col("prefix"), F.lit(SUFFIX), F.col("suffix"), F.lit(MIDDLE), F.col("middle"))
    spm_ = F.concat(F.lit(SUFFIX), F.col("suffix"), F.lit(PREFIX), F.col("prefix"), F.lit(MIDDLE), F.col("middle"))
    return parts.select(
        F.col("key").alias(key), F.col("n").cast("long").alias("n"), "form",
        F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.when(F.col("form") == PSM, psm).when(F.col("form") == SPM, spm_).otherwise(F.col("text")).alias("output"),
    )
