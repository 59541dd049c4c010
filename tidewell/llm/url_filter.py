"""URL filter: a blocked Bloom filter in front of an exact join, in DataFrame functions only.

A list of canonical URLs (a host and the start of a path) blocks what lies below
them: their host, its subdomains, and paths under the listed folder.  So a URL asks
for a few keys, each suffix of its host with each folder above its path.  Each key
picks one block of 256 bits and eight bits in it; keys whose bits are not all set
are not listed and go no further.  Possible hits are joined with the list itself,
which removes false positives.

The filter has at most ``BLOCKS`` blocks (16 MB), whatever the list, so it can go to
every task; beyond that it lets through more, and the join still decides.  What is
shuffled are possible hits, and a narrow row for each URL at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import UPPER, cut, stored

#: Most blocks of the filter, and listed URLs that a block takes while there are fewer (about 21 bits each).
BLOCKS, BLOCK_URLS = 1 << 19, 12
#: The longs of a block.
LONGS = 4
#: Keys with over this share of all possible hits (at most 10,000 by that bound), of at most so many bytes, are looked up by a broadcast.
HOT_SHARE, HOT_BYTES = 1e-4, 1024
ALLOW, BLOCK = "allow", "block"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def site_of(host: Column) -> Column:
    """A host without user, port and closing dots."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$|\.+$", "")


def canonical(url: Column) -> Column:
    """Host and path of a URL, with or without its scheme: ``example.com/a/``; a bare host gets ``/``."""
    url = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("://"), url))
    path = path_of(url)
    return F.concat(site_of(host_of(url)), F.when(path == "", "/").otherwise(path))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, host, path) that fits, as text, and its verdict; null if none does.

    A rule fits its host and all subdomains, if the path starts with its own.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    name = verdict = F.lit(None).cast("string")
    for says, at, under in reversed(ordered):
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(under))
        name, verdict = F.when(fits, at + under).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


# the filter


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    """Two bits for each long of a block, from a second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    return [bit(2 * i).bitwiseOR(bit(2 * i + 1)) for i in range(LONGS)]


def build_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """A row for each block that holds one of ``listed`` (key): block and its longs."""
    masks = _masks(F.col("key"))
    rows = listed.select(_block(F.col("key"), blocks).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(masks)))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(LONGS)))


def possible(keys: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``keys`` (key and others) whose bits are all set; at most ``BLOCKS`` rows of 40 bytes are broadcast."""
    hit = F.lit(True)
    for i, m in enumerate(_masks(F.col("key"))):
        hit = hit & (m.bitwiseAND(F.col(f"w{i}")) == m)
    return keys.withColumn("block", _block(F.col("key"), blocks)).join(F.broadcast(bloom), "block").where(hit).select(*keys.columns)


def asked_keys(rows: DataFrame, labels: int, folders: int, longest: int) -> DataFrame:
    """id and key: what may be listed of the ``host`` and ``path`` of ``rows``.

    No listed URL has more than ``labels`` labels, ``folders`` folders or ``longest``
    bytes, so keys beyond are left out.
    """
    site = site_of(F.col("host"))
    dots = F.octet_length(site) - F.octet_length(F.replace(site, F.lit("."), F.lit("")))
    hosts = F.transform(F.sequence(F.lit(1), F.least(dots + 1, F.lit(labels))), lambda i: F.call_function("substring_index", site, F.lit("."), -i))
    path = F.when(F.col("path") == "", "/").otherwise(F.col("path"))
    named = rows.where("host <> ''").select("id", path.alias("path"), F.explode(hosts).alias("suffix"))
    slashes = F.octet_length("path") - F.octet_length(F.replace(F.col("path"), F.lit("/"), F.lit("")))
    above = F.transform(F.sequence(F.lit(1), F.least(slashes, F.lit(folders))), lambda i: F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), i), F.lit("/")))
    # the path itself unless it is one of the folders
    whole = F.when(~F.endswith("path", F.lit("/")) & (F.octet_length("path") <= longest), F.array("path")).otherwise(F.array())
    keys = named.select("id", F.explode(F.transform(F.concat(above, whole), lambda p: F.concat("suffix", p))).alias("key"))
    return keys.where(F.octet_length("key") <= longest)


def listed_above(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """id and listed, the longest key of ``listed`` (key, distinct) above the URL of a row (id, host, path), if there is one.

    Keys of very many URLs are looked up once and their answer is broadcast; other
    possible hits are joined with the list by key.
    """
    folders = F.octet_length("key") - F.octet_length(F.replace(F.col("key"), F.lit("/"), F.lit("")))
    dots = F.octet_length("key") - F.octet_length(F.replace(F.col("key"), F.lit("."), F.lit("")))
    count, labels, deepest, longest = listed.agg(F.count(F.lit(1)), F.max(dots) + 1, F.max(folders), F.max(F.octet_length("key"))).first()
    blocks = max(1, min(BLOCKS, -(-count // BLOCK_URLS)))
    keys = asked_keys(rows, labels or 1, deepest or 1, longest or 0)
    hits = stored(possible(keys, build_filter(listed, blocks), blocks))
    counts = hits.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = hits.count()
    frequent = cut(counts.where((F.col("n") > total * HOT_SHARE) & (F.octet_length("key") <= HOT_BYTES)).select("key"))
    answered = F.broadcast(frequent.join(listed.select("key", F.lit(True).alias("found")), "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found")))
    met = hits.join(answered, "key", "left")
    hot = met.where("found").select("id", "key")
    rest = met.where("found is null").select("id", "key").join(listed, "key")
    return hot.unionByName(rest.select("id", "key")).groupBy("id").agg(F.max_by("key", F.struct(F.octet_length("key"), F.col("key"))).alias("listed"))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = (), key: str = "page_id", url: str = "url", entry: str = "url") -> DataFrame:
    """key, host, path, rule, listed and verdict of each row of ``pages``.

    ``rules`` is a short list of (verdict, host, path); the longest that fits decides.
    Without one, a URL at or below an entry of ``listed`` is blocked, and all others
    are allowed.  Entries (column ``entry``) may have a scheme; queries, fragments,
    users, ports and case of the host don't matter, null and empty ones list nothing,
    repeated ones count once.  An entry whose path ends in ``/`` lists all under it,
    another only that path.  ``listed`` in the result is the longest entry that fits.

    A null URL, like one without ``://``, has an empty host and path and is allowed.
    Null and repeated keys are rows like others; other columns, whatever their names,
    are ignored.  An empty table gives no rows, an empty list blocks nothing.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).select("key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = stored(rows.withColumn("id", F.monotonically_increasing_id()))
    entries = listed.select(canonical(F.col(entry)).alias("key")).where("key <> '/'").distinct()
    found = listed_above(rows, stored(entries)).withColumnRenamed("id", "of")
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    judged = rows.join(found, rows["id"] == found["of"], "left")
    verdict = F.coalesce(says, F.when(F.col("listed").isNotNull(), BLOCK).otherwise(ALLOW))
    return judged.select(F.col("key").alias(key), "host", "path", rule.alias("rule"), "listed", verdict.alias("verdict"))
