"""The URL filter against plain Python, and the query against its SQL."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell.llm import url_filter as U
from tidewell.llm.queries import LISTED_SITES, ORACLE_SQL, QUERIES, URL_RULES

RULES = [("allow", "com", "/"), ("block", "a.com", "/x/"), ("allow", "www.a.com", "/x/"), ("block", "net", "/e")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def site(host):
    return re.sub(r":[0-9]*$|\.+$", "", re.sub(r"^.*@", "", host))


def expected(url, entries, rules):
    host, path = split(url)
    listed = None
    if host:
        below = site(host).split(".")
        hosts = {".".join(below[-i:]) for i in range(1, min(len(below), 5) + 1)}  # no entry has more labels
        for e in entries:
            at, _, under = e.partition("/")
            under, own = "/" + under, path or "/"
            if at in hosts and (listed is None or (len(e.encode()), e) > (len(listed.encode()), listed)) and (own == under or under.endswith("/") and own.startswith(under)):
                listed = e
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits)[2:] if fits else (None, "block" if listed else "allow")
    return host, path, rule[0], listed, rule[1]


def made(n=4000, seed=4):
    rng = random.Random(seed)
    hosts = ["a.com", "www.a.com", "B.net", "x.b.net", "q.org", "deep.er.q.org", "user@q.org", "q.org:8080", "q.org.", "org", "", ".", "ünder.org", "xa.com"]
    paths = ["", "/", "/x/", "/x", "/x/y/z.html", "/e", "/en/", "//", "/x/?q=/w/", "?/x/", "#/x/", "/X/", "/é/ü"]
    return [rng.choice(["http://", "https://", "", "x://y://"]) + rng.choice(hosts) + rng.choice(paths) for _ in range(n)]


@pytest.mark.parametrize("listed", [["q.org/", "https://b.NET/x/", "q.org/x/y/z.html", "er.q.org/en/", "b.net/e", "ünder.org/é/", None, "", "q.org"], [f"h{i}.org/" for i in range(5000)] + ["org/x/"], []])
def test_equals_plain_python(spark, listed):
    odd = [None, "", "://", "no scheme", "http://" + "a." * 3000 + "q.org/" + "x/" * 3000 + "?" + "y" * 50_000, "http://q.org/" + "/" * 20_000]
    rows = [(i, u, "clash", "clash", "clash") for i, u in enumerate(odd + made())] + [(None, "http://q.org/", "", "", "")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, id string, key string, listed string").repartition(3)
    given = spark.createDataFrame([(e,) for e in listed], "url string")
    entries = {e if "/" in e else e + "/" for e in (x.replace("https://b.NET", "b.net") for x in listed if x)}
    found = sorted(map(tuple, U.judge_urls(pages, given, RULES).collect()), key=repr)
    assert found == sorted(((r[0], *expected(r[1], entries, RULES)) for r in rows), key=repr)


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert U.judge_urls(pages, spark.createDataFrame([("q.org/",)], "url string")).count() == 0


def test_the_filter_loses_nothing_and_stops_most(spark):
    listed = spark.range(20_000).select(F.concat(F.lit("in"), "id", F.lit(".org/")).alias("key"))
    others = spark.range(20_000).select(F.concat(F.lit("out"), "id", F.lit(".org/")).alias("key"))
    blocks = 20_000 // U.BLOCK_URLS
    bloom = U.build_filter(listed, blocks)
    assert U.possible(listed, bloom, blocks).count() == 20_000
    assert U.possible(others, bloom, blocks).count() < 200
    full = U.build_filter(listed, 1)  # a filter that is far too small lets all through
    assert U.possible(others, full, 1).count() == 20_000


def test_query_equals_sql_and_runs_no_python(spark):
    db = duckdb.connect()
    db.execute("create view pages as select * from '/root/testdata/sf0.1/pages.parquet'")
    found = QUERIES["op12_url_filter"](spark, "/root/testdata/sf0.1")
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted(db.execute(ORACLE_SQL["op12_url_filter"]).fetchall())
    assert {r[-1] for r in rows} == {"allow", "block"} and any(r[4] for r in rows)
    assert "Python" not in found._jdf.queryExecution().toString()
    plain = db.execute("select page_id, url from pages").fetchall()
    rules = [(v, h, p) for v, h, p in URL_RULES]
    assert rows == sorted((i, *expected(u, LISTED_SITES, rules)) for i, u in plain)
