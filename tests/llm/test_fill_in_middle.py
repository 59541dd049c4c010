"""Fill-in-the-middle against plain Python on odd texts, and the query against its SQL."""

import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from tidewell.llm.fill_in_middle import fill_in_middle, restored
from tidewell.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def expected(key, text, rate=90, spm=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    name = hashlib.sha256(f"1:{'null' if key is None else key}".encode()).hexdigest()
    h = [int(name[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_equals_plain_python(spark):
    rng = random.Random(3)
    bits = ["ab", "Z", "é", " ", "\n", "\r", " ", "\x00", "\x01", "\x02", "1", "2", "\U0001f389", "<", "P>", "<S", "한"]
    texts = [None, "", "a", "\x01", "\x02", "\x021\x01\x022", "a<P>b", "<S>", "x" * 300_000, "ab " * 100_000] + ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(2000)]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, "no key", "", ""), (5, "again", "", ""), (5, "again", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, marked string").repartition(3)
    found = fill_in_middle(docs).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    as_key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    want = sorted(((k, *expected(k, t), t or "") for k, t, *_ in rows), key=lambda x: (as_key(x)[:2], x[-1]))
    assert sorted(map(tuple, found), key=lambda x: (as_key(x)[:2], x[-1])) == want
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_parameters_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, f"one two three {i}") for i in range(200)], "doc_id long, text string")
    assert {tuple(r) for r in fill_in_middle(docs, rate=100, spm=100).collect()} == {(i, *expected(i, f"one two three {i}", 100, 100)) for i in range(200)}
    assert {r["form"] for r in fill_in_middle(docs, rate=0).collect()} == {"plain"}
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_query_equals_sql(spark):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    found = QUERIES["op11_fill_in_middle"](spark, SF)
    want = db.execute(ORACLE_SQL["op11_fill_in_middle"]).fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "Python" not in found._jdf.queryExecution().toString() and "Exchange" not in found._jdf.queryExecution().toString()
