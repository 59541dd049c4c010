"""Every operator and the pipeline on null keys, repeated rows, long texts, empty tables and clashing names."""

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import byte_bpe, exact_dedup, langid, line_dedup, mixing, secret_scan, simhash, token_files, topk, toxicity
from tidewell.llm.queries import rank_file

CLASH = ["text_", "_text", "size", "source_size", "target", "copies", "taken", "_gone", "gone", "rid", "pos", "line", "line_no", "key", "_key", "sid", "score", "fp", "digest", "whole", "lines", "_first", "of", "word", "tie", "n", "vec"]
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASH)
LONG = "lorem ipsum dolor sit amet " * 20_000 + "x" * 100_000


def table(spark):
    rows = [(1, "a b c d e", "s"), (1, "a b c d e", "s"), (1, "zzz qqq\na b c d e\nd", "t"), (None, None, None), (None, "alone here", None), (4, "", "s"), (5, LONG, "t"), (6, "A b c D e", "s")]
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA).repartition(3)


def model():
    return open(P.path("word_bpe_49k.json"), encoding="utf-8").read()


OPERATORS = {
    "secrets": lambda d: secret_scan.scan_secrets(d, secret_scan.fit_secrets(d)),
    "language": lambda d: langid.predict_languages(d, langid.fit_languages(d.select("text", F.lit("xx").alias("lang")))),
    "lines": line_dedup.line_report,
    "tokens": lambda d: token_files.read_token_files(d.sparkSession, *token_files.write_token_files(d, model())),
    "simhash": simhash.simhash_groups,
    "similar": simhash.similar_groups,
    "bpe": lambda d: byte_bpe.byte_bpe(d, rank_file(), P.PATTERN),
    "mixing": mixing.mix_plan,
    "toxicity": lambda d: toxicity.toxicity_scores(d, toxicity.fit_toxicity(d, d.select("doc_id", F.lit(0).alias("label")), F.lit(False))),
    "exact": exact_dedup.exact_dedup,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, name):
    docs = table(spark)
    assert len(OPERATORS[name](docs).collect()) == 8
    assert OPERATORS[name](docs.limit(0)).count() == 0


@pytest.mark.parametrize("run", [mixing.mix, simhash.drop_near_copies, simhash.drop_similar, line_dedup.dedup_lines])
def test_columns_stay(spark, run):
    found = run(table(spark))
    assert found.columns == table(spark).columns
    assert all(r[c] == c for r in found.collect() for c in CLASH)


def test_repeated_keys_lose_no_line(spark):
    docs = spark.createDataFrame([(1, "a b c\nd"), (1, "zzz qqq\na b c"), (None, "k l m n"), (None, "k l m n o")], "doc_id long, text string")
    found = sorted(r["text"] for r in line_dedup.dedup_lines(docs).collect())
    whole = sorted(x for t in found for x in t.split("\n") if x)
    assert "d" in whole and "zzz qqq" in whole and whole.count("a b c") == 1 and len([x for x in whole if x.startswith("k l")]) == 1


def test_vectors_with_null_keys(spark):
    data = [(None, [1.0, 2.0]), (0, [1.0, 0.0]), (0, [0.5, 0.0]), (3, [2.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in data], "vec_id long, embedding array<float>, score string")
    assert [(r["query_id"], r["vec_id"]) for r in topk.exact_top_k(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 3)]


def test_pipeline_stages_keep_columns_of_clashing_names(spark):
    sf = "/root/testdata/sf0.001"
    names = ["score", "predicted", "_scored", "whole", "body", "_kept", "key", "size", "component_id", "label"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60)
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(n), F.col("doc_id").cast("string")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, sf)
        assert found.columns == docs.columns
        rows = found.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 60


def test_pipeline_stage_by_stage(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = [r.asDict() for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, spark.createDataFrame([tuple(r.values()) for r in before], docs.schema), sf)
        rows = [r.asDict() for r in found.collect()]
        ids = sorted(r["doc_id"] for r in rows)
        if name == "byte BPE":
            ranks = byte_bpe.read_ranks(rank_file())
            own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
            assert sorted((r["doc_id"], r["n_tokens"]) for r in rows) == sorted((r["doc_id"], len(own.encode_ordinary(r["text"] or ""))) for r in before)
            break
        assert found.columns == docs.columns
        if name == "exact dedup":
            last = {}
            for r in before:
                t = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")
                last[t] = max(last.get(t, -1), r["doc_id"])
            assert ids == sorted(last.values())
        if name == "SimHash near-dedup":
            def shingles(text):
                words = (text or "").encode().lower().split()
                return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

            sets = sorted(((r["doc_id"], shingles(r["text"])) for r in before), key=lambda x: x[0])
            root = {i: i for i, _ in sets}
            for _ in sets:
                changed = False
                for a, (i, s) in enumerate(sets):
                    for j, t in sets[a + 1 :]:
                        if root[i] != root[j] and 5 * len(s & t) >= 4 * len(s | t):
                            low = min(root[i], root[j])
                            old = max(root[i], root[j])
                            root = {k: low if v == old else v for k, v in root.items()}
                            changed = True
                if not changed:
                    break
            assert ids == sorted(set(root.values()))
        if name == "mixing":
            plan = mixing.mix_plan(spark.createDataFrame([tuple(r.values()) for r in before], docs.schema)).collect()
            assert ids == sorted(r["doc_id"] for r in plan for _ in range(r["copies"]))
        before = rows
