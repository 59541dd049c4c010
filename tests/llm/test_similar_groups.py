"""The pipeline's near-copy stage against brute force over five-word shingles."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from tidewell.llm import simhash


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(texts):
    """The least number in reach of each text over pairs of Jaccard 4/5, and the pairs."""
    sets = [shingle_set(t) for t in texts]
    holders, shared = {}, {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for h in holders.values():
        for pair in itertools.combinations(h, 2):
            shared[pair] = shared.get(pair, 0) + 1
    edges = [(a, b) for (a, b), n in shared.items() if 9 * n >= 4 * (len(sets[a]) + len(sets[b]))]
    empty = [i for i, s in enumerate(sets) if not s]
    root = list(range(len(texts)))
    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for a, b in edges + list(zip(empty, empty[1:])):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(len(texts))], edges


@pytest.mark.parametrize("small, sets, hot", [(32, 1024, 512), (2, 4, 12), (0, 3, 3)])
def test_stage_drops_all_pairs_of_jaccard_four_fifths(spark, monkeypatch, small, sets, hot):
    """Also where groups are compared in blocks and hashes of many sets go last."""
    for name, value in (("SMALL", small), ("SETS", sets), ("HOT", hot)):
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(11)
    texts = [None, "", "  ", "one two", "One  two", "one two three four five"]
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 250))]
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randrange(1, 6)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += ["a common line that many short texts hold in full " + " ".join(f"x{rng.randrange(50)}" for _ in range(k % 4)) for k in range(40)]
    least, edges = components(texts)
    assert len(edges) > 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"] for r in corpus_pipeline.drop_near(spark, docs, "").collect()}
    assert found == set(least)


def test_repeated_passages(spark):
    """Equal sets with other repeats are one node, and repeats don't part similar sets."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for k in range(40):
        own = [f"w{k}_{rng.randrange(9000)}" for _ in range(rng.randrange(20, 200))]
        texts.append(" ".join(own + passage))
        for times in (1, 7, 60):
            changed = list(own)
            changed[rng.randrange(len(own))] = f"new{times}"
            texts += [" ".join(changed + passage + passage * times), " ".join(own + passage * times)]
    texts += ["a b c d e f a b c d e f a b c d e f", "a b c d e f a b c d e f a b c d e f a b c d e f"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = simhash.similar_groups(docs).collect()
    least, edges = components(texts)
    assert len(found) == len(texts) and len(edges) > 300
    assert [c for _, c in sorted(map(tuple, found))] == least


def test_a_passage_in_thousands_of_texts(spark):
    """More texts than HOT share a passage; near copies among them are found, others don't link."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = []
    for k in range(4500):
        own = " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(10, 40)))
        texts.append(f"{own} {passage}" if k % 2 else f"{passage} {own}")
        if k % 50 == 0:
            texts.append(texts[-1] + f" tail{k}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = dict(map(tuple, simhash.similar_groups(docs).collect()))
    twins = [i for i, t in enumerate(texts) if " tail" in t]
    want = {i: i for i in range(len(texts))} | {i: i - 1 for i in twins}
    # texts whose own words are few are similar by the passage alone: brute force over their sets
    sets = [frozenset(map(hash, shingle_set(t))) for t in texts]
    few = [i for i in range(len(texts)) if len(sets[i]) <= 72]
    root = dict(want)
    for a, b in itertools.combinations(few, 2):
        if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
            low, high = sorted((root[a], root[b]))
            if low != high:
                root = {k: low if v == high else v for k, v in root.items()}
    assert len(twins) == 90 and len(found) == len(texts)
    assert found == root


def test_recall_on_a_whole_table(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy("doc_id").select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    found = dict(map(tuple, simhash.similar_groups(docs).collect()))
    sets = [frozenset(hash(x) for x in shingle_set(t)) for t in texts]
    # every pair that shares a hash of the exact prefix of some order: no pair of 4/5 is left out
    holders = {}
    for i, s in enumerate(sets):
        for x in sorted(s)[: len(s) - -(-4 * len(s) // 5) + 1]:
            holders.setdefault(x, []).append(i)
    pairs = {p for h in holders.values() for p in itertools.combinations(h, 2)}
    similar = [(a, b) for a, b in pairs if 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])) and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    together = sum(found[a] == found[b] for a, b in similar)
    assert len(found) == len(texts) and len(similar) > 1000
    assert together >= 0.99 * len(similar), (together, len(similar))


def test_shared_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 200, rng.integers(1, 90))) for _ in range(30)]
    for width in (7, 4096):
        found = simhash._shared_counts(sets[:12], sets[12:], width)
        assert found.tolist() == [[len(np.intersect1d(a, b)) for b in sets[12:]] for a in sets[:12]]


def test_ring_never_drops_a_pair_within_reach(spark):
    """The pigeonring principle: every pair within the reach holds a chain within its budgets."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    values = [sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 40))) for _ in range(2000)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    kept = {r["x"] for r in spark.createDataFrame([(v,) for v in signed], "x long").where(simhash.on_ring(F.col("x"), 22)).collect()}
    assert kept == {s for s, v in zip(signed, values) if v.bit_count() <= 22}
