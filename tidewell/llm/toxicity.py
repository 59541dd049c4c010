"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Each class has its own counts of n-grams of letters (the n-1 letters before as the
context, words padded at both ends).  Their discounted mass backs off to one chain
of Kneser-Ney continuation counts shared by both classes, so an expression that is
rare in both gets nearly equal likelihoods and only what a class uses more often
tells.  A document is judged by the length-normalised difference of its toxic and
ordinary log-likelihood, with the largest differences of single words beside it;
logistic weights for these are fitted on a fold that gave no counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import HashIndex, TwoGenerations, cut, text_list, unused_name

ORDER = 6
DISCOUNT = 0.75
#: Labelled documents of each class that give counts, and that give the weights, on average at most.
COUNT_DOCS, WEIGHT_DOCS = 5000, 3000
BITS = 10
CACHE = 100_000
LETTERS = re.compile(r"[^\W\d_]+")
TOP = 3


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-gram key of each letter and word end of each word, and the word's number.

    A letter takes 10 bits, its code point modulo 1022 plus 2; 0 pads the start, 1 ends the word.
    """
    raw = np.frombuffer("\n".join(words).encode("utf-32-le", "replace") + "\n".encode("utf-32-le"), np.uint32).astype(np.int64)
    ends = raw == 10
    number = np.cumsum(ends) - ends
    code = np.where(ends, 1, raw % ((1 << BITS) - 2) + 2)
    starts = np.concatenate(([0], np.nonzero(ends)[0][:-1] + 1))
    place = np.arange(len(code)) - starts[number]
    key = code.copy()
    for back in range(1, ORDER):
        earlier = np.zeros_like(code)
        earlier[back:] = code[:-back]
        key |= np.where(place >= back, earlier, 0) << (BITS * back)
    return key, number


def _suffix(keys: np.ndarray, length: int) -> np.ndarray:
    return keys & ((1 << (BITS * length)) - 1)


@dataclass
class KneserNey:
    """Two class models over one shared back-off chain; arrays end with the value for unseen keys."""

    grams: HashIndex
    counts: np.ndarray  # (2, grams + 1): ordinary, toxic
    contexts: HashIndex
    totals: np.ndarray  # (2, contexts + 1)
    kinds: np.ndarray  # (2, contexts + 1): distinct letters that follow
    lower: list  # per order 1 .. ORDER - 1: (grams, share, contexts, left over)

    @classmethod
    def fit(cls, keys: np.ndarray, counts: np.ndarray) -> KneserNey:
        """From distinct ORDER-gram keys and their (2, n) counts."""
        pad = lambda a: np.concatenate((a, np.zeros(a.shape[:-1] + (1,))), axis=-1)
        context, at = np.unique(keys >> BITS, return_inverse=True)
        totals = np.array([np.bincount(at, c, len(context)) for c in counts])
        kinds = np.array([np.bincount(at, c > 0, len(context)) for c in counts])
        lower, longer = [], np.unique(keys)
        for length in range(ORDER - 1, 0, -1):
            # how many distinct letters stand before each shorter gram
            gram, ways = np.unique(_suffix(longer, length), return_counts=True)
            ctx, of = np.unique(gram >> BITS, return_inverse=True)
            total, kind = np.bincount(of, ways), np.bincount(of)
            share = np.maximum(ways - DISCOUNT, 0) / total[of]
            left = np.append(DISCOUNT * kind / total, 1.0)
            lower.append((HashIndex(gram), np.append(share, 0.0), HashIndex(ctx), left))
            longer = gram
        return cls(HashIndex(keys), pad(counts), HashIndex(context), pad(totals), pad(kinds), lower[::-1])

    def differences(self, words: list[str]) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of each word."""
        keys, number = _grams(words)
        p = np.full(len(keys), 1.0 / (1 << BITS))
        for length, (grams, share, contexts, left) in enumerate(self.lower, start=1):
            gram = _suffix(keys, length)
            p = share[grams.find(gram)] + left[contexts.find(gram >> BITS)] * p
        at, ctx = self.grams.find(keys), self.contexts.find(keys >> BITS)
        logs = []
        for c in (0, 1):
            total = self.totals[c][ctx]
            seen = total > 0
            q = (np.maximum(self.counts[c][at] - DISCOUNT, 0) + DISCOUNT * self.kinds[c][ctx] * p) / np.where(seen, total, 1.0)
            logs.append(np.log(np.where(seen, q, p)))
        return np.bincount(number, logs[1] - logs[0], len(words))


class ChunkScores:
    """The difference of each chunk between blanks, from a bounded cache."""

    def __init__(self, model: KneserNey):
        self.model, self.held = model, TwoGenerations(CACHE)

    def learn(self, chunks: set[str]) -> None:
        """Score the chunks that are not held yet."""
        new = self.held.missing(chunks)
        words, of = [], []
        for i, c in enumerate(new):
            found = LETTERS.findall(c)
            words += found
            of += [i] * len(found)
        if words:
            score = np.bincount(of, self.model.differences(words), len(new))
        else:
            score = np.zeros(len(new))
        self.held.update(zip(new, score.tolist()))


def features(model_scores: ChunkScores, texts: list[str]) -> np.ndarray:
    """(texts, TOP + 2): normalised difference, largest word differences, log length."""
    out = np.zeros((len(texts), TOP + 2))
    for a in range(0, len(texts), 256):
        chunks = [t.lower().split() for t in texts[a : a + 256]]
        model_scores.learn(set().union(*chunks))
        for i, words in enumerate(chunks, start=a):
            if words:
                s = np.fromiter(map(model_scores.held.__getitem__, words), float, len(words))
                top = -np.sort(-(np.partition(s, len(s) - TOP)[-TOP:] if len(s) > TOP else s))
                out[i, 0] = s.mean()
                out[i, 1 : 1 + len(top)] = top
                out[i, -1] = np.log1p(len(words))
    return out


@dataclass
class ToxicityModel:
    words: KneserNey
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    @cached_property
    def scores(self) -> ChunkScores:
        """One cache for all tasks of a process."""
        return ChunkScores(self.words)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.spread) @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Intercept and weights by Newton steps."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").to_pylist()
        keys, number = _grams(words)
        n = np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in ("ordinary", "toxic")], float)
        key, at = np.unique(keys, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(np.bincount(at, c[number], len(key)).astype(np.int64)) for c in n)], ["key", "ordinary", "toxic"])


def _feature_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = ChunkScores(model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(features(scores, text_list(batch.column(0)))), pa.list_(pa.float64()))], ["label", "x"])

    return run


def _sample(labels: DataFrame, key: str, label: str, weigh: Column, count_docs: int, weight_docs: int) -> tuple[DataFrame, dict]:
    """key, label and weigh of the picked labels, and the number of labels of each class."""
    named = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label).cast("int")).alias("label"))
    rows = named.withColumn("weigh", weigh)
    sizes = {(r["weigh"], r["label"]): r["n"] for r in rows.groupBy("weigh", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(1.0)
    for (w, c), n in sizes.items():
        share = F.when((F.col("weigh") == w) & (F.col("label") == c), min(1.0, (weight_docs if w else count_docs) / n)).otherwise(share)
    unit = F.pmod(F.xxhash64("_key", F.lit(1)), F.lit(1 << 20)) / float(1 << 20)
    return rows.where(unit < share), {c: sum(n for (_, k), n in sizes.items() if k == c) for c in (0, 1)}


def fit_toxicity(docs: DataFrame, labels: DataFrame, weigh: Column, key: str = "doc_id", text: str = "text", label: str = "label", count_docs: int = COUNT_DOCS, weight_docs: int = WEIGHT_DOCS) -> ToxicityModel:
    """Fit on the documents that ``labels`` calls 0 or 1 (other labels, null included, are ignored).

    Of each class about ``count_docs`` documents, picked by a hash of their key,
    give the n-gram counts and ``weight_docs`` others the logistic weights; ``weigh``,
    over the column ``_key``, says which labels may be among the latter.  So the
    picked keys, which are sent to every task in place of moving any text, the
    model and what reaches the driver are bounded.  A key labelled both ways counts
    as 1.  With one class only, every score is its rate; without labels it is 0.
    """
    spark = docs.sparkSession
    picked, known = _sample(labels, key, label, weigh, count_docs, weight_docs)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(cut(picked)), "_key")
    sample = cut(rows.select("text", "label", "weigh"))
    words = sample.where("not weigh").select("label", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(0))).alias("word"))
    counted = words.groupBy("word").agg(F.sum(1 - F.col("label")).alias("ordinary"), F.sum("label").alias("toxic"))
    grams = counted.mapInArrow(_gram_counts, "key long, ordinary long, toxic long").groupBy("key").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    table = grams.toPandas().sort_values("key")  # all of them: the back-off mass comes largely from grams seen once
    if table.empty:
        table = table.reindex([0]).fillna(0)
    words_model = KneserNey.fit(table["key"].to_numpy(np.int64), table[["ordinary", "toxic"]].to_numpy(float).T)
    held = sample.where("weigh").select("text", "label").mapInArrow(_feature_rows(spark.sparkContext.broadcast(words_model)), "label int, x array<double>").toPandas()
    x, y = (np.array(held["x"].tolist()), held["label"].to_numpy(float)) if len(held) else (np.zeros((0, TOP + 2)), np.zeros(0))
    mean, spread, weights = np.zeros(TOP + 2), np.ones(TOP + 2), np.zeros(TOP + 3)
    if len(set(y.tolist())) == 2:
        mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        weights = fit_logistic((x - mean) / spread, y)
        # the sample's class shares are not the table's
        weights[0] += np.log(known[1] / max(1, known[0])) - np.log(max(1, y.sum()) / max(1, len(y) - y.sum()))
    else:
        weights[0] = 30.0 if known[1] and not known[0] else -30.0
    return ToxicityModel(words_model, mean, spread, weights)


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = model.value.scores
        for batch in batches:
            score = model.value.score(features(scores, text_list(batch.column(batch.num_columns - 1))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], [*batch.schema.names[:-1], "score"])

    return run


def toxicity_scores(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` without its text, with score (0 to 1) and predicted (1 from 0.5 on).

    Whole texts are scored where they are, without a shuffle.  Null and empty texts
    get the score of a document without words; repeated rows are scored each.
    Columns of ``docs`` named score or predicted give way to the new ones.
    """
    rest = [c for c in docs.columns if c not in (text, "score", "predicted")]
    rows = docs.select(*rest, docs[text].alias(unused_name(rest)))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*rest).schema), "score double"])
    scored = rows.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model)), schema)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
