"""Language identification by mixture inference.

Each language has smoothed likelihoods of hashed letter trigrams, counted on a
bounded sample of labelled documents.  A document is cut into windows of letters;
expectation-maximisation over its windows estimates the share of each language.
Starting from all languages, the least one is dropped as long as the likelihood,
less half a logarithm of the number of windows for each language, gets better.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import by_chars, cut, text_list, unused_name

BUCKETS = 1 << 15
WINDOW = 40
ROUNDS = 12
#: Labelled documents of each language that give counts, on average at most.
SAMPLE_DOCS = 3000
SMOOTH = 0.5
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """Whether each code point is a letter; made once per process."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each trigram around a letter and the number of its text.

    Texts are lower-cased; what is not a letter counts as one blank.
    """
    joined = "\n".join(texts).lower() if texts else ""
    lowered = [len(t.lower()) for t in texts]
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _is_letter()[code]
    code = np.where(letter, code, 0)
    around = np.concatenate(([0], code, [0]))
    h = (around[:-2] * 0x9E3779B1 + code * 0x85EBCA6B + around[2:] * 0xC2B2AE35) & 0x7FFFFFFF
    bucket = ((h * 0x27D4EB2F) >> 16) & (BUCKETS - 1)
    text_of = np.repeat(np.arange(len(texts)), np.array(lowered, np.int64) + 1)[: len(code)] if texts else np.zeros(0, np.int64)
    return bucket[letter], text_of[letter]


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # (BUCKETS, languages)

    def mixtures(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the languages selected for each text, and the number of its letters."""
        bucket, of = trigrams(texts)
        letters = np.bincount(of, minlength=len(texts))
        n = len(texts)
        if not len(bucket) or not self.languages:
            return np.zeros((n, len(self.languages))), letters
        place = np.arange(len(bucket)) - np.concatenate(([0], np.cumsum(letters)))[of]
        first = np.nonzero(place % WINDOW == 0)[0]
        window_of = of[first]
        fit = np.add.reduceat(self.log_p[bucket], first, axis=0).astype(np.float64)
        windows = np.bincount(window_of, minlength=n)
        least = fit.max(axis=1, keepdims=True)
        like = np.exp(np.maximum(fit - least, -700))
        base = np.bincount(window_of, least[:, 0], n)
        active = np.repeat((letters > 0)[:, None], len(self.languages), axis=1)
        share, total = self._em(like, base, window_of, windows, active)
        price = 0.5 * np.log(np.maximum(windows, 2))
        going = letters > 0
        for _ in range(len(self.languages) - 1):
            weakest = np.where(active, share, np.inf).argmin(axis=1)
            fewer = active.copy()
            fewer[np.arange(n), weakest] = False
            going &= fewer.any(axis=1)
            if not going.any():
                break
            other, value = self._em(like, base, window_of, windows, np.where(going[:, None], fewer, active))
            better = going & (value + price >= total)
            active[better], share[better], total[better] = fewer[better], other[better], value[better]
            going = better
        return share, letters

    @staticmethod
    def _em(like, base, of, windows, active):
        """Shares of the active languages and the log-likelihood, for all texts at once."""
        n, k = active.shape
        share = active / np.maximum(active.sum(axis=1, keepdims=True), 1)
        for _ in range(ROUNDS):
            part = like * share[of]
            part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
            share = np.column_stack([np.bincount(of, part[:, j], n) for j in range(k)]) / np.maximum(windows, 1)[:, None]
        return share, base + np.bincount(of, np.log(np.maximum((like * share[of]).sum(axis=1), 1e-300)), n)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        share, letters = self.mixtures(["" if t is None else t for t in texts])
        best = share.argmax(axis=1) if self.languages else np.zeros(len(texts), int)
        score = share[np.arange(len(texts)), best] if self.languages else np.zeros(len(texts))
        names = [self.languages[b] if m and self.languages else UNKNOWN for b, m in zip(best.tolist(), letters.tolist())]
        return names, np.where(letters > 0, np.clip(score, 0, 1), 0.0)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, langs = text_list(batch.column("text")), np.array(batch.column("lang").to_pylist(), object)
        names, which = np.unique(langs, return_inverse=True) if len(langs) else (np.zeros(0, object), np.zeros(0, int))
        for a, b in by_chars(texts):
            bucket, of = trigrams(texts[a:b])
            key, n = np.unique(which[a:b][of] * BUCKETS + bucket, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names[key // BUCKETS].tolist(), pa.string()), pa.array(key % BUCKETS), pa.array(n)], ["lang", "bucket", "n"])


def fit_languages(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """Fit on rows with a text and a language; others are ignored.

    About ``sample_docs`` documents of each language, picked by a hash of the text,
    give counts.  The counts that reach the driver are bounded by the number of
    languages times BUCKETS.  Without any such row every prediction is ``und``.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    # a row per language, as many as the model has columns
    sizes = F.broadcast(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("size")))
    unit = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.join(sizes, "lang").where(unit * F.col("size") < float(sample_docs)).select("text", "lang")
    counted = sample.mapInArrow(_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = cut(counted).toPandas()
    languages = sorted(table["lang"].unique().tolist(), key=lambda s: s.encode())
    counts = np.zeros((BUCKETS, len(languages)))
    if len(table):
        counts[table["bucket"].to_numpy(), [languages.index(x) for x in table["lang"]]] = table["n"]
    # rare trigrams lean on what all languages together do
    shared = (counts.sum(axis=1, keepdims=True) + SMOOTH) / (counts.sum() + SMOOTH * BUCKETS)
    p = (counts + SMOOTH * 1000 * shared) / (counts.sum(axis=0) + SMOOTH * 1000)
    return LanguageModel(languages, np.log(p).astype(np.float32))


def _predictor(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in by_chars(["" if t is None else t for t in texts]):
                names, score = model.value.predict(texts[a:b])
                kept = [c.slice(a, b - a) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def predict_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` without its text, with lang_pred and score, the language's share.

    ``und`` and 0 for texts that are null or have no letters.  Of equal shares the
    language first by code point is taken.  Whole texts are read where they are,
    without a shuffle; repeated rows are predicted each.  Columns of ``docs`` named
    lang_pred or score give way to the new ones.
    """
    rest = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    rows = docs.select(*rest, docs[text].alias(unused_name(rest)))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*rest).schema), "lang_pred string", "score double"])
    return rows.mapInArrow(_predictor(docs.sparkSession.sparkContext.broadcast(model)), schema)
