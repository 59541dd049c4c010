"""The toxicity fit keeps expressions that its sample holds once."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import toxicity


def test_fit_counts_grams_seen_once(spark):
    texts = ["the harbour lies calm today", "calm boats lie by the harbour wall", "you utter zqwxling", "what a vile knave you are"]
    toxic = [0, 0, 1, 1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, label int")
    model = toxicity.fit_toxicity(docs, labels, F.lit(False)).words
    counts = [Counter(), Counter()]
    for text, label in zip(texts, toxic):
        counts[label].update(toxicity._grams(re.findall(r"\w+", text))[0].tolist())
    keys = np.array(sorted(counts[0] | counts[1]), np.int64)
    expected = toxicity.KneserNey.fit(keys, np.array([[c[k] for k in keys.tolist()] for c in counts], float))
    words = ["zqwxling", "harbour", "knave", "calm", "unseen"]
    assert np.allclose(model.differences(words), expected.differences(words))
    assert model.differences(["zqwxling"])[0] > 1
