"""Kneser-Ney likelihoods and language mixtures against plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewell.llm import langid, toxicity

D, ORDER, SYMBOLS = toxicity.DISCOUNT, toxicity.ORDER, 1 << toxicity.BITS


def grams(word):
    symbols = [ord(c) % (SYMBOLS - 2) + 2 for c in word] + [1]
    padded = [0] * (ORDER - 1) + symbols
    return [tuple(padded[i : i + ORDER]) for i in range(len(symbols))]


def plain_model(words):
    """A word's toxic less ordinary log-likelihood, from lists of the words of both classes."""
    count = [Counter(g for w in some for g in grams(w)) for some in words]
    total, kinds = [defaultdict(int), defaultdict(int)], [defaultdict(int), defaultdict(int)]
    for c in (0, 1):
        for g, n in count[c].items():
            total[c][g[:-1]] += n
            kinds[c][g[:-1]] += 1
    lower, longer = {}, set(count[0]) | set(count[1])
    for length in range(ORDER - 1, 0, -1):
        ways = Counter(g[1:] for g in longer)
        mass, follow = defaultdict(int), defaultdict(int)
        for g, n in ways.items():
            mass[g[:-1]] += n
            follow[g[:-1]] += 1
        lower[length] = ways, mass, follow
        longer = set(ways)

    def difference(word):
        out = 0.0
        for g in grams(word):
            p = 1 / SYMBOLS
            for length in range(1, ORDER):
                ways, mass, follow = lower[length]
                s = g[-length:]
                m = mass[s[:-1]] if s[:-1] in mass else 0
                p = (max(ways[s] - D, 0) / m if m else 0.0) + (D * follow[s[:-1]] / m if m else 1.0) * p
            q = [(max(count[c][g] - D, 0) + D * kinds[c][g[:-1]] * p) / total[c][g[:-1]] if total[c].get(g[:-1]) else p for c in (0, 1)]
            out += math.log(q[1]) - math.log(q[0])
        return out

    return difference


def test_kneser_ney_against_plain_python():
    rng = random.Random(1)
    words = [["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(120)] + extra for extra in (["calm"] * 5 + ["once"], ["vile"] * 4 + ["rare"])]
    table = [Counter(), Counter()]
    for c in (0, 1):
        table[c].update(toxicity._grams(words[c])[0].tolist())
    keys = np.array(sorted(set(table[0]) | set(table[1])), np.int64)
    model = toxicity.KneserNey.fit(keys, np.array([[t[k] for k in keys.tolist()] for t in table], float))
    asked = ["calm", "vile", "once", "rare", "unseen", "é", "abcabcabc"] + words[0][:10] + words[1][:10]
    expected = plain_model(words)
    assert model.differences(asked) == pytest.approx([expected(w) for w in asked])


def plain_mixture(model, text):
    bucket, _ = langid.trigrams([text])
    windows = [bucket[i : i + langid.WINDOW] for i in range(0, len(bucket), langid.WINDOW)]
    fit = [[float(sum(model.log_p[b, j] for b in w)) for j in range(len(model.languages))] for w in windows]

    def em(active):
        share = {j: 1 / len(active) for j in active}
        like = [{j: math.exp(max(f[j] - max(f), -700)) for j in active} for f in fit]
        for _ in range(langid.ROUNDS):
            new = dict.fromkeys(active, 0.0)
            for row in like:
                z = max(sum(row[j] * share[j] for j in active), 1e-300)
                for j in active:
                    new[j] += row[j] * share[j] / z
            share = {j: v / len(fit) for j, v in new.items()}
        return share, sum(max(f) + math.log(max(sum(row[j] * share[j] for j in active), 1e-300)) for f, row in zip(fit, like))

    active = list(range(len(model.languages)))
    share, value = em(active)
    price = 0.5 * math.log(max(2, len(fit)))
    while len(active) > 1:
        weakest = min(active, key=lambda j: share[j])
        fewer = [j for j in active if j != weakest]
        other, less = em(fewer)
        if less + price < value:
            break
        active, share, value = fewer, other, less
    return [share.get(j, 0.0) for j in range(len(model.languages))]


def test_mixtures_against_plain_python():
    rng = random.Random(2)
    syllables = ["the ing and tion er".split(), "sch ung der ein lich".split(), "que aux ment él oir".split()]
    prose = lambda k, n: " ".join("".join(rng.choice(syllables[k]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    counts = np.zeros((langid.BUCKETS, 3))
    for k in range(3):
        np.add.at(counts[:, k], langid.trigrams([prose(k, 2000)])[0], 1)
    p = (counts + 0.1) / (counts + 0.1).sum(axis=0)
    model = langid.LanguageModel(["aa", "bb", "cc"], np.log(p).astype(np.float32))
    texts = [prose(k, n) for k in range(3) for n in (3, 40, 150)] + [prose(0, 80) + " " + prose(1, 40), prose(2, 30) + " " + prose(0, 30) + " " + prose(1, 90), "x"]
    found = model.mixtures(texts)[0]
    for t, share in zip(texts, found):
        assert share.tolist() == pytest.approx(plain_mixture(model, t), abs=1e-3)
