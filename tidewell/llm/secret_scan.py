"""Secret scan: fixed patterns, and a linear-chain conditional random field beside them.

The field tags the tokens of a line as B(egin), I(nside) or O(utside) a secret.  A
token's score sums weights of its own shape, of the words before and after it, of
whether a telling word stands shortly before it and what leads up to it, and of its
file; a matrix scores neighbouring tags; Viterbi finds the best path.

The weights are fitted on lines of the corpus whose tags come from the fixed patterns,
and on generated lines with secrets of other formats and with things that look like
secrets.  Corpus lines with a random-looking token outside the patterns are left out:
nothing says what it is.

Ordinary words make nearly all tokens.  A fixed weight holds plain shapes outside where
no telling word stands before them, and as long as even the best learned neighbours,
file and moves cannot outweigh it (``Field.plain_is_outside``), a line without telling
words and other tokens is outside throughout and needs no decoding; else every line is decoded.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut, text_list, unused_name

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
TOKEN = re.compile(r"[\w+/.\-]+=*|[^\w\s]")
#: Words that announce a secret, alone or as the end of a name, and how near before a token they count.
CUES = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "private_key", "credential", "credentials", "bearer")
REACH = 4
LONG = 20
#: Bytes that may stand in a long token, as "a"; digits alone, as "1".
_RUN = bytes(97 if c >= 128 or chr(c).isalnum() or chr(c) in "_+/=.-" else 32 for c in range(256))
_DIGIT = bytes(49 if 48 <= c < 58 else 32 for c in range(256))
HASHES, FILES, SHAPES, PLAINS, LINKS = 256, 8, 64, 6, 5
#: Bounds of a word's, a file's, a family's and a move's weight, so that shape and telling words decide.
NEIGHBOUR, FILE, FAMILY, MOVE = 0.5, 0.5, 2.0, 2.0
#: The fixed weight against a secret of a plain shape without a telling word before it.
UNTOLD = -16.0
#: Generated lines of the fit.
MADE = 1500
SAMPLE_DOCS = 8000
BEGIN, INSIDE, OUTSIDE = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in code points, by start and then kind."""
    raw = text.encode("utf-8", "surrogatepass")
    found: list[tuple[int, int, str]] = []
    low = raw.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"a" * LONG in raw.translate(_RUN):  # a run of 24 hex digits is also a run of 20 token characters
        # a match of [0-9a-f]+ is a maximal run, so asking for 24 at once drops the failing ones
        found += [(m.start(), m.end(), "hex") for m in HEX_LONG.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def shape(token: str) -> int:
    """The token's shape: 0 to 5 for plain words and symbols, by length and mixed case, else kinds of characters and length."""
    digits = sum("0" <= c <= "9" for c in token)  # the digits that _has_hot looks for
    word = token.strip("./=-_")
    if not digits and (len(token) < LONG or word.isalpha() and (word[1:].islower() or word.isupper())):
        mixed = not word[1:].islower() and not word.isupper() and len(word) > 1
        return (0 if len(token) < 6 else 1 if len(token) < 10 else 2) + 3 * mixed
    upper, lower = any(c.isupper() for c in token), any(c.islower() for c in token)
    hexed = all(c in "0123456789abcdef" for c in token)
    length = 0 if len(token) < 7 else 1 if len(token) < 12 else 2 if len(token) < LONG else 3
    return PLAINS + (bool(digits) + 2 * upper + 4 * lower) * 4 + length + 32 * (hexed and len(token) >= 12)


def _is_cue(word: str) -> bool:
    return word.encode("utf-8", "surrogatepass").lower().rstrip(b"=.").endswith(_CUE_ENDS)  # as in _has_cue, only A-Z fold


def _link(word: str | None) -> int:
    """What stands right before a token: nothing or a word, an assignment, a quote, a form of to be, another symbol."""
    if word is None or word[0].isalnum() and word[-1] != "=":
        return 3 if word is not None and word.lower() in ("is", "was", "are") else 0
    return 1 if word in (":", "=", "==") or word[-1] == "=" else 2 if word in "\"'`" else 4


def family(token: str) -> int:
    """What several shapes share: the length, and whether kinds of characters mix."""
    n = len(token)
    kinds = any(c.isdigit() for c in token) + any(c.isupper() for c in token) + any(c.islower() for c in token)
    return (0 if n < 12 else 1 if n < LONG else 2 if n < 32 else 3) + 4 * (kinds > 1)


def _hash(word: str) -> int:
    return hashlib.blake2b(word.lower().encode("utf-8", "surrogatepass"), digest_size=2).digest()[0] % HASHES


def file_bucket(text: str) -> int:
    """Features of the whole file: whether it names keys, how much of it is digits, how many lines."""
    raw = text.encode("utf-8", "surrogatepass")
    named = any(k in raw.lower() for k in KEYWORDS)
    dense = raw.translate(_DIGIT).count(b"1") * 50 > max(1, len(raw))
    return named + 2 * dense + 4 * (raw.count(b"\n") >= 10)


def line_features(line: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int, int]]]:
    """Token spans of a line, and shape, family, word before, word after and what leads up to each."""
    spans, words = [], []
    for m in TOKEN.finditer(line):
        spans.append(m.span())
        words.append(m.group())
    hashes = [HASHES, *map(_hash, words), HASHES]  # the last weight: no neighbour
    cues = [_is_cue(w) for w in words]
    told = [LINKS * any(cues[max(0, i - REACH) : i]) + _link(words[i - 1] if i else None) for i in range(len(words))]
    shapes = [min(shape(w), SHAPES + PLAINS) for w in words]
    told = [2 * LINKS if x < PLAINS and t < LINKS else t for x, t in zip(shapes, told)]
    return spans, [(shapes[i], family(w), hashes[i], hashes[i + 2], told[i]) for i, w in enumerate(words)]


def _has_hot(raw: bytes) -> bool:
    return b"1" in raw.translate(_DIGIT) or b"a" * LONG in raw.translate(_RUN)


_CUE_ENDS = tuple(c.encode() for c in CUES)
_CUE_BYTES = tuple({c.encode() for c in CUES if not any(o != c and o in c for o in CUES)})


def _has_cue(raw: bytes) -> bool:
    low = raw.lower()
    return any(c in low for c in _CUE_BYTES)


@dataclass
class Field:
    """Weights: own shape, family, word before, word after, what leads up, file (each x 3 tags) and tag to tag."""

    own: np.ndarray
    family: np.ndarray
    before: np.ndarray
    after: np.ndarray
    told: np.ndarray
    file: np.ndarray
    move: np.ndarray

    @classmethod
    def empty(cls) -> Field:
        field = cls(*(np.zeros((n, 3)) for n in (SHAPES + PLAINS + 1, 8, HASHES + 1, HASHES + 1, 2 * LINKS + 1, FILES, 3)))
        field.told[-1] = UNTOLD, UNTOLD, 0.0
        return field

    def emission(self, features: np.ndarray) -> np.ndarray:
        """Scores of (..., 6) feature numbers: own, family, before, after, told, file."""
        return sum(w[features[..., j]] for j, w in enumerate(self.tables))

    @property
    def tables(self) -> tuple[np.ndarray, ...]:
        return self.own, self.family, self.before, self.after, self.told, self.file

    @property
    def plain_is_outside(self) -> bool:
        """No path through plain tokens without a telling word can beat outside."""
        gain = lambda w: (w[..., :2].max(axis=-1) - w[..., 2]).max()
        moves = self.move[:, :].max() - self.move[OUTSIDE, OUTSIDE]
        return float(gain(self.own[:PLAINS]) + gain(self.family) + gain(self.before) + gain(self.after) + gain(self.told[-1:]) + gain(self.file) + 2 * max(0.0, moves)) <= 0

    def viterbi(self, emission: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Best tags of padded chains (n, steps, 3); an I never follows an O or starts a chain."""
        n, steps, _ = emission.shape
        move = self.move.copy()
        move[OUTSIDE, INSIDE] = -np.inf
        score = emission[:, 0].copy()
        score[:, INSIDE] = -np.inf
        back = np.zeros((n, steps, 3), np.int8)
        kept = score.copy()
        for t in range(1, steps):
            options = score[:, :, None] + move
            back[:, t] = options.argmax(axis=1)
            score = options.max(axis=1) + emission[:, t]
            kept = np.where((length > t)[:, None], score, kept)
        tags = np.full((n, steps), OUTSIDE, np.int8)
        now, rows = kept.argmax(axis=1), np.arange(n)
        for t in range(steps - 1, -1, -1):
            live = length > t
            tags[live, t] = now[live]
            if t:
                now = np.where(live, back[rows, t, now], now)
        return tags


def _chains(texts: list[str], field: Field) -> list[list[tuple[int, int]]]:
    """Spans that the field tags in each text."""
    every, out = not field.plain_is_outside, [[] for _ in texts]
    todo = []
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        cued = _has_cue(raw)
        if not every and not cued and not _has_hot(raw):
            continue
        bucket, at = file_bucket(text), 0
        for line in text.split("\n"):
            raw = line.encode("utf-8", "surrogatepass")
            if line and (every or cued and _has_cue(raw) or _has_hot(raw)):
                spans, features = line_features(line)
                if spans:
                    todo.append((len(spans), i, at, spans, np.array([(*f, bucket) for f in features])))
            at += len(line) + 1
    todo.sort(key=lambda x: x[0])
    a = 0
    while a < len(todo):
        b = a
        # lines of about one length, and at most a million padded tokens at once
        while b < len(todo) and todo[b][0] <= 2 * todo[a][0] and (b - a + 1) * todo[b][0] <= 1 << 20 or b == a:
            b += 1
        some, width = todo[a:b], todo[b - 1][0]
        length = np.array([x[0] for x in some])
        features = np.zeros((len(some), width, 6), np.int64)
        for row, x in enumerate(some):
            features[row, : x[0]] = x[4]
        tags = field.viterbi(field.emission(features), length)
        for row in np.nonzero((tags != OUTSIDE).any(axis=1))[0]:
            _, i, at, spans, _ = some[row]
            line_tags = tags[row, : len(spans)].tolist()
            start = None
            for t, tag in enumerate([*line_tags, OUTSIDE]):
                if start is not None and tag != INSIDE:
                    out[i].append((at + spans[start][0], at + spans[t - 1][1]))
                    start = None
                if tag == BEGIN:
                    start = t
        a = b
    return out


def scan(texts: list[str], field: Field) -> list[list[tuple[int, int, str]]]:
    """All spans of each text: those of the patterns, and the field's that touch none of them."""
    out = []
    for text, tagged in zip(texts, _chains(texts, field)):
        base = base_spans(text)
        more = [(a, b, "crf") for a, b in tagged if not any(a < e and s < b for s, e, _ in base)]
        out.append(sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))))
    return out


# fitting


def _random_looking(token: str) -> bool:
    kinds = any(c.isdigit() for c in token) + any(c.isupper() for c in token) + any(c.islower() for c in token)
    return len(token) >= 12 and kinds > 1 and any(c.isdigit() for c in token)


def _line_chains(line: str, values: list[tuple[int, int]], bucket: int, doubtful: bool) -> Iterator[tuple[list, list]]:
    """(features, tags) of stretches around the tokens of a line that are not plain; ``values`` are its secrets."""
    spans, features = line_features(line)
    inside = [next((v for v in values if v[0] < e and s < v[1]), None) for s, e in spans]
    tags = [OUTSIDE if v is None else INSIDE if i and inside[i - 1] == v else BEGIN for i, v in enumerate(inside)]
    last = -1
    for i in [i for i, f in enumerate(features) if f[0] >= PLAINS or tags[i] != OUTSIDE or LINKS <= f[4] < 2 * LINKS] or [0]:
        if i > last:
            a, last = max(0, i - 8), i + 8
            part = tags[a : last + 1]
            unsure = any(t == OUTSIDE and _random_looking(line[x:y]) for t, (x, y) in zip(part, spans[a : last + 1]))
            if part and not (doubtful and unsure):
                yield [(*f, bucket) for f in features[a : last + 1]], [BEGIN, *part[1:]] if part[0] == INSIDE else part


def training_chains(text: str) -> list[tuple[list, list]]:
    """(features, tags) of the lines with a token that is not plain or a telling word, and of one plain line.

    Long lines give a stretch of tokens around each such token.  Stretches with a
    random-looking token that no pattern takes are left out.
    """
    base, bucket, at, out, plain = base_spans(text), file_bucket(text), 0, [], 1
    values = [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if base else []
    values += [(a, b) for a, b, k in base if k != "assign"]
    for line in text.split("\n"):
        raw = line.encode("utf-8", "surrogatepass")
        hot = _has_hot(raw) or _has_cue(raw)
        if line.strip() and (hot or plain):
            plain -= not hot
            out += _line_chains(line, [(a - at, b - at) for a, b in values if a < at + len(line) and b > at], bucket, True)
        at += len(line) + 1
    return out


def made_chains(n: int = MADE, seed: int = 7) -> list[tuple[list, list]]:
    """Chains of generated lines: secrets of many formats, announced or not, and things that only look like them."""
    rng, out = random.Random(seed), []
    letters, alnum = string.ascii_letters, string.ascii_letters + string.digits
    some = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    word = lambda: some("abcdefghijklmnoprstuvwy", 2, 9)
    prose = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))

    def lengthy() -> str:  # issued keys: long, digits and both cases mixed, often behind a prefix
        x = some(alnum, 18, 42) + some(string.digits, 2, 2)
        x = "".join(rng.sample(x, len(x)))
        return rng.choice(["", "", some(letters.lower(), 2, 4) + "_", some(letters.lower(), 2, 4) + "-", some(letters.lower(), 2, 3) + "_" + some(letters.lower(), 3, 5) + "_"]) + x

    def chosen() -> str:  # chosen passwords: shorter, anything
        x = rng.choice([word().title() + some(string.digits, 1, 4), word() + some(string.digits, 1, 4) + word(), some(alnum, 8, 16), word() + word(), word() + "-" + word() + "-" + word(), some(letters, 8, 14)])
        return x if len(x) >= 6 else x + some(string.digits, 4, 4)

    digits = lambda a, b: some(string.digits, a, b)
    alike = [
        lambda: str(uuid.UUID(int=rng.getrandbits(128))), lambda: f"20{digits(2, 2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", lambda: f"{rng.randint(1, 250)}.{digits(1, 2)}.{digits(1, 2)}.{digits(1, 2)}",
        lambda: digits(1, 12), lambda: f"{word()}.{digits(1, 3)}@{word()}{digits(1, 1)}.example.com", lambda: f"https://{word()}.example.com/{word()}/{digits(1, 6)}", lambda: f"v{digits(1, 1)}.{digits(1, 2)}.{digits(1, 2)}",
        lambda: f"+{digits(2, 2)}-{digits(3, 3)}-{digits(7, 7)}", lambda: f"{word()}{digits(1, 3)}", lambda: f"{digits(1, 2)}:{digits(2, 2)}", lambda: f"${digits(1, 4)}.{digits(2, 2)}", lambda: f"{some(letters.upper(), 1, 3)}-{digits(2, 5)}", lambda: f"{word()}_{word()}_{digits(1, 2)}.txt",
    ]
    for number in range(n):
        lead, tail, cue = prose(0, 6), prose(0, 5), rng.choice(CUES)
        cue = rng.choice([cue, cue.upper(), cue.title(), word() + "_" + cue])
        pick = number % 6
        if pick < 2:
            secret, before = (lengthy() if rng.random() < 0.4 else chosen()), cue + rng.choice(["=", ": ", " = ", " is ", ":", " was ", ": '", "='", ' = "', " is: "])
        elif pick == 2:
            secret, before = lengthy(), rng.choice(["", "", word() + " ", word() + ": ", word() + "=", '"'])
        elif pick == 3:  # telling words that tell nothing
            secret, before = "", rng.choice([cue, "the " + cue, cue + " " + word(), cue + "s " + word() + ", " + word()])
        else:
            secret, before = "", " ".join(rng.choice([word, rng.choice(alike)])() for _ in range(rng.randint(2, 8)))
        line = f"{lead} {before}".lstrip()
        at = len(line)
        line += secret + rng.choice(["", ".", ",", "'", ""]) * bool(secret) + " " + tail
        out += _line_chains(line, [(at, at + len(secret))] if secret else [], rng.randrange(FILES), False)
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit_field(chains: list[tuple[list, list]], rounds: int = 100, rate: float = 0.5, ridge: float = 1e-3) -> Field:
    """Weights by adaptive gradient steps on the chains' conditional log-likelihood.

    Word, family, file and move weights stay within their bounds; shapes and telling words are free, but for UNTOLD.
    """
    field = Field.empty()
    chains = [c for c in chains if c[1]]
    if not any(t != OUTSIDE for _, tags in chains for t in tags):
        field.own[:, OUTSIDE] = 100.0  # nothing to learn from: all outside
        return field
    n, width = len(chains), max(len(t) for _, t in chains)
    features, tags = np.zeros((n, width, 6), np.int64), np.full((n, width), OUTSIDE)
    length = np.array([len(t) for _, t in chains])
    for i, (f, t) in enumerate(chains):
        features[i, : len(t)], tags[i, : len(t)] = f, t
    real = np.arange(width) < length[:, None]
    gold = np.eye(3)[tags] * real[..., None]
    pairs = (gold[:, :-1, :, None] * gold[:, 1:, None, :]).sum(axis=(0, 1))
    tables = field.tables
    past = [np.full(w.shape, 1e-8) for w in (*tables, field.move)]
    for _ in range(rounds):
        e = field.emission(features)
        forward, backward = np.zeros((n, width, 3)), np.zeros((n, width, 3))
        forward[:, 0] = e[:, 0]
        for t in range(1, width):
            forward[:, t] = np.where(real[:, t, None], _log_sum(forward[:, t - 1, :, None] + field.move, 1) + e[:, t], forward[:, t - 1])
        for t in range(width - 2, -1, -1):
            backward[:, t] = np.where(real[:, t + 1, None], _log_sum(field.move + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2), 0.0)
        whole = _log_sum(forward[:, -1], 1)
        tag_p = np.exp(forward + backward - whole[:, None, None]) * real[..., None]
        pair_p = np.exp(forward[:, :-1, :, None] + field.move + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - whole[:, None, None, None]) * real[:, 1:, None, None]
        off = (gold - tag_p).reshape(-1, 3)
        slopes = [np.column_stack([np.bincount(features[..., j].ravel(), off[:, k], len(w)) for k in range(3)]) for j, w in enumerate(tables)]
        slopes.append(pairs - pair_p.sum(axis=(0, 1)))
        for w, g, p in zip((*tables, field.move), slopes, past):
            g = g - ridge * n * w * 0.01
            p += g * g
            w += rate * g / np.sqrt(p)
        for w, most in ((field.family, FAMILY), (field.before, NEIGHBOUR), (field.after, NEIGHBOUR), (field.file, FILE), (field.move, MOVE)):
            np.clip(w, -most, most, out=w)
        field.told[-1] = UNTOLD, UNTOLD, 0.0
    return field


def _chain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [c for t in text_list(batch.column(0)) for c in training_chains(t)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([np.array(f, np.int32).ravel() for f, _ in found], pa.list_(pa.int32())), pa.array([t for _, t in found], pa.list_(pa.int32()))], ["features", "tags"]
        )


def fit_secrets(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS, most_chains: int = 2500) -> Field:
    """Fit on about ``sample_docs`` documents picked by a hash of their text.

    Equal texts and equal stretches count once.  At most ``most_chains`` stretches of
    17 tokens at most reach the driver, half of them with a secret where there are as
    many; the generated ones come beside them.
    """
    rows = docs.select(F.col(text).alias("text"))
    share = min(1.0, sample_docs / max(1, rows.count()))
    unit = F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit(2)), F.lit(1 << 20)) / float(1 << 20)
    chains = cut(rows.where(unit < share).distinct().mapInArrow(_chain_rows, "features array<int>, tags array<int>").distinct())
    order, marked = F.xxhash64("features", "tags"), F.array_min("tags") != OUTSIDE
    some = [r for which in (marked, ~marked) for r in chains.where(which).orderBy(order).limit(most_chains // 2).collect()]
    return fit_field([(np.array(r["features"]).reshape(-1, 6).tolist(), list(r["tags"])) for r in some] + made_chains())


SPANS = "array<struct<start:int,end:int,kind:string>>"


def _scanner(field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            found = scan(text_list(batch.column(batch.num_columns - 1)), field.value)
            spans = [[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, kind)], [*batch.schema.names[:-1], "spans"])

    return run


def scan_secrets(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` without its text, with spans: array of (start, end, kind) by start, then kind.

    Offsets count code points, ends are exclusive; kinds are assign, access, hex and
    crf.  Null and empty texts have no spans.  Whole texts are read where they are,
    without a shuffle; repeated rows are scanned each.  A column of ``docs`` named
    spans gives way to the new one.
    """
    rest = [c for c in docs.columns if c not in (text, "spans")]
    rows = docs.select(*rest, docs[text].alias(unused_name(rest)))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*rest).schema), f"spans {SPANS}"])
    return rows.mapInArrow(_scanner(docs.sparkSession.sparkContext.broadcast(field)), schema)
