"""Operator 2: toxicity behind a noisy channel.

Writers hide words by leetspeak, spacing and repetition.  The text seen is the
output of a channel; the operator restores the likeliest input and scores that.

1. Language model: trigrams of letters over *all* documents, counted by one
   pass whose partial tables have a fixed size (``K**3`` cells).
2. Lexicon: words and word beginnings that mark toxic documents, from labelled
   rows that are not held out.  At most about ``SAMPLE`` labelled rows, chosen
   by hash, are used for fitting (lexicon and the two weights of the score);
   all counts over that sample are distributed.
3. Lattice: a written token becomes a lattice (letters as they are, look-alike
   signs as each letter they stand for, separators and repeated letters
   possibly dropped, runs of single letters joined).  Viterbi decoding under
   the language model gives the restored word.  Tokens whose look-alike
   skeleton, with any of its signs dropped, begins like no lexicon entry are
   not decoded, as no path through their lattice can reach an entry: this
   changes no score.  Tokens of stars only are no words.  A run of single
   letters is read as one word, and so is each part of it that the lattice can
   read as an entry, whatever its length: for each entry and each end (of more
   than three repeats of a letter the first two and the last) the shortest
   such part, and that one with all repeats of its first letter.
4. Score: a logistic function of the strongest entry found and of the number
   of different ones, fitted on the sample.

Labels are joined for fitting only; labels, lang, source and doc_id are no
inputs of a score.  Every text is read whole, each row by itself.

Defined results: null and empty texts score like any text without an entry; a
null doc_id is not held out and not used for fitting; without labels of both
kinds all texts get the (smoothed) share of toxic labels; repeated rows stay;
an empty table gives no rows; ``score`` ignores other columns, ``reject`` keeps
them, whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.memory import claim
from vellum.llm.scratch import Scratch, fresh

#: Labelled rows used for fitting, about.
SAMPLE = 20_000
HELD_OUT = 5
PREFIXES = (4, 5, 6, 7)
LEAST_DOCS = 3
#: Tokens whose weights a worker keeps.
MEMO_ENTRIES = 400_000
#: Characters that are counted in one call, about.
JOINED = 1 << 20

# Letters of the model: 0 is a word's edge, then a-z, then U+00DF to U+00FF, then any other.
K = 26 + 33 + 2
_INDEX = np.full(0x250, 0, np.int64)
_INDEX[ord("a") : ord("z") + 1] = np.arange(1, 27)
_INDEX[0xDF:0x100] = np.arange(27, 60)
_INDEX[0x100:0x250] = K - 1
_INDEX[0xF7] = 0

#: Letters that a sign may stand for. Fixed values of the channel.
LOOKS = {
    "0": "o", "1": "il", "!": "il", "|": "il", "3": "e", "€": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "+": "t",
    "8": "b", "6": "g", "9": "g", "2": "z", "(": "c", "<": "c", "#": "h", "*": "aeiou",
}
#: Costs in nats.
SWAP, DROP, DROP_SIGN, REPEAT, ACCENT = 0.3, 0.3, 2.5, 0.8, 0.6
SEPARATORS = frozenset(" .-_*~'`^/\\·•,:;=+")

_SKELETON = {ord(k): v[0] for k, v in LOOKS.items() if k != "*"} | {ord("l"): "i"}
_TWICE = re.compile(r"(.)\1+")
_NOT_LETTERS = re.compile(r"[^a-zß-öø-ÿĀ-ɏ]+")
_SIGNS = re.compile("[" + re.escape("".join(LOOKS)) + "]")
_BETWEEN = r"\s" + re.escape("".join(sorted(SEPARATORS - {" "})))
_SPACED = re.compile(rf"(?<![^{_BETWEEN}])[^{_BETWEEN}](?:[{_BETWEEN}]{{1,3}}[^{_BETWEEN}]){{2,}}(?![^{_BETWEEN}])")
_GAPS = re.compile(rf"[{_BETWEEN}]+")
_EDGES = ".,;:!?\"'()[]{}%&#$*…«»<>"


def index(text: str) -> np.ndarray:
    cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    return np.where(cp < 0x250, _INDEX[np.minimum(cp, 0x24F)], 0)


def trigrams(text: str) -> np.ndarray:
    """Codes (before, letter before, letter) of a text; what stands before a word's edge is forgotten."""
    i = np.concatenate([[0, 0], index(text), [0]])
    a, b, c = i[:-2], i[1:-1], i[2:]
    code = (np.where(b == 0, 0, a) * K + b) * K + c
    return code[(b != 0) | (c != 0)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(K**3, np.int64)
    for batch in batches:
        held: list[str] = []
        size = 0
        for text in [*batch.column("text"), None]:  # a line feed between texts is a word's edge like their ends
            if text is not None:
                held.append(text.as_py())
                size += len(held[-1])
            if held and (text is None or size > JOINED):
                total += np.bincount(trigrams("\n".join(held)), minlength=K**3)
                held, size = [], 0
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])


def language_model(texts: DataFrame, scratch: Scratch) -> np.ndarray:
    """-log P(letter | two before), from all rows of ``texts(text)``."""
    table = np.zeros(K**3)
    # as many rows as the table has cells, whatever the corpus
    for r in scratch.write(texts.mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "trigrams").collect():
        table[r["code"]] = r["n"]
    cube = table.reshape(K, K, K)
    one = cube.sum(axis=(0, 1)) + 0.5
    two = cube.sum(axis=0)
    p1 = one / one.sum()
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    p3 = (cube + 5 * p2[None]) / (cube.sum(axis=2, keepdims=True) + 5)
    return -np.log(p3).astype(np.float32)


def _bare(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))


_BARE = {i: _bare(chr(i)) for i in range(0x80, 0x250)}
_BARE_SKELETON = {i: c.translate(_SKELETON) for i, c in _BARE.items()} | _SKELETON


def fold(word: str) -> str:
    """Letters without their accents."""
    return word if word.isascii() else "".join([c if c < "\u0250" else _bare(c) for c in word.translate(_BARE)])


def skeleton(token: str) -> str:
    return _TWICE.sub(r"\1", _NOT_LETTERS.sub("", fold(token).translate(_SKELETON) if max(token, default="") >= "\u0250" else token.translate(_BARE_SKELETON)))


def features(word: str) -> list[str]:
    """``word$`` and its beginnings."""
    n = len(word)
    return [word + "$", *[word[:k] for k in PREFIXES if n >= k]]


def decode(token: str, cost: np.ndarray) -> str:
    """The likeliest word behind ``token`` (lower case): Viterbi over (last two letters, last sign)."""
    states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
    for c in token:
        steps: list[tuple[str, float]] = []  # emitted letter or "", cost
        letter = c.isalpha()
        if letter:
            steps.append((c, 0.0))
            plain = fold(c)
            if plain != c and len(plain) == 1:
                steps.append((plain, ACCENT))
        for x in LOOKS.get(c, ""):
            steps.append((x, SWAP + (1.0 if c == "*" else 0.0)))
        if not letter:
            steps.append(("", DROP if c in SEPARATORS else DROP_SIGN))
        new: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
        for (a, b, last), (s, word) in states.items():
            options = steps + ([("", REPEAT)] if letter and (last == c or last == fold(c)) else [])
            for x, extra in options:
                if x:
                    i = int(_INDEX[ord(x)]) if ord(x) < 0x250 else K - 1
                    key, value = (b, i, x), (s + extra + float(cost[a, b, i]), (word, x))
                else:
                    key, value = (a, b, last), (s + extra, word)
                if key not in new or value[0] < new[key][0]:
                    new[key] = value
        states = new
    ends = [(s + float(cost[a, b, 0]), word) for (a, b, _), (s, word) in states.items()]
    least = min(s for s, _ in ends)
    return min(_letters(word) for s, word in ends if s == least)


def _letters(word: tuple | None) -> str:
    out = []
    while word:
        word, x = word
        out.append(x)
    return "".join(reversed(out))


@dataclass
class Model:
    """Fitted parameters; pure data, safe to send to workers."""

    cost: np.ndarray
    lexicon: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    share: float | None = None  # set if there is nothing to learn from
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self):
        # skeletons of entries: whole words, and beginnings by length
        self.whole = {skeleton(f[:-1]) for f in self.lexicon if f[-1] == "$"}
        starts = {skeleton(f) for f in self.lexicon if f[-1] != "$"}
        self.starts = {n: {s for s in starts if len(s) == n} for n in {len(s) for s in starts}}
        # a tree of both: next nodes by letter, each node's last letter, nodes that end a word or a beginning
        self.next: list[dict[str, int]] = [{}]
        self.last = [""]
        self.ends: tuple[set[int], set[int]] = (set(), set())
        for words, ends in zip((self.whole, starts), self.ends, strict=True):
            for word in words:
                at = 0
                for c in word:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        self.last.append(c)
                    at = self.next[at][c]
                ends.add(at)

    def entry(self, word: str) -> tuple[float, str]:
        """Weight and name of the strongest entry that ``word`` matches."""
        found = [(self.lexicon[f], f) for f in features(word) if f in self.lexicon]
        return max(found) if found else (0.0, "")

    def _reaches(self, s: str) -> bool:
        if s in self.whole:
            return True
        for n, part in self.starts.items():
            if s[:n] in part:
                return True
        return False

    def _dropping(self, token: str, begin: bool = True) -> bool:
        """Whether an entry's skeleton can be read in ``token`` (or begin it) if any sign may be dropped; a star is any letter."""
        whole, starts = self.ends
        at = {0}
        for c in token:
            new = set() if c.isalpha() else set(at)
            if c == "*":
                new.update(n for k in at for n in self.next[k].values())
            else:
                to = at
                for x in skeleton(c):
                    to = {k if self.last[k] == x else self.next[k].get(x) for k in to} - {None}
                new |= to
            if not new:
                return False
            if begin and not new.isdisjoint(starts):
                return True
            at = new
        return not at.isdisjoint(whole)

    def weigh(self, token: str) -> tuple[float, str]:
        """Best entry in a written token, restored if need be."""
        core = token.strip(_EDGES)
        best = self.entry(core) if core.isalpha() else max((self.entry(p) for p in _NOT_LETTERS.split(core) if p), default=(0.0, ""))
        if best[0] or not self.lexicon:
            return best
        for form in dict.fromkeys((core, token, token.rstrip(_EDGES), token.lstrip(_EDGES))):
            signs = form.strip("*") and _SIGNS.search(form)
            if len(form) > 2 and (not form.isalpha() or _TWICE.search(form) or not form.isascii()) and (self._reaches(skeleton(form)) or signs and self._dropping(form)):
                best = max(best, self.entry(decode(form, self.cost)))
        return best

    def _spelt(self, letters: list[str]) -> Iterator[tuple[int, int]]:
        """Parts that can be read as a whole entry, by one walk over the run: each node of the tree knows the latest letter that leads to it."""
        at: dict[int, int] = {}
        read = [skeleton(c) for c in letters]
        for j, c in enumerate(letters):
            inner = 1 < j < len(letters) - 1 and read[j - 2] == read[j - 1] == read[j] == read[j + 1]
            new = {} if c.isalpha() else dict(at)
            to = {**at, 0: j}
            if c == "*":
                to = {n: max(b for k, b in to.items() if n in self.next[k].values()) for n in {n for k in to for n in self.next[k].values()}}
            else:
                for x in read[j]:
                    step: dict[int, int] = {}
                    for k, b in to.items():
                        n = k if self.last[k] == x else self.next[k].get(x)
                        if n is not None and step.get(n, -1) < b:
                            step[n] = b
                    to = step
                if not read[j]:
                    to = {}
            for n, b in to.items():
                if new.get(n, -1) < b:
                    new[n] = b
                if n in self.ends[0] and not inner:
                    yield b, j + 1
                    first = b
                    while first and read[first - 1] == read[b]:
                        first -= 1
                    if first < b:
                        yield first, j + 1
            at = new

    def found(self, text: str, memo: dict) -> dict[str, float]:
        """Entries in a whole text."""
        low = text.lower()
        out = {f: w for w, f in map(memo.__getitem__, set(low.split())) if w}
        for m in _SPACED.finditer(low) if self.lexicon else ():
            letters = _GAPS.split(m[0])
            whole = "".join(letters)
            parts = {"".join(letters[a:b]) for a, b in self._spelt(letters) if b - a > 2}
            if self._reaches(skeleton(whole)) or _SIGNS.search(whole) and self._dropping(whole):
                parts.add(whole)
            for part in parts:
                w, f = self.entry(decode(part, self.cost))
                if w:
                    out[f] = w
        return out

    def inputs(self, found: dict[str, float]) -> tuple[float, float]:
        return max(found.values(), default=0.0), math.log1p(len(found))

    def score(self, found: dict[str, float]) -> float:
        if self.share is not None:
            return self.share
        x, y = self.inputs(found)
        z = self.weights[0] + self.weights[1] * x + self.weights[2] * y
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


_MEMOS: dict[str, Memo] = {}


def memo_of(model: Model) -> Memo:
    """This worker's memo for a model, kept from task to task; only one model's at a time."""
    if model.key not in _MEMOS:
        _MEMOS.clear()
        _MEMOS[model.key] = Memo(model)
    claim("toxicity", _MEMOS.clear)
    return _MEMOS[model.key]


class Memo(dict):
    """Weights of tokens; emptied when full."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> tuple[float, str]:
        if len(self) > MEMO_ENTRIES:
            self.clear()
        w = self.model.weigh(token)
        if len(token) <= 64:
            self[token] = w
        return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, scratch: Scratch, bound: int) -> DataFrame:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = min(1.0, bound / max(1, known.count()))
    some = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(part * (1 << 30)))
    # about ``bound`` rows of two numbers: safe to broadcast at any size of the tables
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    return scratch.write(rows.select("text", "toxic"), "sample")


def _document_features(text: str) -> set[str]:
    return {f for w in {t.strip(_EDGES) for t in set(text.lower().split())} if len(w) > 2 and w.isalpha() for f in features(w)}


def _frequencies(only: set[str] | None):
    """Documents that hold a feature, by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                found = _document_features(text.as_py())
                n.update(found if only is None else found & only)
        yield pa.RecordBatch.from_arrays([pa.array(list(n.keys()), pa.string()), pa.array(list(n.values()), pa.int64())], names=["feature", "n"])

    return run


def _gain(n1: int, n0: int, t1: int, t0: int) -> float:
    """Log-likelihood ratio (twice) of a feature's independence of the label."""
    cells = ((n1, t1), (n0, t0))
    share = (n1 + n0) / (t1 + t0)
    out = 0.0
    for n, t in cells:
        for seen, expected in ((n, t * share), (t - n, t * (1 - share))):
            if seen > 0:
                out += seen * math.log(seen / expected)
    return 2 * out


def _lexicon(sample: DataFrame, t1: int, t0: int) -> dict[str, float]:
    count = lambda kind, only: sample.filter(f"toxic = {kind}").select("text").mapInArrow(_frequencies(only), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    # the sample's bound bounds both tables
    toxic = {r["feature"]: r["n"] for r in count(1, None).filter(F.col("n") >= LEAST_DOCS).collect()}
    clean = {r["feature"]: r["n"] for r in count(0, set(toxic)).collect()}
    least = max(15.0, 2 * math.log(max(2, len(toxic))) - 4)
    out = {}
    for f, n1 in toxic.items():
        n0 = clean.get(f, 0)
        weight = math.log((n1 + 0.5) / (t1 + 1)) - math.log((n0 + 0.5) / (t0 + 1))
        if weight > 2 and _gain(n1, n0, t1, t0) >= least:
            out[f] = weight
    words = [(f[:-1], toxic[f]) for f in out if f[-1] == "$"]
    # a beginning that is nearly always one and the same word says no more than the word
    same = {w[:k] for w, n in words for k in PREFIXES if len(w) >= k and n >= 0.8 * toxic.get(w[:k], 0)}
    return {f: w for f, w in out.items() if f not in same}


def _inputs(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = memo_of(model)
        for batch in batches:
            x = [model.inputs(model.found(t.as_py(), memo)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64()), batch.column("toxic")], names=["x", "y", "toxic"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None, bound: int = SAMPLE) -> Model:
    """Language model from all of ``docs``, lexicon and weights from at most about ``bound`` labelled rows."""
    scratch = scratch or Scratch(docs.sparkSession, "toxic")
    cost = language_model(docs.select(F.coalesce("text", F.lit("")).alias("text")), scratch)
    sample = _sample(docs, labels, scratch, bound)
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    t1, t0 = totals.get(1, 0), totals.get(0, 0)
    if not t1 or not t0:
        return Model(cost, share=(t1 + 1) / (t1 + t0 + 2) if t1 + t0 else 0.0)
    model = Model(cost, _lexicon(sample, t1, t0))
    rows = sample.mapInArrow(_inputs(model), "x double, y double, toxic int").toPandas()  # three numbers a sampled row
    x = np.column_stack([np.ones(len(rows)), rows["x"], rows["y"]])
    model.weights = tuple(float(w) for w in _logistic(x, rows["toxic"].to_numpy(float)))
    return model


def _scores(model: Model, names: tuple[str, str] = ("score", "entries")):
    """The last column is the text; it goes, score and entries come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = memo_of(model)
        for batch in batches:
            *kept, texts = batch.columns
            found = [model.found(t.as_py(), memo) for t in texts]
            more = [pa.array([model.score(f) for f in found], pa.float64()), pa.array([",".join(sorted(f)) for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*kept, *more], names=[*batch.schema.names[:-1], *names])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, entries) for each row of ``docs(doc_id, text)``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text"))
    out = rows.mapInArrow(_scores(model), "doc_id long, score double, entries string")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "entries")


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows whose text scores 0.5 or more; its columns may have any names."""
    text, toxic, entries = (fresh(docs, name) for name in ("text", "toxic", "entries"))
    rows = docs.select("*", F.coalesce("text", F.lit("")).alias(text))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    scored = rows.mapInArrow(_scores(model, (toxic, entries)), f"{kinds}, `{toxic}` double, `{entries}` string")
    return scored.filter(F.col(toxic) < 0.5).select(*docs.columns)
