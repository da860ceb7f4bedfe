"""Toxicity by gradient-boosted trees over dense features.

Features of a whole text: how densely words of a lexicon occur, by strength;
how near they stand to second-person words; rates of capitals, exclamation
and other punctuation; rates of obfuscated words (letters mixed with digits
or signs, stretched letters, spelled-out words).  The lexicon is a short fixed
list joined with stems (word beginnings) that the labelled sample shows to be
much more frequent in toxic texts.  Stems used for a row's training features
come from the other folds, so that the trees do not learn from a lexicon that
has seen the row.  Out-of-fold margins are calibrated by isotonic regression.

Fitted on a bounded sample: at most ``FIT_PER_CLASS`` rows of each class, of
texts up to ``FIT_BYTES`` bytes.  Scoring reads every word of every text.

Defined cases: null and empty texts have all features zero and get that
score; a null id is scored and not held out; repeated rows are scored each;
with labels of one class only every score is that class, without labels one
half; an empty table gives an empty result; other columns are not read.
"""

import re
import struct
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, held_out, prepare, slices, worker_state
from .labelled import FIT_PER_CLASS, fit_sample

FIT_BYTES = 65_536
FOLDS = 4
MAX_STEMS = 400
STEM_LENGTHS = range(3, 9)
#: Generic insults, and words for the person spoken to.
INSULTS = frozenset("idiot moron stupid scum trash worthless pathetic loser disgusting clown dumb fool".split())
SECOND_PERSON = frozenset("you your yours you're u ur du dich dir dein deine sie ihr tu te toi ton ta tes vous votre vos "
                          "tú ti tuyo usted ustedes vosotros".split())
LEET = str.maketrans("01345$@7!", "oieassati")
TIERS = (1.2, 2.2, 3.5)
NAMES = ["lexicon", "weak", "medium", "strong", "strength", "mean_strength", "strongest_run", "near", "near_mean", "second", "capitals",
         "caps_words", "exclaims", "questions", "marks", "mixed", "hidden", "stretched", "spelled", "digits", "length", "log_words"]

_MARKS = re.compile(r"[^\w\s]")
_STRETCH = re.compile(r"([^\W\d_])\1\1")
_N = 12  # numbers kept per word


def letters(word: str) -> str:
    return "".join(c for c in word.lower() if c.isalpha())


def stems(word: str):
    """Beginnings of a word, and the whole word."""
    yield word + "$"
    for n in STEM_LENGTHS:
        if len(word) > n:
            yield word[:n]


def common_stems(texts, least: int = 3) -> set[str]:
    """Stems that at least ``least`` texts hold: no others can be chosen."""
    support: Counter = Counter()
    for t in texts:
        support.update({s for w in set(t.split()) if (plain := letters(w)) for s in stems(plain)})
    return {s for s, n in support.items() if n >= least}


class StemCounts:
    """Stems of labelled texts: weighted occurrences by class (a text counts a
    stem up to five times) and the toxic texts that hold them."""

    def __init__(self, wanted: set[str]):
        self.wanted = wanted
        self.words, self.counts, self.support, self.toxic = [0.0, 0.0], [Counter(), Counter()], Counter(), 0

    def take(self, text: str, toxic: int, weight: float):
        own: Counter = Counter()
        n = 0
        for word, times in Counter(text.split()).items():
            plain = word.lower() if word.isalpha() else letters(word)
            if plain:
                n += times
                for s in stems(plain):
                    if s in self.wanted:
                        own[s] += times
        self.words[toxic] += n * weight
        counts = self.counts[toxic]
        for s, times in own.items():
            counts[s] += min(times, 5) * weight
        if toxic:
            self.toxic += 1
            self.support.update(own.keys())

    def lexicon(self, without: "StemCounts | None" = None) -> dict[str, float]:
        """Stems at least e ** TIERS[0] times as frequent in toxic texts, the
        most significant ones; leaving out what another count holds."""
        def less(mine, other, key):
            return mine[key] - (other[key] if without else 0)

        o = without or self
        total = [less(self.words, o.words, k) for k in (0, 1)]
        if min(total) <= 0:
            return {}
        out, least = [], max(3, 0.01 * (self.toxic - (o.toxic if without else 0)))
        for s in self.support:
            if less(self.support, o.support, s) >= least:
                a, b = less(self.counts[1], o.counts[1], s), less(self.counts[0], o.counts[0], s)
                ratio = np.log((a + 0.5) / total[1]) - np.log((b + 0.5) / total[0])
                if ratio >= TIERS[0]:
                    out.append((a * ratio, s, float(ratio)))
        return {s: r for _, s, r in sorted(out, key=lambda x: (-x[0], x[1]))[:MAX_STEMS]}


class Features:
    """Dense features of texts under a lexicon of stems."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.heads = {s[:3] for s in lexicon}
        self.memo = Memo(lambda words: list(map(self.word, words)), 100_000)

    def word(self, w: str) -> bytes:
        simple = w.isalpha()
        plain = w.lower() if simple else letters(w)
        best = 0.0
        if (plain + "$")[:3] in self.heads:
            best = max(self.lexicon.get(s, 0.0) for s in stems(plain))
        insult = plain in INSULTS
        n_alpha = len(plain)
        n_upper = 0 if w.islower() else sum(map(str.isupper, w))
        stretched = bool(_STRETCH.search(w))
        hidden = stretched and not insult and re.sub(r"(.)\1+", r"\1", plain) in INSULTS
        single, mixed, exclaims, questions, marks = len(w) == 1, False, 0, 0, 0
        if not simple:
            core = w.strip(".,;:?\"'()")
            single, exclaims, questions, marks = len(core) == 1, w.count("!"), w.count("?"), len(_MARKS.findall(w))
            mixed = n_alpha > 0 and any(not c.isalpha() and c not in "'’-" for c in core[:-1])
            hidden = hidden or (mixed and not insult and letters(core.translate(LEET)) in INSULTS)
        return struct.pack(f"<{_N}f", insult, best, plain in SECOND_PERSON, n_upper, n_alpha, n_alpha > 2 and n_upper == n_alpha, exclaims,
                           questions, marks, mixed, hidden, stretched + 2 * single)

    def __call__(self, text: str) -> np.ndarray:
        n, sums = 0, np.zeros(len(NAMES))
        top = 0.0
        words = iter(text.split()) if len(text) < 1_000_000 else (m.group() for m in re.finditer(r"\S+", text))
        while part := list(islice(words, 100_000)):
            m = np.frombuffer(b"".join(map(self.memo.over(part).__getitem__, part)), np.float32).reshape(-1, _N)
            got, run = self._part(m)
            sums += got
            top = max(top, run)
            n += len(part)
        if not n:
            return np.zeros(len(NAMES))
        out = sums / n
        out[4] = sums[4] / n
        out[5] = sums[4] / max(1.0, sums[1] + sums[2] + sums[3])
        out[6] = top
        out[8] = sums[7] / max(1.0, sums[0] + sums[2] + sums[3])
        out[10] = sums[10] / max(1.0, sums[20])
        out[21] = np.log1p(n)
        return out

    @staticmethod
    def _part(m: np.ndarray) -> tuple[np.ndarray, float]:
        insult, best, second = m[:, 0] > 0, m[:, 1], m[:, 2] > 0
        sums = np.zeros(len(NAMES))
        sums[0] = insult.sum()
        sums[1] = ((best >= TIERS[0]) & (best < TIERS[1])).sum()
        sums[2] = ((best >= TIERS[1]) & (best < TIERS[2])).sum()
        sums[3] = (best >= TIERS[2]).sum()
        sums[4] = best.sum(dtype=np.float64)
        toxic = insult | (best >= TIERS[1])
        at, you = np.flatnonzero(toxic), np.flatnonzero(second)
        if len(at) and len(you):
            k = np.searchsorted(you, at)
            gap = np.minimum(np.abs(at - you[np.minimum(k, len(you) - 1)]), np.abs(at - you[np.maximum(k - 1, 0)]))
            sums[7] = np.exp(-gap / 5.0).sum()
        sums[9] = len(you)
        for to, col in ((10, 3), (20, 4), (11, 5), (12, 6), (13, 7), (14, 8), (15, 9), (16, 10)):
            sums[to] = m[:, col].sum(dtype=np.float64)
        sums[17] = (m[:, 11] % 2 == 1).sum()
        single = m[:, 11] >= 2
        sums[18] = (single[2:] & single[1:-1] & single[:-2]).sum() if len(m) > 2 else 0
        sums[19] = (m[:, 4] == 0).sum()
        run = 0.0
        if len(at):  # toxic words within any 30 words
            run = float((np.searchsorted(at, at + 30) - np.arange(len(at))).max())
        return sums, run


class Trees:
    """Gradient-boosted trees for the log loss, over binned features."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 8.0, ridge: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> "Trees":
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._bin(x)
        share = float((y * weight).sum() / weight.sum())
        self.start = float(np.log(share / (1 - share)))
        margin, self.trees = np.full(len(y), self.start), []
        least = min(self.least, 0.02 * weight.sum())
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(b, (p - y) * weight, p * (1 - p) * weight, weight, least)
            self.trees.append(tree)
            margin += self._tree(tree, b)
        return self

    def _bin(self, x):
        return np.stack([np.searchsorted(c, col, side="left") for c, col in zip(self.cuts, x.T)], axis=1).astype(np.int16)

    def _grow(self, b, g, h, weight, least):
        """Nodes (feature, bin, value) in heap order; feature -1 is a leaf."""
        size = 2 ** (self.depth + 1) - 1
        tree = [(-1, 0, 0.0)] * size
        rows = {0: np.arange(len(b))}
        for k in range(size):
            if k not in rows:
                continue
            at = rows.pop(k)
            gs, hs = g[at].sum(), h[at].sum()
            tree[k] = (-1, 0, float(-self.rate * gs / (hs + self.ridge)))
            if 2 * k + 2 >= size:
                continue
            best, pick = 1e-6, None
            for f in range(b.shape[1]):
                n = len(self.cuts[f]) + 1
                gl, hl, wl = (np.bincount(b[at, f], v[at], n).cumsum()[:-1] for v in (g, h, weight))
                gain = gl ** 2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs ** 2 / (hs + self.ridge)
                gain[(wl < least) | (weight[at].sum() - wl < least)] = 0
                if len(gain) and gain.max() > best:
                    best, pick = gain.max(), (f, int(gain.argmax()))
            if pick:
                tree[k] = (*pick, 0.0)
                left = b[at, pick[0]] <= pick[1]
                rows[2 * k + 1], rows[2 * k + 2] = at[left], at[~left]
        return tree

    def _tree(self, tree, b):
        feature, cut, value = (np.array(c) for c in zip(*tree))
        at = np.zeros(len(b), np.int64)
        for _ in range(self.depth):
            f = feature[at]
            inner = f >= 0
            right = b[np.arange(len(b)), np.maximum(f, 0)] > cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return value[at]

    def margins(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return self.start + sum(self._tree(t, b) for t in self.trees)


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best non-decreasing fit (pool adjacent violators), a
    little drawn in so that no score is exactly 0 or 1."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, t, w in zip(margin[order], y[order], weight[order]):
        blocks.append([t * w, w, m, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], blocks[-1][2], a[3]]
    xs, ps = [], []
    for s, w, low, high in blocks:
        p = (s + 0.01) / (w + 0.02)
        xs += [low, high]
        ps += [p, p]
    return np.array(xs), np.maximum.accumulate(np.array(ps))


class Model:
    def __init__(self, lexicon: dict, trees: Trees, knots: tuple):
        self.lexicon, self.trees, self.knots = lexicon, trees, knots

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.margins(x), *self.knots)


def fit(texts: list[str], y: np.ndarray, weight: np.ndarray, seed: int = 3) -> Model:
    folds = np.random.default_rng(seed).permutation(len(texts)) % FOLDS
    wanted = common_stems(t for t, toxic in zip(texts, y) if toxic)
    parts, every = [StemCounts(wanted) for _ in range(FOLDS)], StemCounts(wanted)
    for t, k, toxic, w in zip(texts, folds.tolist(), y.astype(int).tolist(), weight.tolist()):
        parts[k].take(t, toxic, w)
        every.take(t, toxic, w)
    x = np.zeros((len(texts), len(NAMES)))
    for k in range(FOLDS):
        of = Features(every.lexicon(parts[k]))
        for i in np.flatnonzero(folds == k):
            x[i] = of(texts[i])
    margin = np.zeros(len(texts))
    for k in range(FOLDS):
        rest = folds != k
        if 0 < y[rest].sum() < rest.sum():
            margin[~rest] = Trees().fit(x[rest], y[rest], weight[rest]).margins(x[~rest])
    return Model(every.lexicon(), Trees().fit(x, y, weight), isotonic(margin, y, weight))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, remainder: int = 0,
          per_class: int = FIT_PER_CLASS) -> Model | float:
    """The model of the labelled rows that are not held out, or a constant."""
    prepare(docs)
    rows, weights = fit_sample(docs, labels, label, modulus, remainder, per_class)
    if len(weights) < 2:
        return float(next(iter(weights))) if weights else 0.5
    sample = rows.where(F.octet_length("text") <= FIT_BYTES).orderBy("doc_id", "text").toPandas()
    y = sample["y"].to_numpy(np.float64)
    if len(set(y)) < 2:  # labels, but no texts of both classes
        return float(y[0]) if len(y) else 0.5
    return fit(sample["text"].tolist(), y, np.array([weights[int(k)] for k in y]))


def features_of(model: Model | float) -> Features | None:
    """Kept for the next task of this worker that scores by the same model."""
    if isinstance(model, float):
        return None
    return worker_state(("toxicity", hash(tuple(sorted(model.lexicon.items())))), lambda: Features(model.lexicon))


def score_texts(model: Model | float, features: Features | None, texts: list) -> np.ndarray:
    if features is None:
        return np.full(len(texts), model)
    return model.scores(np.array([features(t or "") for t in texts]).reshape(-1, len(NAMES)))


def score(docs: DataFrame, model: Model | float, threshold: float = 0.5) -> DataFrame:
    """doc_id, score and predicted (1 from ``threshold`` on) per row."""
    prepare(docs)
    rows = docs.select("doc_id", "text")

    def run(batches):
        features = features_of(model)
        for batch in slices(batches):
            scores = score_texts(model, features, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    out = rows.mapInArrow(run, rows.select("doc_id", F.lit(0.0).alias("score")).schema)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, model: Model | float, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``."""
    prepare(docs)

    def run(batches):
        features = features_of(model)
        for batch in slices(batches):
            yield batch.filter(pa.array(score_texts(model, features, batch.column("text").to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    out = score(docs, train(docs, labels), threshold)
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
