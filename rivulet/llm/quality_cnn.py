"""Text quality by a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of
it.  Each byte is embedded; two more channels tell whether the six bytes here
stood in the chunk before, and how often that is so nearby.  Learned filters
slide over the chunk, their largest responses describe it, and the mean and
the maximum over all chunks combine into one probability by a logistic unit.

The network is fitted by gradient descent (Adam) with plain numpy on a
bounded sample: at most ``FIT_PER_CLASS`` rows of each class and
``FIT_CHUNKS`` chunks of a row, spread over the whole text.  Scoring reads
every byte of every text.

Defined cases: null and empty texts are one chunk of padding and get its
score; a null id is scored and not held out; repeated rows are scored each;
with labels of one class only every score is that class, without labels one
half; an empty table gives an empty result; other columns are not read.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, prepare, slices
from .labelled import FIT_PER_CLASS, fit_sample

CHUNK, OVERLAP = 512, 64
FIT_CHUNKS = 12
CHANNELS, FILTERS, WIDTH, STRIDE = 8, 32, 8, 2
STEPS, BATCH, RATE = 500, 64, 0.006
NEAR = 32


def chunks_of(data: bytes) -> np.ndarray:
    """(n, CHUNK) bytes; consecutive chunks share OVERLAP bytes, the last is
    padded with zeros."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(data) - OVERLAP) // step))
    flat = np.zeros((n - 1) * step + CHUNK, np.uint8)
    flat[:len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.as_strided(flat, (n, CHUNK), (step, 1)).copy()


def recurrence(x: np.ndarray) -> np.ndarray:
    """Per second byte: 1 if its six bytes stood at an earlier such place of
    the chunk (padding never does), and the mean of that over NEAR places."""
    n = len(x)
    words = np.zeros((n, CHUNK + 8), np.uint8)
    words[:, :CHUNK] = x
    win = np.lib.stride_tricks.as_strided(words, (n, CHUNK // STRIDE, 6), (words.strides[0], STRIDE, 1))
    key = np.zeros((n, CHUNK // STRIDE), np.uint64)
    for k in range(6):
        key |= win[:, :, k].astype(np.uint64) << np.uint64(8 * k + 8)
    key |= np.arange(CHUNK // STRIDE, dtype=np.uint64)[None, :] & np.uint64(255)
    key.sort(axis=1)
    again = np.zeros(key.shape, bool)
    again[:, 1:] = ((key[:, 1:] ^ key[:, :-1]) < 256) & (key[:, 1:] >= 256)
    out = np.zeros(key.shape, np.float32)
    np.put_along_axis(out, (key & np.uint64(255)).astype(np.int64), again.astype(np.float32), axis=1)
    total = np.cumsum(out, axis=1)
    near = np.empty_like(out)
    near[:, :NEAR] = total[:, :NEAR]
    near[:, NEAR:] = total[:, NEAR:] - total[:, :-NEAR]
    return np.stack([out, near / NEAR], axis=2)


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        n_in = WIDTH * CHANNELS + 2
        self.params = {"embed": rng.normal(0, 0.5, (256, CHANNELS)), "filters": rng.normal(0, (2 / n_in) ** 0.5, (n_in, FILTERS)),
                       "bias": np.zeros(FILTERS), "out": np.zeros(2 * FILTERS), "shift": np.zeros(1)}
        self.params = {k: v.astype(np.float32) for k, v in self.params.items()}

    def patches(self, x: np.ndarray) -> np.ndarray:
        """(chunks, places, inputs of a filter)."""
        n, places = len(x), (CHUNK - WIDTH) // STRIDE + 1
        e = self.params["embed"][x]
        s = e.strides
        view = np.lib.stride_tricks.as_strided(e, (n, places, WIDTH * CHANNELS), (s[0], STRIDE * s[1], s[2]))
        out = np.empty((n, places, WIDTH * CHANNELS + 2), np.float32)
        out[:, :, :-2] = view
        out[:, :, -2:] = recurrence(x)[:, :places]
        return out

    def pooled(self, x: np.ndarray, tile: int = 32) -> np.ndarray:
        """Largest response of each filter per chunk."""
        out = np.empty((len(x), FILTERS), np.float32)
        for at in range(0, len(x), tile):
            p = self.patches(x[at:at + tile])
            out[at:at + tile] = (p.reshape(-1, p.shape[2]) @ self.params["filters"]).reshape(p.shape[0], p.shape[1], -1).max(axis=1)
        return np.maximum(out + self.params["bias"], 0)

    def combine(self, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits and combined vectors of documents whose chunks begin at ``starts``."""
        sizes = np.diff(np.r_[starts, len(h)])[:, None]
        g = np.hstack([np.add.reduceat(h, starts) / sizes, np.maximum.reduceat(h, starts)])
        return g @ self.params["out"] + self.params["shift"][0], g

    def scores(self, texts: list[bytes]) -> np.ndarray:
        parts = [chunks_of(t) for t in texts]
        starts = np.r_[0, np.cumsum([len(p) for p in parts])[:-1]].astype(np.int64)
        logits, _ = self.combine(np.vstack([self.pooled(p) for p in parts]) if len(parts) < 2 else self.pooled(np.vstack(parts)), starts)
        return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -40, 40)))

    def gradients(self, x, starts, y, weight):
        """Of the mean weighted log loss of a batch of documents."""
        sizes = np.diff(np.r_[starts, len(x)])
        resp, where = np.empty((len(x), FILTERS), np.float32), np.empty((len(x), FILTERS), np.int64)
        patches = self.patches(x)
        r = (patches.reshape(-1, patches.shape[2]) @ self.params["filters"]).reshape(patches.shape[0], patches.shape[1], -1)
        where = r.argmax(axis=1)
        resp = np.take_along_axis(r, where[:, None, :], 1)[:, 0] + self.params["bias"]
        h = np.maximum(resp, 0)
        logits, g = self.combine(h, starts)
        d = (1 / (1 + np.exp(-np.clip(logits, -40, 40))) - y) * weight / weight.sum()
        grads = {"out": g.T @ d, "shift": np.array([d.sum()])}
        dg = d[:, None] * self.params["out"]
        doc = np.repeat(np.arange(len(starts)), sizes)
        dh = (dg[:, :FILTERS] / sizes[:, None])[doc]
        top = h == g[:, FILTERS:][doc]  # ties share
        ties = np.add.reduceat(top.astype(np.float32), starts)
        dh = (dh + np.where(top, (dg[:, FILTERS:] / ties)[doc], 0)) * (resp > 0)
        at = patches[np.arange(len(x))[:, None], where]            # (chunks, filters, inputs)
        grads["filters"] = np.einsum("cfi,cf->if", at, dh)
        grads["bias"] = dh.sum(0)
        back = dh[:, :, None] * self.params["filters"].T[None, :, :-2]
        bytes_at = x[np.arange(len(x))[:, None, None], where[:, :, None] * STRIDE + np.arange(WIDTH)]
        embed = np.zeros((256, CHANNELS))
        np.add.at(embed, bytes_at.ravel(), back.reshape(-1, CHANNELS))
        grads["embed"] = embed
        return grads

    def fit(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, steps: int = STEPS, seed: int = 5):
        rng = np.random.default_rng(seed)
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.params.items()}
        share = float((y * weight).sum() / weight.sum())
        self.params["shift"][0] = np.log(share / (1 - share))
        order: list[int] = []
        for step in range(1, steps + 1):
            if len(order) < BATCH:
                order += rng.permutation(len(docs)).tolist()
            some, order = np.array(order[:BATCH]), order[BATCH:]
            parts = [docs[k] for k in some]
            starts = np.r_[0, np.cumsum([len(p) for p in parts])[:-1]].astype(np.int64)
            grads = self.gradients(np.vstack(parts), starts, y[some], weight[some])
            rate = RATE * (1 - step / (steps + 1))
            for k, g in grads.items():
                g = g + 1e-4 * self.params[k]
                m[k][0] = 0.9 * m[k][0] + 0.1 * g
                m[k][1] = 0.99 * m[k][1] + 0.01 * g * g
                self.params[k] = (self.params[k] - rate * (m[k][0] / (1 - 0.9 ** step))
                                  / (np.sqrt(m[k][1] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return self


class Constant:
    def __init__(self, share: float):
        self.share = share

    def scores(self, texts):
        return np.full(len(texts), self.share)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, remainder: int = 2,
          per_class: int = FIT_PER_CLASS):
    """The network fitted on the labelled rows that are not held out."""
    prepare(docs)
    rows, weights = fit_sample(docs, labels, label, modulus, remainder, per_class)
    if len(weights) < 2:
        return Constant(float(next(iter(weights))) if weights else 0.5)  # the only class there is

    def cut(frames):
        for f in frames:
            parts = [chunks_of(t.encode("utf-8", "surrogatepass")) for t in f["text"]]
            parts = [p[np.unique(np.linspace(0, len(p) - 1, min(len(p), FIT_CHUNKS)).astype(int))] for p in parts]
            yield pd.DataFrame({"doc_id": f["doc_id"], "y": f["y"], "chunks": [p.tobytes() for p in parts]})

    sample = rows.mapInPandas(cut, "doc_id long, y int, chunks binary").toPandas().sort_values(["doc_id", "chunks"])
    y = sample["y"].to_numpy(np.float32)
    if len(set(y)) < 2:  # labels, but no texts of both classes
        return Constant(float(y[0]) if len(y) else 0.5)
    weight = np.array([weights[int(k)] for k in y], np.float32)
    return Network().fit([np.frombuffer(c, np.uint8).reshape(-1, CHUNK) for c in sample["chunks"]], y, weight)


def score_texts(model, texts: list) -> np.ndarray:
    """Scores of texts (null counts as empty), some at a time."""
    out, some, size = [np.zeros(0)], [], 0
    for t in texts:
        some.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(some[-1])
        if size > 200_000:
            out.append(model.scores(some))
            some, size = [], 0
    if some:
        out.append(model.scores(some))
    return np.concatenate(out)


def score(docs: DataFrame, model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted (1 from ``threshold`` on) per row."""
    prepare(docs)
    rows = docs.select("doc_id", "text")
    schema = rows.select("doc_id", F.lit(0.0).alias("score")).schema

    def run(batches):
        for batch in slices(batches):
            scores = score_texts(model, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``threshold``."""
    prepare(docs)

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array(score_texts(model, batch.column("text").to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    out = score(docs, train(docs, labels), threshold)
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")
