"""Quality classifier by positive-unlabelled learning with a non-negative risk.

Trusted positives are labelled documents of label 1; the unlabelled set is any documents.  With class prior p and
sigmoid loss l the risk is

    p * mean_P l(f, +1) + max(0, mean_U l(f, -1) - p * mean_P l(f, -1)),

minimised in numpy by Adam over mini-batches; where the second term of a batch is negative, its gradient is turned
around, as non-negative PU learning does.  The prior is estimated from a fit of positives against
unlabelled (see _prior).  Rows of label 0 are not learned from, neither as negatives nor for the prior.

f is additive over binned features of the whole text: shares of bytes by class (upper case, digits, symbols, bars,
stops, blanks, other scripts), length, word length, repeated neighbours and distinct words.  Bins are quantiles of the
training sample.  The sample is bounded: about POSITIVES and UNLABELLED documents, chosen by a hash of the id.

Defined results: null text counts as empty, and empty text gets a score like any other; without any positive label
every score is 0.5; rows are taken one by one; other columns are not looked at."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _words
from millrace.llm._shared import slices, table

POSITIVES, UNLABELLED = 6000, 8000
#: Bin edges as quantiles of the training sample, finer at both ends, where junk is found.
QUANTILES = [0.005, 0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99, 0.995]
BINS = len(QUANTILES)
STEPS, BATCH, RATE, DECAY = 500, 2048, 0.05, 1e-4
CUT = 0.3
#: Chance that the bound of the prior's estimate doesn't hold.
DOUBT = 0.1

FEATURES = ["upper", "lower", "digits", "stops", "marks", "symbols", "bars", "blanks", "lines", "other", "length", "word_length", "repeats", "distinct", "run_of_upper"]
_CLASSES = 10


def _classes() -> np.ndarray:
    t = np.full(256, 9, np.int64)
    for k, some in enumerate((range(65, 91), range(97, 123), range(48, 58), b".,;:'\"()-", b"!?", b"#$%&*@^~+=<>/\\_`{}[]", b"|", b" \t", b"\n\r\x0b\x0c")):
        t[list(some)] = k
    t[:9] = t[14:32] = t[127] = 5
    return t


_CLASS = _classes()


def features(texts: pa.Array) -> np.ndarray:
    """texts x FEATURES."""
    n = len(texts)
    raw, at = _words.buffers(texts)
    sizes = np.diff(at)
    row = np.repeat(np.arange(n, dtype=np.int64), sizes)
    share = np.bincount(row * _CLASSES + _CLASS[raw], minlength=n * _CLASSES).reshape(n, _CLASSES) / np.maximum(1, sizes)[:, None]
    w = _words.words(texts)
    counts = np.diff(w.first)
    same = np.zeros(len(w.row), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    order = np.lexsort((w.hash, w.row))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (w.row[order][1:] != w.row[order][:-1])
    per = lambda v: np.bincount(w.row, weights=v, minlength=n) / np.maximum(1, counts)
    capital = np.zeros(len(w.row))
    if len(w.row):
        both = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])
        capital = both[w.end] - both[w.start] >= 2
    return np.column_stack([share, np.log1p(sizes), per(w.end - w.start), per(same), np.bincount(w.row[order], weights=fresh, minlength=n) / np.maximum(1, counts) ** 0.9, per(capital)])


@dataclass
class Model:
    edges: list[np.ndarray]
    weights: np.ndarray
    bias: float
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.weights[_bins(x, self.edges)].sum(axis=1) + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The active column of each feature."""
    return np.column_stack([j * (BINS + 1) + np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fit(pos: np.ndarray, unl: np.ndarray, prior: float | None, width: int, seed: int) -> tuple[np.ndarray, float]:
    """Non-negative PU risk; with prior None the logistic loss of positives against unlabelled."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)

    def one_hot(cols):
        out = np.zeros((len(cols), width), np.float32)
        np.put_along_axis(out, cols, 1, axis=1)
        return out

    def gradient(x, slope):
        return np.append(x.T @ slope.astype(np.float32), slope.sum()) / len(x)

    for t in range(1, STEPS + 1):
        p = one_hot(pos[rng.integers(0, len(pos), min(len(pos), BATCH))])
        u = one_hot(unl[rng.integers(0, len(unl), min(len(unl), BATCH))])
        zp, zu = p @ w + b, u @ w + b
        sp, su = _sigmoid(zp), _sigmoid(zu)
        if prior is None:
            g = gradient(p, sp - 1) + gradient(u, su)
        else:
            negative = su.mean() - prior * sp.mean()
            down = gradient(u, su * (1 - su)) - prior * gradient(p, sp * (1 - sp))
            g = down - prior * gradient(p, sp * (1 - sp)) if negative >= 0 else -down
        g = g + DECAY * np.append(w, b)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _prior(pos: np.ndarray, unl: np.ndarray, width: int, seed: int) -> float:
    """Best bin: of the documents whose chance of being a positive is above a cut, the share among the unlabelled over
    that among the positives, at the cut where its upper confidence bound is least; there hardly any document above it
    is no positive.  Each half is judged by a fit of the other, not by what was learned from it."""
    of_pos, of_unl = [], []
    for k in (0, 1):
        if len(pos[k::2]) and len(unl[k::2]):
            w, b = _fit(pos[k::2], unl[k::2], None, width, seed)
            of_pos.append(w[pos[1 - k :: 2]].sum(axis=1) + b)
            of_unl.append(w[unl[1 - k :: 2]].sum(axis=1) + b)
    p, u = (np.sort(np.concatenate(x)) if x else np.zeros(0) for x in (of_pos, of_unl))
    if not len(p) or not len(u):
        return 0.5
    above = lambda x: 1 - np.searchsorted(x, p, "left") / len(x)  # noqa: E731  at each positive as a cut
    among_p, among_u = above(p), above(u)
    doubt = sum(np.sqrt(np.log(4 / DOUBT) / (2 * n)) for n in (len(p), len(u)))
    best = np.argmin((among_u + doubt) / among_p)
    return float(np.clip(among_u[best] / among_p[best], 0.05, 0.95))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, seed: int = 11) -> Model:
    every = np.concatenate([positive, unlabelled])
    edges = [np.unique(np.quantile(every[:, j], QUANTILES)) for j in range(every.shape[1])]
    pos, unl = _bins(positive, edges), _bins(unlabelled, edges)
    width = len(edges) * (BINS + 1)
    if prior is None:
        prior = _prior(pos, unl, width, seed)
    w, b = _fit(pos, unl, prior, width, seed)
    return Model(edges, w, b, prior)


def described(rows: DataFrame) -> DataFrame:
    """rows(id, text) -> id, x (the features)."""

    def run(batches):
        for batch in slices(batches):
            x = features(batch.column("text"))
            at = np.arange(len(x) + 1) * x.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x.ravel()))], names=["id", "x"])

    return rows.mapInArrow(run, "id long, x array<double>")


def _part(col, share: float):
    return F.pmod(F.xxhash64(col, F.lit("quality")), F.lit(1 << 20)) < int(share * (1 << 20))


def learned(docs: DataFrame, labels: DataFrame) -> Model | None:
    """docs(id, text), labels(id, label): only what may be learned from.  None without a positive label."""
    labels = labels.filter("id is not null and label is not null")
    n = labels.filter("label = 1").count()
    if not n:
        return None
    total = docs.filter("id is not null").count()
    positive = labels.filter("label = 1").filter(_part(F.col("id"), min(1.0, POSITIVES / n))).select("id").distinct()
    wanted = docs.filter(_part(F.col("id"), min(1.0, UNLABELLED / max(1, total)))).withColumn("kind", F.lit(0))
    trusted = docs.join(F.broadcast(positive), "id").withColumn("kind", F.lit(1))  # about POSITIVES ids
    rows = wanted.unionByName(trusted).select((2 * F.col("id") + F.col("kind")).alias("id"), "text")
    got = [(r["id"], r["x"]) for r in described(rows).collect()]
    x = {k: np.array([v for i, v in sorted(got) if i % 2 == k]).reshape(-1, len(FEATURES)) for k in (0, 1)}
    if not len(x[0]) or not len(x[1]):
        return None
    return train(x[1], x[0])


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(id, text) -> id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            m = sent.value
            score = m.score(features(batch.column("text"))) if m else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score, pa.float64())], names=["id", "score"])

    return docs.mapInArrow(run, "id long, score double")


def _fifth(col: str):
    return F.crc32(F.col(col).cast("string").cast("binary")) % 5


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("id"), F.col("quality").alias("label"))
    model = learned(docs.filter(_fifth("id") != 0), labels.filter(_fifth("id") != 0))
    return scored(docs, model).select(
        F.col("id").alias("doc_id"),
        F.coalesce(_fifth("id") == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
