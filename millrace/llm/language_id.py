"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

Subwords are runs of 3 to 5 bytes that reach at most one byte beyond a word at either end (A-Z lower-cased, every other
ASCII byte that is no letter counts as a blank), hashed to BUCKETS.  A text's vector is the mean of its subwords'
embeddings; a linear layer and a softmax follow.  Both layers are trained by stochastic gradient descent in numpy on a
bounded sample: about SAMPLE labelled documents in all, chosen by a hash of the id, shared evenly by the languages; every
language has EACH at least, as far as it has as many, and one in any case.  Of a longer document the first LONGEST
characters are taken, fewer where EACH makes the sample larger, so that the sample's size is bounded.  There is no limit
on the number of languages; the model takes 4 bytes x BUCKETS for each.  A fifth of the sample is held back, though not
all documents of a language: on it a temperature is fitted (so that scores are calibrated probabilities) and the
rejection threshold is set so that REJECTED of its documents fall below it, at LIKELY at most.

Predictions read the text alone, all of it.  As the model is linear after the mean, executors get the product of both
layers, one row of logits for each bucket.

Defined results: null text, or text without a letter, is `und` with score 0, and rejected; without any labelled
document every text is `und`; rows are taken one by one; other columns are not looked at."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _words
from millrace.llm._shared import fresh, slices, table, written

BUCKETS, DIM = 1 << 15, 16
SAMPLE, EACH, LONGEST = 2048, 8, 20_000
EPOCHS, BATCH, RATE = 6, 32, 0.5
REJECTED, LIKELY = 0.001, 0.5
UNKNOWN = "und"
#: Bytes of text that a task unfolds into subwords at a time, at some 150 bytes each.
SLICE = 1 << 19

_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every subword, text by text."""
    raw, at = _words.buffers(texts)
    n = len(at) - 1
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
    padded = np.full(len(raw) + 4 * n + 4, 32, np.uint8)
    place = np.arange(len(raw)) + 4 * row + 1
    padded[place] = _FOLD[raw]
    wide = padded.astype(np.uint64)
    inside = padded != 32
    first, last = inside[place], place
    rows, buckets = [], []
    ok = first
    key = (wide[last - 1] << np.uint64(8)) | wide[last]
    for size in (3, 4, 5):
        ok = ok & inside[last + size - 3]
        key = (key << np.uint64(8)) | wide[last + size - 2]
        k = key[ok] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size)
        k ^= k >> np.uint64(29)
        rows.append(row[ok])
        buckets.append(((k * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 15)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and their shares of each text's subwords."""
    out = []
    for i in range(0, len(texts), 64):
        row, bucket = subwords(pa.array(texts[i : i + 64], pa.large_string()))
        both, counts = np.unique(row * BUCKETS + bucket, return_counts=True)
        cuts = np.searchsorted(both, np.arange(len(texts[i : i + 64]) + 1) * BUCKETS)
        for a, b in zip(cuts, cuts[1:]):
            c = counts[a:b].astype(np.float32)
            out.append((both[a:b] % BUCKETS, c / max(1, c.sum())))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Calibrated probabilities, texts x languages."""
        n, k = len(texts), len(self.langs)
        row, bucket = subwords(texts)
        counts = np.maximum(1, np.bincount(row, minlength=n))
        z = np.stack([np.bincount(row, weights=self.logits[bucket, j], minlength=n) for j in range(k)], axis=1)
        return _softmax((z / counts[:, None] + self.bias) / self.temperature)


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    x, y = bags(texts), np.array([langs.index(v) for v in labels], np.int64)
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    only = ~np.isin(y[held], y[used])  # languages that would be held back as a whole
    held, used = held[~only], np.append(used, held[only])
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    out += rng.normal(0, 1 / DIM, out.shape).astype(np.float32)
    weight = len(used) / (len(langs) * np.maximum(1, np.bincount(y[used], minlength=len(langs))))
    steps, step = EPOCHS * (1 + len(used) // BATCH), 0
    for _ in range(EPOCHS):
        rng.shuffle(used)
        for i in range(0, len(used), BATCH):
            some = used[i : i + BATCH]
            rate = RATE * (1 - step / steps) + 0.01
            step += 1
            mean = np.stack([x[j][1] @ emb[x[j][0]] for j in some])
            p = _softmax(mean @ out + bias)
            p[np.arange(len(some)), y[some]] -= 1
            p *= weight[y[some]][:, None]
            back = p @ out.T
            out -= rate * (mean.T @ p) / len(some) * 4
            bias -= rate * p.mean(axis=0)
            for k, j in enumerate(some):
                emb[x[j][0]] -= (rate * 40) * x[j][1][:, None] * back[k]
    model = Model(langs, emb @ out, bias)
    if len(held):
        z = np.stack([x[j][1] @ model.logits[x[j][0]] if len(x[j][0]) else np.zeros(len(langs)) for j in held]) + bias
        losses = {t: -np.log(np.maximum(1e-12, _softmax(z / t)[np.arange(len(held)), y[held]])).mean() for t in np.geomspace(0.25, 5, 40)}
        model.temperature = float(min(losses, key=losses.get))
        p = _softmax(z / model.temperature)
        right = p.argmax(axis=1) == y[held]
        if right.any():
            model.threshold = float(min(LIKELY, np.quantile(p.max(axis=1)[right], REJECTED)))
    return model


def sample(docs: DataFrame, size: int = SAMPLE) -> list[tuple[str, str]]:
    """(text, lang) rows, about `size` or EACH a language, shared evenly by the languages of docs(id, text, lang); in
    the order of their draw, so that a model doesn't depend on how the rows are stored."""
    known = docs.filter(F.col("lang").isNotNull() & (F.length("text") > 0))
    known = known.withColumn("drawn", F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)) / float(1 << 40))
    counts = written(known.groupBy("lang").agg(F.count("*").alias("n"), F.min("drawn").alias("least")), "langs")
    n = counts.count()
    if not n:
        return []
    share = max(size / n, EACH)
    longest = max(1, int(LONGEST * size / (share * n)))
    limits = counts.select(F.col("lang").alias("of"), "least", (share / F.col("n")).alias("limit"))
    some = known.join(F.broadcast(limits), F.col("lang") == F.col("of")).filter((F.col("drawn") < F.col("limit")) | (F.col("drawn") == F.col("least")))
    got = [(r["drawn"], r["lang"], r["text"]) for r in some.select("drawn", F.substring("text", 1, longest).alias("text"), "lang").collect()]
    return [(text, lang) for _, lang, text in sorted(got)]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", names: tuple[str, str, str] = ("__lang", "__score", "__rejected")) -> DataFrame:
    """docs and, under `names`, the language, its score and whether it is rejected."""
    from pyspark.sql.types import StructType

    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType.fromJson(docs.schema.jsonValue())
    for name, kind in zip(names, ("string", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)

    def run(batches):
        m = sent.value
        for batch in slices(batches, text_col, SLICE):
            texts = batch.column(text_col)
            p = m.scores(texts) if m else np.zeros((batch.num_rows, 1))
            ok = np.array([has_letter(t) for t in texts.to_pylist()], bool) & (m is not None)
            score = np.where(ok, p.max(axis=1), 0.0)
            lang = [m.langs[j] if k else UNKNOWN for j, k in zip(p.argmax(axis=1), ok)] if m else [UNKNOWN] * batch.num_rows
            no = ~ok | (score < (m.threshold if m else 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(no)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def _third(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def learned(docs: DataFrame) -> Model | None:
    """A model from the documents whose crc32(doc_id) mod 3 is not 1."""
    rows = docs.filter(_third("doc_id") != 1).select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    some = sample(rows)
    return train([t for t, _ in some], [v for _, v in some]) if some else None


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learned(docs))
    return found.select("doc_id", F.coalesce(_third("doc_id") == 1, F.lit(False)).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is known, all columns kept; a missing lang is filled in."""
    lang, score, rejected = fresh(docs, "lang_found", "score_found", "rejected")
    found = identify(docs, learned(docs), names=(lang, score, rejected)).filter(~F.col(rejected))
    return found.select(*[F.coalesce("lang", lang).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])
