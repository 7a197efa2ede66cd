"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's normalised windows, with which each
document is scanned once; hits are mapped back to offsets in the original text.

Words are the runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lower-cased.  A window is `width`
consecutive words of an item; an item of fewer words, but not none, is one window.  The automaton goes to the executors
only while its texts are under SHARD_BYTES; a larger benchmark is cut into shards of that size, each scanned in turn,
whose hits are added up, so that no hit is lost and no task holds more than one shard.  Hits of several shards belong to
an id and text, not to an id alone, so that every row has its own hits, however many shards there are.

Defined results: null or empty text has no words and no hits; null or wordless texts of items give no window;
windows of an item without an id hit words, but add no item; repeated items and documents are each counted by their
rows; other columns of either table are not looked at."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._shared import fresh, slices, table, written

WIDTH = 10
SHARD_BYTES = 16 << 20
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # on folded text
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def automaton(items: list[tuple[int | None, str]], width: int = WIDTH):
    """From (item_id, text) rows; None if there is no window.  Keys are windows in spaces, values (words, item ids)."""
    by_window: dict[str, tuple[int, set]] = {}
    for item, text in items:
        own = normal_words(text)
        n = min(width, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            named = by_window.setdefault((b" " + b" ".join(own[i : i + n]) + b" ").decode("latin-1"), (n, set()))[1]
            if item is not None:
                named.add(item)
    if not by_window:
        return None
    made = ahocorasick.Automaton()
    for key, value in by_window.items():
        made.add_word(key, value)
    made.make_automaton()
    return made


def scan(made, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, the hit words as ranges [first, end) (in order, not overlapping), the items."""
    own = normal_words(text)
    if made is None or not own:
        return len(own), [], set()
    line = b" " + b" ".join(own) + b" "
    found = list(made.iter(line.decode("latin-1")))
    if not found:
        return len(own), [], set()
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    ends = np.searchsorted(spaces, [at for at, _ in found])
    ranges: list[tuple[int, int]] = []
    items: set = set()
    for start, end in sorted((int(e) - v[0], int(e)) for e, (_, v) in zip(ends, found, strict=True)):
        if ranges and start <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(end, ranges[-1][1]))
        else:
            ranges.append((start, end))
    for _, (_, ids) in found:
        items |= ids
    return len(own), ranges, items


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words as ranges of code points of the original text."""
    folded = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
    at = [m.span() for m in _WORD.finditer(folded)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def shards(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    """The items in shards of at most SHARD_BYTES of text (or one item)."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    if total <= SHARD_BYTES:
        yield [(r["item"], r["text"]) for r in rows.collect()]
        return
    some, size = [], 0
    for r in rows.toLocalIterator():
        n = len(r["text"].encode())
        if some and size + n > SHARD_BYTES:
            yield some
            some, size = [], 0
        some.append((r["item"], r["text"]))
        size += n
    yield some


def _scanned(docs: DataFrame, items: list[tuple[int | None, str]], width: int) -> DataFrame:
    """docs(id, key, text) -> id, key, n_words, ranges, spans, items."""
    sent = docs.sparkSession.sparkContext.broadcast(items)
    schema = "id long, key string, n_words long, ranges array<struct<first:long,end:long>>, spans array<struct<first:long,end:long>>, items array<long>"
    pairs = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        made = automaton(sent.value, width)
        for batch in slices(batches, limit=8 << 20):
            counts, ranges, spans, ids = [], [], [], []
            for text in batch.column("text").to_pylist():
                n, hit, own = scan(made, text)
                counts.append(n)
                ranges.append([{"first": a, "end": b} for a, b in hit])
                spans.append([{"first": a, "end": b} for a, b in original_spans(text, hit)] if hit else [])
                ids.append(sorted(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), pa.array(counts, pa.int64()), pa.array(ranges, pairs), pa.array(spans, pairs), pa.array(ids, pa.list_(pa.int64()))],
                names=["id", "key", "n_words", "ranges", "spans", "items"],
            )

    return docs.mapInArrow(run, schema)


def _n_covered(ranges):
    """Words in ranges that may overlap: they are sorted, and each adds what lies beyond the ones before."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(
        F.array_sort(ranges),
        start,
        lambda s, r: F.struct(
            (s["n"] + F.greatest(F.lit(0).cast("long"), r["end"] - F.greatest(s["to"], r["first"]))).alias("n"),
            F.greatest(s["to"], r["end"]).alias("to"),
        ),
        lambda s: s["n"],
    )


def _key(text):
    """What stands for a text where hits are joined back to their rows."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, keyed: bool = False) -> DataFrame:
    """One row for each document: id, n_words, n_hit, ranges (of hit words), spans (of code points of the original),
    items (sorted ids); with `keyed` also key, the digest of the text."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    first, *more = shards(benchmark, item_col, item_text_col)
    rows = rows.select("id", (_key(F.col("text")) if more or keyed else F.lit("")).alias("key"), "text")
    found = _scanned(rows, first, width)
    lists = ["ranges", "spans", "items"]
    if more:
        every = None
        for i, items in enumerate(more):
            one = _scanned(rows, items, width).filter(F.size("ranges") > 0).select("id", "key", F.lit(i).alias("shard"), *lists)
            every = one if every is None else every.unionByName(one)
        once = written(every, "hits").groupBy("id", "key", "shard").agg(*[F.first(c).alias(c) for c in lists])  # rows with equal ids and texts have equal hits
        added = once.groupBy(F.col("id").alias("of"), F.col("key").alias("of_key")).agg(*[F.flatten(F.collect_list(c)).alias(f"more_{c}") for c in lists])
        found = found.join(added, F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left")
        both = {c: F.when(F.col("of_key").isNull(), F.col(c)).otherwise(F.array_sort(F.array_distinct(F.concat(c, f"more_{c}")))).alias(c) for c in lists}
        found = found.select("id", "key", "n_words", *both.values())
    return found.withColumn("n_hit", _n_covered(F.col("ranges"))).drop(*([] if keyed else ["key"]))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without any benchmark window, all columns kept; judged row by row, also where ids are
    missing or repeated."""
    of, key = fresh(docs, "hit_id", "hit_key")
    hit = decontaminate(docs, table(spark, sf_dir, "benchmark"), keyed=True).filter(F.col("n_hit") > 0)
    hit = hit.select(F.col("id").alias(of), F.col("key").alias(key)).distinct()
    return docs.join(hit, F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (_key(F.col("text")) == F.col(key)), "left_anti")
