"""MinHash near-duplicates: SuperMinHash signatures, banding, verification on full sets, union of links.

A document's set is its distinct `shingle`-word shingles (A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`); with fewer
words the whole sequence is its only shingle; without words the set is empty and linked with nothing.  Two documents
are linked if 100 * intersection >= percent * union; a group is a connected component of the links.

In SuperMinHash each element draws a permutation of the signature's slots, one slot in each round, and offers round +
random fraction there; a slot keeps its least offer.  As offers of later rounds are larger, an element's rounds can
stop once every slot of its document has an offer from an earlier one: long documents need a round or two.  Here
the rounds run over all elements of a slice at a time, and documents leave as their slots are filled.

Documents with equal sets are one class before anything else (a 128-bit digest of the set), represented by the
smallest id, so that copies never meet in pairs.  Classes that share a band of the signature are candidates.  In
each bucket the members are compared with one of them, the verified links are joined to components, and buckets whose
members are all in one component are done.  For the others it is counted how many of a member's shingles any other
candidate has; a member for which that is too few to reach the threshold with even the smallest in its bucket
can't be linked there and leaves it.  Who is left gets a second, longer signature in bands so narrow (FINE_ROWS) that
texts well below the threshold seldom meet.  In these buckets too all are compared with one member, the likely origin,
and joined.  Pairs that are still in two components are found by a prefix filter over what tells a member from a
pivot of its neighbourhood (see _rest).  No pair of a bucket is left out; none is made that can't reach the threshold
by the sizes and rarest differences of both.

With ROWS = 4 and BANDS = 32 a pair at 0.8 shares no band with probability (1 - 0.8 ** 4) ** 32 = 5e-8; with
FINE_ROWS = 12 and FINE_BANDS = 150 with (1 - 0.8 ** 12) ** 150 = 2e-5.

Defined results: null text is an empty set; a null id is in no group (component null); rows that share an id are one
vertex; other columns are not looked at."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import _words
from millrace.llm._graph import components
from millrace.llm._shared import fresh, slices, table, written

ROWS, BANDS = 4, 32
FINE_ROWS, FINE_BANDS = 12, 150
SLOTS = ROWS * BANDS
_NO_OFFER = np.uint64(0xFFFFFFFFFFFFFFFF)
_32 = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)
#: Elements that run their later rounds together at most, and bytes of signatures that a task holds at a time.
_BLOCK = 1 << 17
_SIGNATURE_BYTES = 64 << 20
#: Bytes of text that are shingled at a time; shingles take many times the room of their text.
_SLICE = 512 << 10


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, sorted."""
    w = _words.words(texts, _words.BLANK_SEPARATED, _words.LOWER)
    runs, inside = w.runs(k)
    row, value = w.row[: len(runs)][inside], runs[inside]
    counts = np.diff(w.first)
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        a, b = w.first[i], w.first[i + 1]
        whole = np.uint64(1)
        for h in w.hash[a:b].tolist():
            whole = _words.mix(np.array([int(whole) ^ h], np.uint64))[0]
        row, value = np.append(row, i), np.append(value, whole)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _offers(value: np.ndarray, k: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = _words.mix(value + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    swap = k + (((drawn & _LOW) * np.uint64(slots - k)) >> _32).astype(np.int64)
    return swap, (drawn >> _32) | (np.uint64(k) << _32)


def signatures(row: np.ndarray, value: np.ndarray, n_rows: int, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each row's elements, n_rows x slots; rows without elements have no offers.  row is sorted."""
    sig = np.full(n_rows * slots, _NO_OFFER, np.uint64)
    swap, offer = _offers(value, 0, slots)
    np.minimum.at(sig, row * slots + swap, offer)
    full = lambda: (sig.reshape(n_rows, slots) != _NO_OFFER).all(axis=1)
    short = ~full()[row] if len(row) else np.zeros(0, bool)
    some = np.flatnonzero(short)
    own = row[some]  # sorted; blocks end where a row does, as a row's slots must see all of its elements
    block = max(1, _BLOCK * SLOTS // (slots * _order_type(slots).itemsize))
    for rows in np.split(some, np.searchsorted(own, np.unique(own[block::block]))):
        if len(rows):
            _later_rounds(sig, row, value, swap, rows, slots)
    return sig.reshape(n_rows, slots)


def _order_type(slots: int) -> np.dtype:
    return np.dtype(np.uint8 if slots <= 1 << 8 else np.uint16 if slots <= 1 << 16 else np.int32)


def _later_rounds(sig, row, value, swap, some, slots) -> None:
    row, value = row[some], value[some]
    order = np.empty((len(some), slots), _order_type(slots))
    order[:] = np.arange(slots)
    each = np.arange(len(some))
    order[each, swap[some]], order[:, 0] = 0, swap[some]
    table = sig.reshape(-1, slots)
    for k in range(1, slots):
        to, offer = _offers(value, k, slots)
        slot = order[each, to].astype(np.int64)
        order[each, to] = order[:, k]
        order[:, k] = slot
        np.minimum.at(sig, row * slots + slot, offer)
        if k < 8 or k % 8 == 0:
            own, back = np.unique(row, return_inverse=True)
            open_ = (table[own] == _NO_OFFER).any(axis=1)[back]
            if not open_.any():
                return
            if open_.mean() < 0.8:
                row, value, order = row[open_], value[open_], order[open_]
                each = np.arange(len(row))


def _keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """A hash of each band of each signature."""
    rows = sig.shape[1] // bands
    keys = np.zeros((len(sig), bands), np.uint64)
    for r in range(rows):
        keys = _words.mix(keys + sig[:, r::rows] * np.uint64(2 * r + 3))
    return _words.mix(keys + np.arange(1, bands + 1, dtype=np.uint64)[None, :])


def _sketch(batch: pa.RecordBatch, k: int, rows: int, bands: int) -> pa.RecordBatch:
    n = batch.num_rows
    row, value = shingles(batch.column("text"), k)
    counts = np.bincount(row, minlength=n)
    digests = []
    for salt in (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_words.mix(value ^ salt), dtype=np.uint64)])
        at = np.concatenate([[0], np.cumsum(counts)])
        digests.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    keys = _keys(signatures(row, value, n, rows * bands), bands)
    has = counts > 0
    at = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))])
    return pa.RecordBatch.from_arrays(
        [batch.column("id"), pa.array(counts.astype(np.int64)), pa.array(digests[0]), pa.array(digests[1]), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys[has].ravel().view(np.int64)))],
        names=["id", "n_shingles", "hi", "lo", "bands"],
    )


def sketches(docs: DataFrame, shingle: int, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """docs(id, text) -> id, n_shingles, hi and lo (digest of the set), bands."""
    most = max(1, _SIGNATURE_BYTES // (8 * rows * bands))

    def run(batches):
        for batch in slices(batches, limit=_SLICE):
            for i in range(0, batch.num_rows, most):
                yield _sketch(batch.slice(i, most), shingle, rows, bands)

    return docs.mapInArrow(run, "id long, n_shingles long, hi long, lo long, bands array<long>")


def _linked(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of pairs(a, b) those that are linked, by full sets.  A hot `a` is split as any skewed join."""

    def run(batches):
        for batch in slices(slices(batches, "text_a", _SLICE), "text_b", _SLICE):
            n = batch.num_rows
            ra, va = shingles(batch.column("text_a"), shingle)
            rb, vb = shingles(batch.column("text_b"), shingle)
            row, value = np.concatenate([ra, rb]), np.concatenate([va, vb])
            order = np.lexsort((value, row))
            row, value = row[order], value[order]
            both = np.bincount(row[1:][(row[1:] == row[:-1]) & (value[1:] == value[:-1])], minlength=n)
            union = np.bincount(row, minlength=n) - both
            keep = pa.array((100 * both >= percent * union) & (union > 0))
            yield batch.select(["a", "b"]).filter(keep)

    a, b = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _facts(texts: DataFrame, shingle: int) -> DataFrame:
    """texts(id, text) -> id, n (size of the set), u (how many of its shingles another of these texts has)."""

    def run(batches):
        for batch in slices(batches, limit=_SLICE):
            row, value = shingles(batch.column("text"), shingle)
            at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(value.view(np.int64)))], names=["id", "h"])

    sets = written(texts.mapInArrow(run, "id long, h array<long>"), "sets")
    each = sets.select("id", F.explode("h").alias("h"))
    shared = written(each.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("h"), "shared")
    known = each.join(shared, "h").groupBy("id").agg(F.count("*").alias("u"))
    return written(sets.select("id", F.size("h").cast("long").alias("n")).distinct().join(known, "id", "left").select("id", "n", F.coalesce("u", F.lit(0)).alias("u")), "facts")


def _open(members: DataFrame, percent: int) -> DataFrame:
    """members(bucket, id, label, n, u) without those that can't be linked to any other label in their bucket: a link
    needs percent / (100 + percent) of both sizes in common, a member has at most u in common with anyone, and nobody
    in the bucket is smaller than the smallest."""
    low = members.groupBy("bucket").agg(F.min("n").alias("low"), F.min("label").alias("one"), F.max("label").alias("other")).filter("one < other")
    return members.join(low.select("bucket", "low"), "bucket").filter((100 + percent) * F.col("u") >= percent * (F.col("n") + F.col("low"))).drop("low")


def _labelled(rows: DataFrame, labels: DataFrame | None, by: str = "id", name: str = "label") -> DataFrame:
    """The component of `by` as a column; without one it is `by` itself."""
    if labels is None:
        return rows.withColumn(name, F.col(by))
    return rows.join(labels.select(F.col("id").alias(by), F.col("component").alias("_of")), by, "left").withColumn(name, F.coalesce("_of", by)).drop("_of")


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Components after further links(a, b): only components are joined, not their members' links again."""
    if links.isEmpty():
        return labels
    if labels is None:
        return components(links)
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    every = labels.unionByName(ends.join(labels, "id", "left_anti").select("id", F.col("id").alias("component")))
    lifted = _labelled(_labelled(links, labels, "a", "la"), labels, "b", "lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    up = components(lifted).select(F.col("id").alias("component"), F.col("component").alias("to"))
    return written(every.join(up, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "components")


def _mixed(members: DataFrame) -> DataFrame:
    """members(bucket, label, ...) of buckets with several labels."""
    buckets = members.groupBy("bucket").agg(F.min("label").alias("one"), F.max("label").alias("other")).filter("one < other").select("bucket")
    return members.join(buckets, "bucket", "left_semi")


def _classes(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Sketches, classes (hi, lo, rep) and components of the classes (id, component), None if there are no links."""
    sk = written(sketches(docs, shingle), "sketches")
    reps = written(sk.filter("n_shingles > 0 and id is not null").groupBy("hi", "lo").agg(F.min("id").alias("rep")), "classes")
    own = sk.join(reps.select(F.col("rep").alias("id")), "id", "left_semi").select("id", F.explode("bands").alias("bucket")).distinct()
    shared = written(own.groupBy("bucket").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).filter("pivot < last").select("bucket", "pivot"), "buckets")
    if shared.isEmpty():
        return sk, reps, None
    members = written(own.join(shared, "bucket").select("bucket", "id", "pivot"), "members")
    texts = written(docs.join(members.select("id").distinct(), "id", "left_semi"), "texts")
    pairs = members.filter("id != pivot").groupBy(F.col("id").alias("b")).agg(F.min("pivot").alias("a")).select("a", "b")
    labels = _joined(None, written(_linked(pairs, texts, shingle, percent), "links"))
    members = written(_mixed(_labelled(members.select("bucket", "id"), labels)), "open")
    if members.isEmpty():
        return sk, reps, labels
    facts = _facts(texts.join(members.select("id").distinct(), "id", "left_semi"), shingle)
    members = written(_open(members.join(facts, "id"), percent), "open")
    members = written(_open(members, percent), "open")
    if members.isEmpty():
        return sk, reps, labels
    texts = written(texts.join(members.select("id").distinct(), "id", "left_semi"), "texts")
    own = _labelled(facts, labels).join(sketches(texts, shingle, FINE_ROWS, FINE_BANDS).select("id", "bands"), "id")
    fine = written(own.select("id", "label", "n", "u", F.explode("bands").alias("bucket")).distinct(), "fine")
    near = written(_pivots(fine), "pivots")
    star = near.filter("label != p.label").select(F.col("p.id").alias("a"), F.col("id").alias("b"))
    labels = _joined(labels, written(_linked(star, texts, shingle, percent), "links"))
    cells = written(_labelled(_labelled(_cells(near), labels), labels, "pivot", "pivot_label"), "cells")
    if cells.filter("label != pivot_label").isEmpty():
        return sk, reps, labels
    return sk, reps, _joined(labels, written(_rest(cells, texts, shingle, percent), "links"))


def _rank(id_col: str, label_col: str, u: str, n: str):
    return F.struct((-F.col(u) / F.col(n)).alias("alone"), F.col(id_col).alias("id"), F.col(label_col).alias("label"))


def _pivots(members: DataFrame) -> DataFrame:
    """members(bucket, id, label, n, u) -> (p, id, label): each member beside the pivot p of its bucket, the member that
    shares most of its set, the likely origin of a group; of buckets with several labels."""
    buckets = members.groupBy("bucket").agg(F.min("label").alias("one"), F.max("label").alias("other"), F.min(_rank("id", "label", "u", "n")).alias("p")).filter("one < other")
    return members.join(buckets.select("bucket", "p"), "bucket").select("p", "id", "label").distinct()


def _cells(near: DataFrame) -> DataFrame:
    """_pivots() -> (pivot, id).  A pivot need not be a member of the bucket: where it is in other buckets too, the best of
    all their pivots stands for it, so that the many buckets of one neighbourhood share a pivot and a member is seldom
    under more than a few."""
    over = near.groupBy(F.col("id").alias("of")).agg(F.min("p").alias("q"))
    moved = near.join(over, F.col("p.id") == F.col("of")).select(F.col("q.id").alias("pivot"), "id")
    return moved.filter("id != pivot").distinct()


def _differences(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """pairs(a, b) -> a, b, na and n (sizes of their sets), delta (hashes of the shingles that one of both has)."""

    def run(batches):
        for batch in slices(slices(batches, "text_a", _SLICE), "text_b", _SLICE):
            size = batch.num_rows
            ra, va = shingles(batch.column("text_a"), shingle)
            rb, vb = shingles(batch.column("text_b"), shingle)
            row, value = np.concatenate([ra, rb]), np.concatenate([va, vb])
            order = np.lexsort((value, row))
            row, value = row[order], value[order]
            same = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
            alone = np.ones(len(row), bool)
            alone[1:] &= ~same
            alone[:-1] &= ~same
            at = np.concatenate([[0], np.cumsum(np.bincount(row[alone], minlength=size))])
            delta = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(value[alone].view(np.int64)))
            sizes = [pa.array(np.bincount(r, minlength=size).astype(np.int64)) for r in (ra, rb)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *sizes, delta], names=["a", "b", "na", "n", "delta"])

    a, b = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, na long, n long, delta array<long>")


def _rest(cells: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The links between different labels of cells(pivot, pivot_label, id, label) under one pivot, without comparing all
    with all.

    Let p be a pivot, delta(x) the shingles that either x or p has, d(x) their number and n(x) the size of x's set.  Two
    members differ in d(x) + d(y) - 2 c shingles, where c = |delta(x) & delta(y)|.  So, with f = (100 + percent) d -
    (100 - percent) n, they are linked if and only if 2 (100 + percent) c >= f(x) + f(y).  One of the two is not of p's
    label; if it isn't linked to p, that number is above 0, and a linked pair always shares part of delta.  Links to p
    itself are taken from d directly.

    As c <= d(y), x has partners only with f(y) >= f(x) - 2 (100 - percent) n(y), and none beyond n(x) 100 / percent;
    with the least f and largest n under the pivot that gives the c that x `needs` at least.  Now let each member order
    its delta from the commonest to the rarest and leave out the first needs - 1: whichever pair shares c of them still
    meets at the rarest.  Shingles that the same members have are one entry with a weight, so that an edit of many
    shingles counts once."""
    p = percent
    seen = written(_differences(cells.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), texts, shingle), "differences")
    d = F.size("delta").cast("long")
    direct = seen.filter((100 + p) * d <= (100 - p) * (F.col("na") + F.col("n"))).select("a", "b")
    own = cells.join(seen.withColumnsRenamed({"a": "pivot", "b": "id"}), ["pivot", "id"])
    own = own.select("pivot", "id", "label", (F.col("label") != F.col("pivot_label")).alias("apart"), "n", d.alias("d"), ((100 + p) * d - (100 - p) * F.col("n")).alias("f"), "delta")
    apart = lambda c: F.when(F.col("apart"), F.col(c))
    bounds = own.groupBy("pivot").agg(F.min("f").alias("low"), F.max("n").alias("high"), F.min(apart("f")).alias("low_apart"), F.max(apart("n")).alias("high_apart")).filter("low_apart is not null")
    own = own.join(bounds, "pivot")
    low, high = (F.when(F.col("apart"), F.col(c)).otherwise(F.col(f"{c}_apart")) for c in ("low", "high"))
    partner = F.greatest(low, F.col("f") - 2 * (100 - p) * F.least(high, F.floor(100 * F.col("n") / p)))
    own = own.withColumn("needs", F.greatest(F.lit(1), F.ceil((F.col("f") + partner) / (2 * (100 + p))))).filter("needs <= d")
    live = written(own.select("pivot", "id", F.struct("label", "apart", "n", "d", "f", "needs").alias("m"), "delta"), "live")
    each = live.select("pivot", "id", "m", F.explode("delta").alias("h"))
    index = each.groupBy("pivot", "h").agg(F.min("m.label").alias("one"), F.max("m.label").alias("other"), F.bit_xor(F.xxhash64("id")).alias("entry"), F.count("*").alias("common"))
    index = written(index.filter("one < other").select("pivot", "h", "entry", "common"), "index")
    entries = each.join(index, ["pivot", "h"]).groupBy("pivot", "id", "entry").agg(F.first("m").alias("m"), F.count("*").alias("w"), F.max("common").alias("common"))
    of = Window.partitionBy("pivot", "id")
    passed = F.sum("w").over(of.orderBy(F.desc("common"), "entry").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = written(entries.withColumn("passed", passed).withColumn("whole", F.sum("w").over(of)).filter("whole >= m.needs and passed >= m.needs").select("pivot", "entry", "id", "m"), "prefixes")
    x, y = (kept.select("pivot", "entry", F.col("id").alias(f"id_{c}"), F.col("m").alias(c)) for c in "xy")
    once = (F.col("x.label") != F.col("y.label")) & (~F.col("y.apart") | (F.col("id_x") < F.col("id_y")))
    reach = (F.col("x.f") + F.col("y.f") <= 2 * (100 + p) * F.least("x.d", "y.d")) & (p * F.greatest("x.n", "y.n") <= 100 * F.least("x.n", "y.n"))
    met = x.filter("x.apart").join(y, ["pivot", "entry"]).filter(once & reach)
    pairs = met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()
    return _linked(pairs, texts, shingle, percent).unionByName(direct)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row for each document: id, n_shingles, component (the smallest id of its group)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sk, reps, labels = _classes(rows, shingle, percent)
    out = sk.select("id", "n_shingles", "hi", "lo").join(reps, ["hi", "lo"], "left")
    out = out.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "id")).otherwise(F.col("id")).alias("rep"))
    if labels is not None:
        out = out.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("id", "n_shingles", F.coalesce("component", "rep").alias("rep"))
    return out.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("rep")).alias("component"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates (five-word shingles, 0.8) the smallest id stays."""
    own = fresh(docs, "gone")
    gone = near_duplicates(docs).filter("id != component").select(F.col("id").alias(own)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(own), "left_anti")
