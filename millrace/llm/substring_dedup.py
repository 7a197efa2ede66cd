"""Substring dedup by level-wise doubling: windows of words that are repeated at one length alone are extended to twice
that length, until no candidates survive or the wanted width is reached.

A word is a run of `[^\\x20\\x09-\\x0D]`.  A word goes if a window of `width` words covers it whose word sequence also
starts in a document with a smaller id; windows are judged on the input.

1. One pass takes the words of each text, a 128-bit digest of their sequence, and anchors: of the width - seed + 1
   windows of `seed` words inside each window of `width` words the one of least hash.  Which one that is depends on the
   words alone, so two equal windows have the same anchor, and about 2 in width - seed + 2 windows are anchors.
2. Documents with equal word sequences are one class.  All but the smallest id lose every word (if they have a window
   at all) and need not be looked at again; the smallest stands for the class.
3. Anchors that occur in one document only go.  The windows of twice the length that contain a remaining anchor are the
   candidates of the next level; those in one document only go, and so on, until no candidates survive.  At `width` each
   candidate's smallest document decides.  Every window of `width` words contains, level by level, a window of the level
   below that contains its anchor, and all of these are repeated where it is.

Groups are counted by partial aggregation and joined back as plain equi-joins, which Spark splits when skewed.  A
window is known by 96 bits of hash.

Defined results: null text has no words; a null id compares with nothing, so that its row keeps all and takes nothing
from others; rows that share an id are compared by id only (never smaller); other columns are not looked at."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _words
from millrace.llm._shared import slices, table, written

WIDTH = 50
#: The first level's windows have this many words at most, and more than half of it.
SEED = 16
_SALT = 0x5851F42D4C957F2D
#: Rows of windows, and bytes of text, that are unfolded at a time.
_ROWS, _SLICE = 1 << 13, 1 << 19
_BLANKS = bytes(32 if 9 <= c <= 13 else c for c in range(256))


def lengths(width: int) -> list[int]:
    """The levels: the width and its halves (rounded up) down to SEED at most, in rising order."""
    out = [width, (width + 1) // 2]
    while out[-1] > SEED:
        out.append((out[-1] + 1) // 2)
    return out[::-1]


def _anchors(w: _words.Words, seed: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors among all words, and all windows' hashes."""
    runs, _ = w.runs(seed)
    n = len(w.row) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), runs
    inside = w.row[:n] == w.row[width - 1 :]
    view = np.lib.stride_tricks.sliding_window_view(runs, width - seed + 1)[:n]
    least = np.concatenate([view[i : i + _ROWS].argmin(axis=1) for i in range(0, n, _ROWS)])  # argmin copies its rows
    return np.unique((np.arange(n) + least)[inside]), runs


def profiles(rows: DataFrame, seed: int, width: int) -> DataFrame:
    """rows(id, th, text) -> id, th, n_words, sha256 (of the words joined by a space), hi, lo (digest of the word
    sequence), anchors (hash, position)."""
    pair = pa.struct([("h", pa.int64()), ("at", pa.int32())])

    def run(batches):
        for batch in slices(batches, limit=_SLICE):
            n = batch.num_rows
            w = _words.words(batch.column("text"))
            at, runs = _anchors(w, seed, width)
            row = w.row[at]
            both = pa.StructArray.from_arrays([pa.array(runs[at].view(np.int64)), pa.array((at - w.first[row]).astype(np.int32))], fields=list(pair))
            cut = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
            shas = []
            for t in batch.column("text").to_pylist():
                own = (t or "").encode().translate(_BLANKS).split(b" ")
                shas.append(hashlib.sha256(b" ".join(filter(None, own))).hexdigest())
            digest = [bytes.fromhex(s) for s in shas]
            whole = np.frombuffer(b"".join(digest), "<i8").reshape(n, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("th"), pa.array(np.diff(w.first).astype(np.int64)), pa.array(shas, pa.string()), pa.array(whole[:, 0].copy()), pa.array(whole[:, 1].copy()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), both)],
                names=["id", "th", "n_words", "sha256", "hi", "lo", "anchors"],
            )

    return rows.mapInArrow(run, "id long, th long, n_words long, sha256 string, hi long, lo long, anchors array<struct<h:long,at:int>>")


def _longer(texts: DataFrame, shorter: int, longer: int) -> DataFrame:
    """texts(id, th, text, found: positions of windows of `shorter` words) -> the windows of `longer` words that hold
    one of them: id, th, windows (hash, second hash, position)."""
    triple = pa.struct([("h", pa.int64()), ("g", pa.int32()), ("at", pa.int32())])

    def run(batches):
        for batch in slices(batches, limit=_SLICE):
            n = batch.num_rows
            w = _words.words(batch.column("text"))
            runs, inside = w.runs(longer)
            second, _ = w.runs(longer, _SALT)
            found = batch.column("found")
            of = np.repeat(np.arange(n), pc.list_value_length(found).to_numpy(zero_copy_only=False))
            at = found.flatten().to_numpy(zero_copy_only=False) + w.first[of]
            step = np.zeros(len(w.row) + 2, np.int64)
            np.add.at(step, np.maximum(at - (longer - shorter), w.first[of]), 1)
            np.add.at(step, at + 1, -1)
            starts = np.flatnonzero((np.cumsum(step)[: len(runs)] > 0) & inside)
            row = w.row[starts]
            both = pa.StructArray.from_arrays([pa.array(runs[starts].view(np.int64)), pa.array((second[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array((starts - w.first[row]).astype(np.int32))], fields=list(triple))
            cut = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), both)], names=["id", "th", "windows"])

    return texts.mapInArrow(run, "id long, th long, windows array<struct<h:long,g:int,at:int>>")


def _without(texts: DataFrame, width: int) -> DataFrame:
    """texts(id, th, text, found: positions of windows that go) -> id, th, n_removed, kept (words joined by a space),
    ranges of words that went."""
    pairs = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in slices(batches, limit=_SLICE):
            w = _words.words(batch.column("text"))
            kept, removed, ranges = [], [], []
            for i, found in enumerate(batch.column("found").to_pylist()):
                first, n = w.first[i], w.first[i + 1] - w.first[i]
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, found, 1)
                np.add.at(step, np.minimum(np.array(found) + width, n), -1)
                gone = np.cumsum(step)[:n] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                ranges.append([{"first": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
                stay = first + np.flatnonzero(~gone)
                kept.append(b" ".join(w.data[a:b].tobytes() for a, b in zip(w.start[stay], w.end[stay])).decode())
                removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(ranges, pairs)], names=["id", "th", "n_removed", "kept", "ranges"])

    return texts.mapInArrow(run, "id long, th long, n_removed long, kept string, ranges array<struct<first:long,end:long>>")


def _collected(windows: DataFrame) -> DataFrame:
    """The positions of one document's windows."""
    return windows.groupBy("id", "th").agg(F.collect_list("at").alias("found"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row for each document: id, n_words, n_removed, sha256 of the kept words joined by a space; kept and ranges
    (of removed words) where some words go and some may stay, else null: all stay, or the row copies a smaller id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    level, *longer = lengths(width)
    seen = written(profiles(rows, level, width), "profiles")
    classes = written(seen.filter((F.col("n_words") >= width) & F.col("id").isNotNull()).groupBy("hi", "lo").agg(F.min("id").alias("rep")), "classes")
    own = seen.filter(F.size("anchors") > 0).join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    windows = own.select("id", "th", F.explode("anchors").alias("w")).select("id", "th", "w.h", F.lit(0).alias("g"), "w.at")
    texts = rows
    for more in [*longer, 0]:
        groups = windows.groupBy("h", "g").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
        groups = written(groups.select("h", "g", "low"), "repeated")
        windows = windows.join(groups, ["h", "g"])
        if not more or groups.isEmpty():
            break
        texts = written(rows.join(_collected(windows), ["id", "th"]) if texts is rows else texts.drop("found").join(_collected(windows), ["id", "th"]), "candidates")
        found = written(_longer(texts, level, more), "windows")
        windows = found.select("id", "th", F.explode("windows").alias("w")).select("id", "th", "w.h", "w.g", "w.at")
        level = more
    gone = _without(texts.drop("found").join(_collected(windows.filter("low < id")), ["id", "th"]), width)
    gone = gone.groupBy("id", "th").agg(F.first("n_removed").alias("n_removed"), F.first("kept").alias("kept"), F.first("ranges").alias("ranges"))
    out = seen.drop("anchors").join(classes, ["hi", "lo"], "left").join(gone, ["id", "th"], "left")
    copy = F.coalesce(F.col("rep") < F.col("id"), F.lit(False))
    return out.select(
        "id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).when(F.col("kept").isNotNull(), F.sha2(F.col("kept").cast("binary"), 256)).otherwise(F.col("sha256")).alias("sha256"),
        F.when(~copy, F.col("kept")).alias("kept"),
        F.when(~copy, F.col("ranges")).alias("ranges"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("sha256").alias("kept_sha256"))
