"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is cut into pieces of up to PIECE code points, anew at each word and at each change between digits and other
characters, so that an edit shifts pieces up to the next of these only.  In scripts without blanks between words each
code point is a piece, so that an edit shifts none.  A k-mer is K consecutive pieces, an s-mer S of them.  A k-mer is a
closed syncmer, and an anchor, if the least hash among its s-mers is that of its first or its last one.  That depends on
the k-mer alone, not on what stands around it: any k-mer that two texts share is an anchor of both or of neither, and
about 2 in K - S + 1 k-mers are.  A text without a closed syncmer, which can have 11 pieces at most, has the k-mer of
least hash as its only anchor; one of fewer than K pieces, but not none, its whole sequence.  So only a text without
pieces has no anchor.

Anchors come as (position in pieces, hash), in order.  A fingerprint is the set of the anchors' hashes; likeness is
intersection over union, 1 for two empty sets.

Each text's neighbour in id order is found without a global sort: quantiles of the id cut the rows into ranges, each
range is one window, and the last row of each range is also given to the next one.

Defined results: null text counts as empty, whose fingerprint is empty; rows with equal ids stand in order of their
texts; rows without an id come before all others; a single row is its own neighbour; other columns are not looked
at."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm._shared import table

PIECE, K, S = 4, 8, 3
_UNSPACED = "".join(rf"\p{{Is{x}}}" for x in ("Han", "Hiragana", "Katakana", "Bopomofo", "Yi", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan"))
RANGES_PER_PARTITION = 8


def let(value: Column, body) -> Column:
    """body(x) with x computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"[^\s0-9{_UNSPACED}]{{1,{PIECE}}}|[0-9]{{1,{PIECE}}}|[{_UNSPACED}]"), F.lit(0))


def _anchors(sm: Column, n: Column, least: bool) -> Column:
    """sm: hashes of the s-mers; n: number of k-mers, at least 1; least: the k-mer of least hash where no other is
    picked."""
    last = K - S

    def chosen(i):
        edge = F.least(F.get(sm, i), F.get(sm, i + last))
        return edge <= F.least(*[F.get(sm, i + j) for j in range(1, last)])

    every = F.sequence(F.lit(0), n - 1)
    inner = [*range(0, last, S), last]
    h = lambda i: F.hash(*[F.get(sm, i + j) for j in inner])
    anchor = lambda i, h: F.struct(i.alias("at"), h.alias("h"))
    found = lambda picked: F.transform(picked, lambda i: anchor(i, h(i)))
    if not least:
        return found(F.filter(every, chosen))
    one = let(F.array_min(F.transform(every, lambda i: F.struct(h(i).alias("h"), i.alias("at")))), lambda x: F.array(anchor(x["at"], x["h"])))
    return let(F.filter(every, chosen), lambda picked: F.when(F.size(picked) > 0, found(picked)).otherwise(one))


def syncmers(text: Column, least: bool = False) -> Column:
    """array<struct<at int, h int>> of a text without nulls: its closed syncmers, or the whole of a shorter text."""
    none = F.array().cast("array<struct<at:int,h:int>>")

    def of(h):
        smers = F.transform(F.sequence(F.lit(0), F.size(h) - S), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(S)]))
        whole = F.array(F.struct(F.lit(0).alias("at"), F.hash(h).alias("h")))
        return F.when(F.size(h) >= K, let(smers, lambda sm: _anchors(sm, F.size(h) - (K - 1), least))).when(F.size(h) > 0, whole).otherwise(none)

    return let(F.transform(pieces(text), lambda x: F.xxhash64(x)), of)


def anchors(text: Column) -> Column:
    """syncmers(), and the k-mer of least hash where there are none."""
    return syncmers(text, least=True)


def hashes(anchors: Column) -> Column:
    return F.array_distinct(F.transform(anchors, lambda a: a["h"]))


def likeness(a: Column, b: Column) -> Column:
    """Of two sets of hashes, 0 to 1."""

    def of(both):
        union = F.size(a) + F.size(b) - both
        return F.when(union == 0, F.lit(1.0)).otherwise(both / union)

    return let(F.size(F.array_intersect(a, b)), of)


def written_out(found: Column) -> Column:
    """Hashes as a string: signed decimal numbers in the order in which they are first met, joined by blanks."""
    return F.array_join(found.cast("array<string>"), " ")


def shared_anchors(a: Column, b: Column) -> Column:
    """Positional matching: (hash, position in a, position in b) of every pair of equal anchors that are the only ones
    of their hash in either text."""
    once = lambda x: F.map_from_entries(F.transform(F.array_distinct(F.transform(x, lambda y: y["h"])), lambda h: F.struct(h, F.filter(x, lambda y: y["h"] == h))))
    common = F.array_intersect(hashes(a), hashes(b))
    return let(
        once(a),
        lambda ma: let(
            once(b),
            lambda mb: F.transform(
                F.filter(common, lambda h: (F.size(ma[h]) == 1) & (F.size(mb[h]) == 1)),
                lambda h: F.struct(h.alias("h"), F.get(ma[h], F.lit(0))["at"].alias("a"), F.get(mb[h], F.lit(0))["at"].alias("b")),
            ),
        ),
    )


def _range_ends(ids: DataFrame, n: int) -> list[int]:
    """Ids that end ranges of about equal numbers of rows; the last is the greatest id."""
    found = ids.agg(F.percentile_approx("id", [(i + 1) / n for i in range(n)], 20 * n).alias("q"), F.max("id").alias("top")).first()
    return sorted({*(found["q"] or []), *([found["top"]] if found["top"] is not None else [])})


def _constant(values: list) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<array<bigint>>")


def _range_of(ends: list[int], col: str) -> Column:
    """The number of ends below the id, looked up in two steps."""
    wide = max(1, math.isqrt(len(ends)))
    groups = [ends[i : i + wide] for i in range(0, len(ends), wide)]
    tops = F.get(_constant([[g[-1] for g in groups]]), F.lit(0))
    below = lambda some: F.size(F.filter(some, lambda v: v < F.col(col)))
    return let(below(tops), lambda g: g * wide + F.when(g < len(groups), below(F.get(_constant(groups), g))).otherwise(0))


def with_next(rows: DataFrame, carried: Column, name: str = "next") -> DataFrame:
    """rows(id, text), `carried` and `name`: the carried value of the next row in descending order of (id, text); after
    the last the first."""
    spark = rows.sparkSession
    n = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = _range_ends(rows.select("id"), n)
    if not ends:
        only = Window.orderBy("text")  # rows without any id
        return rows.withColumn("carried", carried).withColumn(name, F.coalesce(F.lag("carried").over(only), F.last("carried").over(only.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    place = F.when(F.col("id").isNull(), F.lit(0)).otherwise(_range_of(ends, "id"))
    ended = F.col("id") == F.get(F.get(_constant([ends]), F.lit(0)), F.col("range"))
    own = F.struct(F.col("range"), F.lit(1).alias("own"))
    after = F.struct(((F.col("range") + 1) % len(ends)).alias("range"), F.lit(0).alias("own"))
    placed = rows.withColumn("range", place).select("id", "text", F.explode(F.when(ended, F.array(own, after)).otherwise(F.array(own))).alias("p"))
    placed = placed.select("id", "text", "p.range", "p.own").repartition("range").withColumn("carried", carried)
    order = Window.partitionBy("range").orderBy("own", "id", "text")
    return placed.withColumn(name, F.lag("carried").over(order)).filter("own = 1").drop("range", "own")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, anchors (position, hash)."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("anchors", anchors(F.col("text")))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    found = with_next(rows, F.struct(F.col("text"), hashes(anchors(F.col("text"))).alias("f")))
    edited = F.expr("concat(left(text, length(text) - cast(floor(length(text) / 3) as int)), left(next.text, cast(floor(length(text) / 3) as int)))")
    found = found.withColumn("edited", edited).withColumn("e", hashes(anchors(F.col("edited"))))
    own, other = F.col("carried.f"), F.col("next.f")
    return found.select(
        F.col("id").alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written_out(own).alias("fingerprint"),
        written_out(F.col("e")).alias("edited_fingerprint"),
        likeness(own, F.col("e")).alias("near_edited"),
        likeness(own, other).alias("near_next"),
    )
