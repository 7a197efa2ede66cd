"""Cross-site line dedup, in DataFrame functions only: a line that stands on many sites is boilerplate.

Lines are cut at \\n and stripped of blanks, tabs and carriage returns; empty ones don't count.  For each line's hash
the sites are gathered in a HyperLogLog sketch; sketches are built before the shuffle and merged by aggregation, so that
a line of any frequency reaches its task as one sketch a partition.  Where the estimate is clearly above or below the
threshold it decides; within BAND of it the distinct sites are counted exactly.  Lines of at least `min_sites` sites
are then cut from the documents.

Left whole are only the proven copies, which are for near-duplicate removal to deal with: documents whose whole text
stands on min_sites sites or more, counted like a line.

Defined results: null text has no lines and stays null; a null site is one site of its own; rows that share id and
text get the same result; a document keeps its other lines as they are, also its empty ones; other columns are not
looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._shared import fresh, table, written

MIN_SITES = 10
#: Sketch precision: 2**12 registers, a standard error of 1.6 %; BAND is over ten times that.
LG_K, BAND = 12, 0.2
_BLANKS = " \t\r"


def lines(rows: DataFrame) -> DataFrame:
    """rows(id, text, site) -> id, th, site, no, h and g (96 bits of hash) of each line that isn't empty."""
    every = rows.select("id", F.xxhash64("text").alias("th"), F.coalesce("site", F.lit("")).alias("site"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    line = F.btrim("line", F.lit(_BLANKS))
    return every.filter(F.length(line) > 0).select("id", "th", "site", "no", F.xxhash64(line).alias("h"), F.hash(line).alias("g"))


def boilerplate(found: DataFrame, min_sites: int) -> DataFrame:
    """lines() -> (h, g) of lines on at least min_sites sites."""
    sketches = found.groupBy("h", "g").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("s"))
    counted = sketches.select("h", "g", F.hll_sketch_estimate("s").alias("n")).filter(F.col("n") >= int(min_sites * (1 - BAND)))
    counted = written(counted, "line-sites")
    sure = counted.filter(F.col("n") > min_sites * (1 + BAND)).select("h", "g")
    near = counted.filter(F.col("n") <= min_sites * (1 + BAND)).select("h", "g")
    exact = found.select("h", "g", "site").join(near, ["h", "g"]).distinct().groupBy("h", "g").agg(F.count("*").alias("n"))
    return written(sure.unionByName(exact.filter(F.col("n") >= min_sites).select("h", "g")), "boilerplate")


def cuts(rows: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """rows(id, text, site) -> id, th, gone (numbers of the lines that are boilerplate), for documents that have some."""
    found = lines(rows)
    hit = found.join(boilerplate(found, min_sites), ["h", "g"])
    return hit.select("id", "th", "no").distinct().groupBy("id", "th").agg(F.collect_list("no").alias("gone"))


def copies(rows: DataFrame, min_sites: int) -> DataFrame:
    """rows(id, text, site) -> (h, g) of whole texts on at least min_sites sites."""
    return boilerplate(rows.select(F.coalesce("site", F.lit("")).alias("site"), F.xxhash64("text").alias("h"), F.hash("text").alias("g")), min_sites)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, names: tuple[str, ...] = ("__text", "__n_lines", "__n_removed", "__whole")) -> DataFrame:
    """docs and, under `names`, the text without boilerplate, the number of its lines, that of the lines removed, and
    whether it was left whole though it has boilerplate."""
    new_text, n_lines, n_removed, whole = names
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(site_col).cast("string").alias("site"))
    rows = rows.filter(F.col("text").isNotNull())
    own, other, same_id, th, gone, h, g = fresh(docs, "own_hash", "own_other_hash", "cut_id", "cut_hash", "cut_lines", "copy_hash", "copy_other_hash")
    text = F.col(text_col).cast("string")
    out = docs.withColumns({own: F.xxhash64(text), other: F.hash(text)})
    found = cuts(rows, min_sites).select(F.col("id").alias(same_id), F.col("th").alias(th), F.col("gone").alias(gone))
    out = out.join(found, (F.col(own) == F.col(th)) & F.col(id_col).eqNullSafe(F.col(same_id)), "left")
    spread = copies(rows, min_sites).select(F.col("h").alias(h), F.col("g").alias(g))
    out = out.join(spread, (F.col(own) == F.col(h)) & (F.col(other) == F.col(g)), "left")
    left = F.col(gone).isNotNull() & F.col(h).isNotNull()
    cut = F.col(gone).isNotNull() & ~left
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    lines_of = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.btrim(x, F.lit(_BLANKS))) > 0))
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.when(cut, kept).otherwise(text).alias(new_text),
        lines_of.cast("long").alias(n_lines),
        F.when(cut, F.size(gone)).otherwise(0).cast("long").alias(n_removed),
        left.alias(whole),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.col("__whole").alias("left_whole"), F.sha2(F.coalesce("__text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = f"""
WITH rows AS (SELECT doc_id, text, coalesce(source, '') AS site FROM documents),
lines AS (
  SELECT doc_id, site, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS no
  FROM rows WHERE text IS NOT NULL
),
stripped AS (SELECT doc_id, site, no, raw, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM lines),
common AS (SELECT line FROM stripped WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
copies AS (SELECT text FROM rows WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT site) >= {MIN_SITES}),
marked AS (SELECT s.*, c.line IS NOT NULL AS gone FROM stripped s LEFT JOIN common c USING (line)),
cut AS (
  SELECT doc_id, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (gone) AS n, coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (NOT gone), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT r.doc_id, coalesce(c.n_lines, 0)::BIGINT AS n_lines, CASE WHEN p.text IS NULL THEN coalesce(c.n, 0) ELSE 0 END::BIGINT AS n_removed,
  p.text IS NOT NULL AND coalesce(c.n, 0) > 0 AS left_whole, sha256(CASE WHEN p.text IS NULL THEN coalesce(c.kept, '') ELSE r.text END) AS kept_sha256
FROM rows r LEFT JOIN cut c USING (doc_id) LEFT JOIN copies p ON r.text = p.text
"""


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, without the lines that are boilerplate unless it is proven to be a copy;
    n_chars follows."""
    names = fresh(docs, "text_left", "n_lines", "n_removed", "left_whole")
    found = line_dedup(docs, names=tuple(names))
    text, _, removed, _ = (F.col(c) for c in names)
    new = {"text": text.alias("text"), "n_chars": F.when(removed > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars")}
    return found.select(*[new.get(c, F.col(f"`{c}`")) for c in docs.columns])
