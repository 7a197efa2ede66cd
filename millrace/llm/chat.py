"""Chat formatting into budgeted windows, in DataFrame functions only.

The template writes a turn as

    <turn role="R" again="0">text</turn>\\n

In texts and roles `\\` becomes `\\b` and `<` becomes `\\l` (in roles `"` also becomes `\\q`), so that no text can hold a
mark, and reading back undoes it exactly.  Control strings of other templates are ordinary text.

Windows.  A turn costs its pieces of up to PIECE code points that are no blanks, and MARK for the marks.  Prefix sums
of the turns' costs place the turns in spans: with `half` = half of what the budget leaves beside the system turn and
the history, a turn that costs at most `half` goes to the span of number floor(prefix / half), where such turns cost
less than twice `half` together; a dearer one is a span of its own, and exceeds the budget only if it does so
alone.  Spans follow the turns' order and no turn is cut.  Each window has the system turn (the first turn, if its role
is system), then the turns of the last `history` tokens before the span, then the span.  What an earlier window had
already is marked again="1" and is outside the loss; the loss covers the texts of assistant turns otherwise, so that
each is learned once.

Prefix sums are taken in two steps, over blocks of BLOCK turns and within them, and history is found by a join on
stretches of `history` tokens, so that no task holds a conversation; windows are bounded by the budget.

Defined results: null text or role is empty; null turns come first; rows without conv_id are one conversation; equal
turns stand in order of role and text; an empty table gives no windows; other columns are not looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm._shared import table, written

BUDGET, HISTORY, PIECE, MARK, BLOCK = 1024, 128, 5, 4, 1024
_NO_ID = -(1 << 63)
_TURN = r'<turn role="([^"<]*)" again="([01])">([^<]*)</turn>\n'


def _replaced(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escaped(text: Column) -> Column:
    return _replaced(text, ("\\", "\\b"), ("<", "\\l"))


def unescaped(text: Column) -> Column:
    return _replaced(text, ("\\l", "<"), ("\\b", "\\"))


def escaped_role(role: Column) -> Column:
    return _replaced(escaped(role), ('"', "\\q"))


def unescaped_role(role: Column) -> Column:
    return _replaced(role, ("\\q", '"'), ("\\l", "<"), ("\\b", "\\"))


def cost(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(rf"\S{{1,{PIECE}}}"), F.lit(0))).cast("long") + MARK


def placed(conversations: DataFrame, budget: int, history: int) -> DataFrame:
    """c, idx (from 1), role, text, system (whether it is the retained turn), q (tokens before it), span."""
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(_NO_ID)).alias("c"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("cost", cost(F.col("text"))).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(_NO_ID)))
    blocks = rows.groupBy("c", "block").agg(F.sum("cost").alias("sum"), F.count("*").alias("n"), F.min(F.struct(F.coalesce("turn", F.lit(_NO_ID)).alias("turn"), F.col("role"), F.col("text"), F.col("cost"))).alias("first"))
    order = Window.partitionBy("c").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    top = F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = blocks.select("c", "block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("sum_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), top.alias("top"))
    blocks = blocks.withColumn("kept", F.when(F.col("top.role") == "system", F.col("top.cost")).otherwise(0).cast("long")).drop("top")
    within = Window.partitionBy("c", "block").orderBy(F.coalesce("turn", F.lit(_NO_ID)), "role", "text")
    rows = rows.join(blocks, ["c", "block"])
    rows = rows.withColumn("idx", F.col("n_before") + F.row_number().over(within))
    rows = rows.withColumn("sum", F.col("sum_before") + F.coalesce(F.sum("cost").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    half = F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.col("kept")) / 2))
    rows = rows.withColumn("system", (F.col("idx") == 1) & (F.col("kept") > 0)).withColumn("q", F.greatest(F.lit(0), F.col("sum") - F.col("kept")))
    span = 2 * F.floor(F.col("q") / half) + (F.col("cost") > half).cast("long")
    return rows.select("c", "idx", "role", "text", "system", "q", "cost", span.alias("span"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window (in order), formatted, loss (spans [start, end) of code points of formatted), n_tokens."""
    turns = written(placed(conversations, budget, history), "turns")
    own = turns.filter("not system")
    starts = own.groupBy("c", "span").agg(F.min("q").alias("q0"), F.min("idx").alias("idx0"))
    alone = turns.filter("system").join(own.select("c").distinct(), "c", "left_anti").select("c", F.lit(0).cast("long").alias("span"), F.lit(0).cast("long").alias("q0"), F.lit(1).cast("long").alias("idx0"))
    starts = written(starts.unionByName(alone), "spans")
    again = starts.groupBy("c").agg(F.min("span").alias("head"))
    stretch = lambda c: F.floor(F.col(c) / max(1, history))
    near = own.withColumn("at", F.explode(F.array(stretch("q"), stretch("q") + 1)))
    late = starts.filter("idx0 > 1").select("c", F.col("span").alias("to"), "q0", "idx0", stretch("q0").alias("at"))
    repeated = near.join(late, ["c", "at"]).filter((F.col("idx") < F.col("idx0")) & (F.col("q0") - F.col("q") <= history))
    repeated = repeated.select("c", F.col("to").alias("span"), "idx", "role", "text", "cost", F.lit(True).alias("again"))
    system = turns.filter("system").select("c", F.lit(0).cast("long").alias("idx"), "role", "text", "cost").join(starts.select("c", "span"), "c").join(again, "c")
    system = system.select("c", "span", "idx", "role", "text", "cost", (F.col("span") != F.col("head")).alias("again"))
    every = own.select("c", "span", "idx", "role", "text", "cost", F.lit(False).alias("again")).unionByName(repeated).unionByName(system)
    head = F.concat(F.lit('<turn role="'), escaped_role(F.col("role")), F.lit('" again="'), F.col("again").cast("int").cast("string"), F.lit('">'))
    part = F.struct("idx", head.alias("head"), escaped(F.col("text")).alias("body"), ((F.col("role") == "assistant") & ~F.col("again")).alias("loss"))
    made = every.groupBy("c", "span").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.sum("cost").alias("n_tokens"))
    end = "</turn>\n"
    zero = F.expr("named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,end:int>>))")

    def step(s, p):
        start = s["at"] + F.length(p["head"])
        stop = start + F.length(p["body"])
        return F.struct((stop + len(end)).alias("at"), F.when(p["loss"], F.concat(s["spans"], F.array(F.struct(start.alias("start"), stop.alias("end"))))).otherwise(s["spans"]).alias("spans"))

    return made.select(
        F.nullif(F.col("c"), F.lit(_NO_ID)).alias("conv_id"),
        F.col("span").alias("window"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(end))), "").alias("formatted"),
        F.aggregate("parts", zero, step, lambda s: s["spans"]).alias("loss"),
        "n_tokens",
    )


def read_back(found: DataFrame) -> DataFrame:
    """windows() -> conv_id, window, n_turns, turns (role, \\n, text, \\n of each turn that isn't repeated), loss_text, n_chars."""
    group = lambda i: F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(i))
    read = found.withColumn("t", F.arrays_zip(group(1).alias("role"), group(2).alias("again"), group(3).alias("body")))
    fresh = F.filter("t", lambda x: x["again"] == "0")
    plain = F.transform(fresh, lambda x: F.concat(unescaped_role(x["role"]), F.lit("\n"), unescaped(x["body"]), F.lit("\n")))
    learned = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return read.select("conv_id", "window", F.size(fresh).alias("n_turns"), F.array_join(plain, "").alias("turns"), F.array_join(learned, "").alias("loss_text"), F.length("formatted").alias("n_chars"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    read = read_back(windows(given.unionByName(extra)))
    whole = read.groupBy("conv_id").agg(
        F.sum("n_turns").cast("long").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("window", "turns", "loss_text"))).alias("w"),  # the digest needs a conversation's text in one value
        F.sum("n_chars").cast("long").alias("formatted_chars"),
    )
    turns = F.array_join(F.transform("w", lambda x: x["turns"]), "")
    whole = whole.withColumn("loss", F.array_join(F.transform("w", lambda x: x["loss_text"]), ""))
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
