"""Chat formatting in token-budgeted windows, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.llm.workspace import materialise

#: Tokens of a window without its system turn, and those of them that repeated history may take.
WINDOW_TOKENS = 512
HISTORY_TOKENS = 128
#: Turn numbers that share a block of the two-level prefix sums.
BLOCK_TURNS = 64
#: Tokens that the marks of a turn count for.
TURN_TOKENS = 2

# A turn is "<|new|role|>text<|end|>"; repeated turns are marked "old" instead of "new".
OPEN, CLOSE, END = "<|", "|>", "<|end|>"


def escaped(text: Column) -> Column:
    """A backslash before every backslash and bar, so that no text can hold a mark."""
    return F.regexp_replace(text, r"[\\|]", r"\\$0")


def unescaped(text: Column) -> Column:
    """The text that ``escaped`` was given."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens(text: Column) -> Column:
    """Words and single marks of a text, the measure of the budget."""
    return (F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) + TURN_TOKENS).cast("long")


def _prefixed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``before``, the tokens of a conversation's earlier turns.

    Sums run inside blocks of turn numbers and over the blocks' totals, so that
    no task orders a whole conversation's texts, however long it is. Rows that
    are wholly equal may stand in either order, as their sums are then the same.
    """
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    inner = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "block").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"))
    totals = totals.select(
        F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("base"), F.coalesce(F.sum("m").over(outer), F.lit(0)).alias("rank_base")
    )
    own = rows.withColumn("own", F.coalesce(F.sum("n").over(inner), F.lit(0))).withColumn("own_rank", F.coalesce(F.count(F.lit(1)).over(inner), F.lit(0)))
    joined = own.join(totals, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("block").eqNullSafe(F.col("_b")))
    return joined.withColumn("before", F.col("base") + F.col("own")).withColumn("rank", F.col("rank_base") + F.col("own_rank")).drop("_c", "_b", "base", "rank_base", "own", "own_rank", "block")


def format_windows(conversations: DataFrame, window_tokens: int = WINDOW_TOKENS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """(conv_id, window, formatted, loss_spans, n_tokens), one row for each window.

    Input columns: conv_id, turn, role, text. The budget without its history is
    two strides. A turn is new in the window of the stride that its prefix sum
    falls in, so windows are turn-aligned and each turn is new once; a turn of
    more than a stride that reaches beyond its stride has a window of its own.
    So new turns and history keep to ``window_tokens`` together, but for a turn
    that alone is larger. A window repeats the conversation's first system turn
    and the turns of at most ``history_tokens`` (a third of the budget at most)
    before it. ``loss_spans`` are half-open code point ranges of ``formatted``:
    the texts of new assistant turns; repeated ones are masked.

    Null texts and roles are empty; a null turn comes first; turns that tie are
    ordered by role and text; repeated rows are all kept; rows with a null
    conv_id form one conversation. Other columns are not looked at.
    """
    history = min(history_tokens, window_tokens // 3)
    stride = max(1, (window_tokens - history) // 2)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    at = F.floor(F.col("before") / stride)
    alone = (F.col("n") > stride) & (F.floor((F.col("before") + F.col("n") - 1) / stride) != at)
    # written once, as five branches below read it; those without texts read only the columns that they need
    turns = materialise(_prefixed(rows.withColumn("n", tokens("text"))).withColumn("window", 2 * at + alone.cast("long")))
    system = turns.where("role = 'system'").groupBy("conv_id").agg(F.min_by(F.struct("text", "rank", "window", "n"), "rank").alias("sys"))
    begins = turns.groupBy("conv_id", "window").agg(F.min("before").alias("begin"), F.min("rank").alias("first"))
    begins = begins.select(F.col("conv_id").alias("_c"), F.col("window").alias("_w"), "begin", "first")
    begins = begins.join(system.select(F.col("conv_id").alias("_s"), F.col("sys.rank").alias("sys_rank")), F.col("_c").eqNullSafe(F.col("_s")), "left").drop("_s")
    same = F.col("conv_id").eqNullSafe(F.col("_c"))
    part = lambda fresh: F.struct("rank", F.struct(F.lit(fresh).alias("fresh"), "role", "text", "n").alias("t")).alias("part")
    new = turns.select("conv_id", "window", part(1))
    # history reaches back a stride at most, so it is that of windows of the same or the next stride
    later = F.explode(F.sequence(F.col("window") + 1, 2 * F.floor(F.col("window") / 2) + 3))
    old = turns.withColumn("later", later).join(begins, same & (F.col("later") == F.col("_w"))).where(F.col("begin") - F.col("before") <= history)
    # a system turn that is history as well stands once in a window, as the system turn
    old = old.where(~F.col("rank").eqNullSafe(F.col("sys_rank"))).select("conv_id", F.col("_w").alias("window"), part(0))
    kept = begins.join(system.select(F.col("conv_id").alias("_s"), "sys"), F.col("_c").eqNullSafe(F.col("_s"))).where(F.col("sys_rank") < F.col("first"))
    kept = kept.select(F.col("_c").alias("conv_id"), F.col("_w").alias("window"), F.col("sys.rank").alias("rank"), F.lit("system").alias("role"), F.col("sys.text").alias("text"), F.col("sys.n").alias("n"))
    parts = new.union(old).union(kept.select("conv_id", "window", part(-1)))
    listed = parts.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("part")).alias("turns"))
    head = lambda x: F.concat(F.lit(OPEN), F.when(x["t"]["fresh"] == 1, "new").otherwise("old"), F.lit("|"), escaped(x["t"]["role"]), F.lit(CLOSE))
    made = listed.withColumn("turns", F.transform("turns", lambda x: F.struct(head(x).alias("head"), escaped(x["t"]["text"]).alias("body"), ((x["t"]["fresh"] == 1) & (x["t"]["role"] == "assistant")).alias("target"), x["t"]["n"].alias("n"))))
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["head"]) + F.length(x["body"]) + len(END)).cast("long").alias("at"),
            F.when(x["target"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(x["head"])).cast("long").alias("start"), (acc["at"] + F.length(x["head"]) + F.length(x["body"])).cast("long").alias("end")))))
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    text = F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    total = F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return made.select("conv_id", "window", text.alias("formatted"), spans.alias("loss_spans"), total.alias("n_tokens"))


def parsed_turns(formatted: Column) -> Column:
    """The new turns of a formatted text, as an array of (role, text)."""
    whole = F.regexp_extract_all(formatted, F.lit(r"(?s)<\|(?:new|old)\|(?:[^\\|]|\\.)*+\|>(?:[^\\|]|\\.)*+(?=\|end\|>)"), F.lit(0))
    fresh = F.filter(whole, lambda x: x.startswith("<|new|"))
    # a turn ends before the "<" of its end mark, which the pattern has taken along
    role = lambda x: F.regexp_extract(x, r"(?s)^<\|new\|((?:[^\\|]|\\.)*+)\|>", 1)
    body = lambda x: F.regexp_extract(x, r"(?s)^<\|new\|(?:[^\\|]|\\.)*+\|>(.*)<$", 1)
    return F.transform(fresh, lambda x: F.struct(unescaped(role(x)).alias("role"), unescaped(body(x)).alias("text")))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation, from the formatted windows alone: what op5 returns."""
    read = windows.select(
        "conv_id",
        "window",
        F.transform(parsed_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))).alias("turns"),
        F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    read = read.select("conv_id", "window", F.size("turns").alias("n"), F.array_join("turns", "").alias("turns"), "loss", "chars")
    whole = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("window", c))), lambda x: x[c]), "")
    by = read.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), whole("turns").alias("turns"), whole("loss").alias("loss"), F.sum("chars").alias("formatted_chars"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return by.select("conv_id", "n_turns", digest("turns").alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), digest("loss").alias("loss_sha256"), "formatted_chars")


def op5_chat_formatting(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))))).alias("t"))
    more = more.select(F.lit(-7).cast("long").alias("conv_id"), F.col("t.turn").cast("long").alias("turn"), F.col("t.role").alias("role"), F.lit(said).alias("text"))
    return read_back(format_windows(rows.unionByName(more)))
