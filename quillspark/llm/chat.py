"""Chat formatting in budgeted windows, with DataFrame functions alone.

A turn is written as <|im_start|>role, line feed, text, <|im_end|>, line feed. Inside roles and texts a backslash precedes
each backslash and each bar of "<|", so no text can form a control string, and dropping the escapes gives back the text.

Prefix sums of turn tokens choose turn-aligned spans: a turn belongs to span floor(tokens before it / width), where width is
half of what the budget leaves after system turn and history, so a window stays within the budget unless one turn alone is
longer than width or the system turn longer than its share. Every window but a conversation's first begins with the system
turn (a first turn of role system) and with up to `history_turns` turns before the span, as long as they fit
`history_tokens`. Loss spans are the texts of the assistant turns that are new in the window, in code points from 0; what is
repeated is masked. So each assistant text is a target exactly once.

Tokens are a column of counts, if one is named; else TOKENS_A_BYTE for each byte of UTF-8, which was more than either public
BPE vocabulary needed for any of 5,012 turns (their most was 0.55; words and marks alone would be a third of it).

Spans start anew every BLOCK_TURNS turn numbers: prefix sums, history and assembly work on blocks of bounded length, and a
conversation that holds a third of all rows is spread over many tasks. Where more than BLOCK_TURNS rows have one turn
number, or none, they are ranked by a distributed sort and dealt to blocks of that many rows. Only the digest of a whole
conversation in conversation_report brings its text into one row, as the digest of one string must; a turn's own length
isn't bounded.

Turns are ordered by turn (nulls first), then role and text. Null roles and texts are empty. Repeated rows are repeated
turns. Rows without a conv_id are one conversation. Extra columns are ignored, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspark.llm.common import scratch, stored, text_or_empty

#: The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY_TURNS, HISTORY_TOKENS, SYSTEM_TOKENS = 512, 2, 96, 96
#: Tokens of the template around a turn; of a text, for each byte.
TURN_TOKENS, TOKENS_A_BYTE = 4, 0.55
BLOCK_TURNS = 256
ASSISTANT, SYSTEM = "assistant", "system"


def escape(text: Column, newline: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\\n")) if newline else out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def count_tokens(text: Column) -> Column:
    """A calibrated number of tokens, rather too high than too low."""
    return F.ceil(F.octet_length(text) * TOKENS_A_BYTE).cast("long")


def blocks(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, t) with block, a struct that orders the blocks of a conversation; at most BLOCK_TURNS turn numbers
    or BLOCK_TURNS rows of one number are in one."""
    base = F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS).cast("long"), F.lit(-(1 << 62)))
    block = lambda turn, part: F.struct(base.alias("base"), turn.cast("long").alias("turn"), part.cast("long").alias("part"))
    dense = rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK_TURNS)
    dense = stored(dense.select("conv_id", "turn", base.alias("base")), "dense")
    if dense.isEmpty():
        return rows.withColumn("block", block(F.lit(0), F.lit(0)))
    same = lambda a, b, *names: reduce(Column.__and__, [a[n].eqNullSafe(b[n]) for n in names])
    mine = F.coalesce("turn", F.lit(0))
    rows = rows.withColumn("base", base)
    hot = rows.join(dense, same(rows, dense, "conv_id", "turn"), "left_semi").withColumn("salt", F.monotonically_increasing_id())
    # The salt spreads equal rows; ids made after the sort rise with it, so runs of them are blocks in order.
    order = [F.col("conv_id"), F.col("turn"), F.col("t.role"), F.col("t.body"), F.col("salt")]
    ranked = hot.repartitionByRange(max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order)
    ranked = stored(ranked.withColumn("place", F.monotonically_increasing_id()), "dense-turns")
    parts = [ranked.withColumn("block", block(mine, F.floor(F.col("place") / BLOCK_TURNS))).select("conv_id", "turn", "t", "block")]
    # Where a block of numbers holds a dense one, its other numbers are blocks of their own.
    others = rows.join(dense, same(rows, dense, "conv_id", "turn"), "left_anti")
    split = dense.select("conv_id", "base").distinct()
    parts.append(others.join(split, same(others, split, "conv_id", "base"), "left_semi").withColumn("block", block(mine, F.lit(0))).select("conv_id", "turn", "t", "block"))
    parts.append(others.join(split, same(others, split, "conv_id", "base"), "left_anti").withColumn("block", block(F.lit(0), F.lit(0))).select("conv_id", "turn", "t", "block"))
    return reduce(DataFrame.unionAll, parts)


def format_windows(conversations: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS, system_tokens: int = SYSTEM_TOKENS, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokens: str | None = None) -> DataFrame:
    """conv_id, block, span (they order the windows), text, n_context (turns repeated at its start), loss_spans."""
    width = (budget - history_tokens - system_tokens) // 2
    if width < 1 or history_turns < 0:
        raise ValueError("the budget leaves no room for turns")
    body = text_or_empty(text)
    size = F.coalesce(F.col(f"`{tokens}`").cast("long"), F.lit(0)) if tokens else count_tokens(body)
    who = text_or_empty(role)
    rows = blocks(
        conversations.select(
            F.col(f"`{key}`").cast("long").alias("conv_id"),
            F.col(f"`{turn}`").cast("long").alias("turn"),
            F.struct(who.alias("role"), body.alias("body"), (size + TURN_TOKENS).alias("tokens"), (who == ASSISTANT).alias("target"), (who == SYSTEM).alias("system")).alias("t"),
        )
    )
    in_block = W.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "t.role", "t.body")
    rows = rows.withColumns(
        {
            "rn": F.row_number().over(in_block),
            "before": F.coalesce(F.sum("t.tokens").over(in_block.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            "recent": F.collect_list("t").over(in_block.rowsBetween(-history_turns, -1)) if history_turns else F.slice(F.array("t"), 1, 0),
        }
    )
    rows = rows.withColumn("span", F.floor(F.col("before") / width).cast("long"))
    spans = rows.groupBy("conv_id", "block", "span").agg(
        F.array_sort(F.collect_list(F.struct("rn", "t"))).alias("new"),
        F.min_by("recent", "rn").alias("recent"),
    )
    # One row a block: its first turn, its last turns, and from the block before: what history may repeat.
    ends = spans.groupBy("conv_id", "block").agg(F.min_by(F.element_at("new", 1)["t"], "span").alias("head"), F.max_by(F.concat("recent", F.transform("new", lambda x: x["t"])), "span").alias("tail"))
    by_block = W.partitionBy("conv_id").orderBy("block")
    first = F.first("head").over(by_block.rowsBetween(W.unboundedPreceding, 0))
    last_turns = F.when(F.size("tail") > history_turns, F.slice("tail", F.size("tail") - history_turns + 1, history_turns)).otherwise(F.col("tail"))
    ends = ends.select(
        "conv_id",
        "block",
        F.when(first["system"], first).alias("system"),
        F.lag(last_turns).over(by_block).alias("carried"),
        (F.row_number().over(by_block) == 1).alias("first_block"),
    ).select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "system", "carried", "first_block")
    spans = spans.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))

    opening = F.col("first_block") & (F.element_at("new", 1)["rn"] == 1)
    none = F.slice(F.array(F.element_at("new", 1)["t"]), 1, 0)
    history = F.when(F.element_at("new", 1)["rn"] == 1, F.coalesce("carried", none)).otherwise(F.col("recent"))
    # The system turn is retained as such and not repeated as history as well.
    history = F.filter(history, lambda x: ~(x["system"] & F.coalesce(x == F.col("system"), F.lit(False))))
    fitting = F.aggregate(
        F.reverse(history),
        F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n")),
        lambda acc, x: F.when((acc["used"] + x["tokens"] <= history_tokens) & (acc["used"] >= 0), F.struct((acc["used"] + x["tokens"]).alias("used"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(-1).cast("long").alias("used"), acc["n"].alias("n"))),
    )["n"]
    spans = spans.select("conv_id", "block", "span", "new", F.when(opening, none).otherwise(F.concat(F.when(F.col("system").isNotNull(), F.array("system")).otherwise(none), F.slice(F.reverse(F.slice(F.reverse(history), F.lit(1), fitting)), 1, history_turns + 1))).alias("context"))
    put = lambda x, target: F.struct(escape(x["role"], True).alias("role"), escape(x["body"]).alias("body"), target.alias("target"))
    turns = F.concat(F.transform("context", lambda x: put(x, F.lit(False))), F.transform("new", lambda x: put(x["t"], x["t"]["target"])))
    spans = spans.select("conv_id", "block", "span", F.size("context").alias("n_context"), turns.alias("turns"))
    written = F.array_join(F.transform("turns", lambda x: F.concat(F.lit(START), x["role"], F.lit("\n"), x["body"], F.lit(END + "\n"))), "")
    span_type = "array<struct<start:int,length:int>>"
    spots = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast(span_type).alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["role"]) + F.length(x["body"]) + len(START) + len(END) + 2).alias("at"),
            F.when(x["target"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + len(START) + F.length(x["role"]) + 1).alias("start"), F.length(x["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )["spans"]
    return spans.select("conv_id", "block", "span", "n_context", written.alias("text"), spots.alias("loss_spans"))


def parse_turns(text: Column, skip: Column) -> Column:
    """The turns of a formatted window after the first `skip`, as structs of role and text, unescaped."""
    pieces = F.split(text, r"<\|im_start\|>")
    pieces = F.slice(pieces, skip + 2, F.greatest(F.size(pieces) - 1 - skip, F.lit(0)))

    def turn(piece: Column) -> Column:
        role = F.regexp_extract(piece, r"^((?:[^\\\n]|\\[\s\S])*+)\n", 1)
        body = F.substring(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(END + "\n"))
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def conversation_report(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from formatted windows: its turns, its targets and the length of the output."""
    read = windows.select("conv_id", "block", "span", F.length("text").cast("long").alias("chars"), parse_turns(F.col("text"), F.col("n_context")).alias("turns"), F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("text", s["start"] + 1, s["length"]))), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    read = read.select("conv_id", "chars", F.size("turns").cast("long").alias("n"), F.struct("block", "span", said.alias("said"), "loss").alias("w"))
    whole = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"), F.array_sort(F.collect_list("w")).alias("w"))
    whole = whole.select("conv_id", "n_turns", "formatted_chars", "n_windows", F.array_join(F.col("w.said"), "").alias("said"), F.array_join(F.col("w.loss"), "").alias("loss"))
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.encode("said", "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )


def written_report(conversations: DataFrame, **options) -> DataFrame:
    """Write the windows to the shared folder, read them back and report on each conversation."""
    with scratch(conversations.sparkSession) as keep:
        windows = keep(stored(format_windows(conversations, **options), "chat"))
    return conversation_report(windows)
