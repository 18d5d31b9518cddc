r"""Chat formatting into budgeted training windows, in DataFrame functions only.

Prefix sums of turn tokens (a window function by conversation) choose turn-aligned spans: a turn
belongs to the stride its last token falls in, and a turn that crosses into a stride opens a span of
its own, so that a span is a single turn or at most ``stride`` tokens. Every span becomes one window:
the conversation's system turn, up to ``history`` earlier turns (within ``history_tokens``), then the
span's own turns. Assistant turns of the span are under the loss mask; repeated ones never are, so
each assistant text is a target exactly once over all windows.

Template of a turn: ``<|im_start|>role<|im_sep|>text<|im_end|>\n``. Inside roles and texts a
backslash is put before every backslash and after the first character of anything that begins a
control string (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``); ``unescape`` takes it out again.

Defined cases: null text or role is empty; null ``conv_id`` is one conversation; turns sort by turn
(null first), role, text, so ties and repeated rows have a fixed order and all stay; a turn above the
budget is a window alone and whole; extra columns are ignored; an empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
STRIDE, HISTORY, HISTORY_TOKENS = 1024, 2, 512
#: Tokens that the marks of a turn count for.
MARKS = 4

_ESCAPE = r"(?=\\)|(?<=<)(?=\||/?s>)|(?<=\[)(?=/?INST\])"


def escape(c: F.Column) -> F.Column:
    return F.regexp_replace(c, _ESCAPE, r"\\")


def unescape(c: F.Column) -> F.Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def tokens(c: F.Column) -> F.Column:
    """Words and single marks, a stand-in for a tokenizer's count that needs no Python."""
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) + MARKS


def windows(turns: DataFrame, stride: int = STRIDE, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """``conv_id, window, formatted, segments``: of each turn in a window ``turn_no`` (its place in
    the conversation), ``start`` and ``length`` of its escaped text in ``formatted`` (code points),
    ``fresh`` (first time the turn is shown) and ``loss``.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", F.col("turn"), role.alias("role"), text.alias("text"))
    rows = rows.select("*", tokens(F.col("text")).cast("long").alias("_n"))
    rows = rows.select(
        "*",
        (F.row_number().over(order) - 1).alias("_i"),
        F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("_stop"),
    ).withColumn("_start", F.col("_stop") - F.col("_n"))
    # An even span number: the turn that crosses into the stride; odd: those wholly inside it.
    stride_no = F.floor((F.col("_stop") - 1) / stride)
    rows = rows.withColumn("_span", 2 * stride_no + F.when(F.col("_start") < stride_no * stride, 0).otherwise(1))
    rows = rows.withColumn("_opens", F.coalesce(F.lag("_span").over(order) != F.col("_span"), F.lit(True)))
    later = [
        F.when(F.lead("_opens", d).over(order) & (F.lead("_start", d).over(order) - F.col("_start") <= history_tokens), F.lead("_span", d).over(order))
        for d in range(1, history + 1)
    ]
    is_system = (F.col("_i") == 0) & (F.col("role") == "system")
    system = F.first(F.when(is_system, F.struct("_i", "role", "text"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.select("*", is_system.alias("_system"), system.alias("_head"), *[x.alias(f"_later{d}") for d, x in enumerate(later)])
    turn = lambda fresh: F.struct(F.col("_i"), "role", "text", F.lit(fresh).alias("fresh"))
    head = F.struct(F.col("_head._i"), F.col("_head.role"), F.col("_head.text"), F.lit(False).alias("fresh"))
    shown = F.array(
        F.struct(F.col("_span").alias("window"), turn(True).alias("t")),
        F.when(F.col("_opens") & ~F.col("_system") & F.col("_head").isNotNull(), F.struct(F.col("_span").alias("window"), head.alias("t"))),
        *[F.when(~F.col("_system") & F.col(f"_later{d}").isNotNull(), F.struct(F.col(f"_later{d}").alias("window"), turn(False).alias("t"))) for d in range(history)],
    )
    shown = rows.select("conv_id", F.explode(F.filter(shown, lambda x: x.isNotNull())).alias("x")).select("conv_id", "x.window", "x.t")
    placed = shown.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("t")).alias("_turns"))
    parts = placed.select(
        "conv_id",
        "window",
        F.transform(
            "_turns",
            lambda t: F.struct(
                t["_i"].alias("turn_no"), t["fresh"].alias("fresh"), (t["fresh"] & (t["role"] == "assistant")).alias("loss"), escape(t["role"]).alias("role"), escape(t["text"]).alias("text")
            ),
        ).alias("_parts"),
    )
    before = len(START) + len(SEP)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<turn_no:int,start:int,length:int,fresh:boolean,loss:boolean>>").alias("done"))

    def place(a: F.Column, p: F.Column) -> F.Column:
        start, length = a["at"] + before + F.length(p["role"]), F.length(p["text"])
        one = F.struct(p["turn_no"].alias("turn_no"), start.alias("start"), length.alias("length"), p["fresh"].alias("fresh"), p["loss"].alias("loss"))
        return F.struct((start + length + len(END)).alias("at"), F.concat(a["done"], F.array(one)).alias("done"))

    said = F.transform("_parts", lambda p: F.concat(F.lit(START), p["role"], F.lit(SEP), p["text"], F.lit(END)))
    return parts.select("conv_id", "window", F.array_join(said, "").alias("formatted"), F.aggregate("_parts", zero, place, lambda a: a["done"]).alias("segments"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Fresh turns as the windows hold them: ``conv_id, window, formatted, turns`` with turn_no, role,
    text and, where the turn is under the loss mask, ``target`` (cut out of the window by its mask).
    """
    said = F.filter(F.split("formatted", F.lit(r"\Q" + END + r"\E"), -1), lambda x: x != "")
    split = formatted.select("*", said.alias("_said"))
    pairs = F.transform(
        F.arrays_zip("_said", "segments"),
        lambda z: F.struct(
            z["segments"]["turn_no"].alias("turn_no"),
            unescape(F.substring_index(F.substring(z["_said"], len(START) + 1, 1 << 30), SEP, 1)).alias("role"),
            unescape(F.substring_index(z["_said"], SEP, -1)).alias("text"),
            F.when(z["segments"]["loss"], unescape(F.substring(F.col("formatted"), z["segments"]["start"] + 1, z["segments"]["length"]))).alias("target"),
            z["segments"]["fresh"].alias("fresh"),
        ),
    )
    return split.select("conv_id", "window", "formatted", F.filter(pairs, lambda p: p["fresh"]).alias("turns"))
