"""Chat formatting in budgeted windows; DataFrame functions only.

Prefix sums of the turns' tokens choose spans of whole turns. Each window is
the system turn, as many of the last turns before its span as the history
budget holds, and the span. Repeated turns (the system turn after the first
window, and history) are outside the loss mask, so every assistant turn is a
target exactly once.

No conversation is gathered in one row. Prefix sums are taken in blocks of
turns, and blocks offset by their totals; spans are chosen page by page, a page
being what lies within PAGE budgets of tokens; a window is put together from
its own turns alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import written

END = "<|end|>\n"
#: Turn numbers to a block of prefix sums, and budgets of tokens to a page of spans.
BLOCK, PAGE = 4096, 16
TURNS = r"<\|([^|]*)\|>\n([^<]*)<\|end\|>\n"


def escape(text: Column) -> Column:
    r"""Reversibly without `<`, `[` and `|`, of which all control strings are made: each becomes a backslash and a letter."""
    out = F.coalesce(text, F.lit(""))
    for raw, code in (("\\", "\\s"), ("<", "\\l"), ("[", "\\b"), ("|", "\\p")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    out = text
    for raw, code in (("|", "\\p"), ("[", "\\b"), ("<", "\\l"), ("\\", "\\s")):
        out = F.replace(out, F.lit(code), F.lit(raw))
    return out


def chat_windows(turns: DataFrame, budget: int = 512, history: int = 128, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", token: str = r"\p{L}{1,6}|\p{N}{1,3}|[^\s\p{L}\p{N}]") -> DataFrame:
    """conv, window (from 0), formatted, loss_spans (start, end in code points), n_tokens, n_repeated (leading turns that an earlier window had).

    A turn is formatted as `<|role|>`, a newline, its escaped text and
    `<|end|>` with a newline. Tokens are matches of the pattern `token`, about
    those of a byte-level BPE, and 4 for the marks. A span takes the next
    turns while system turn, history budget and span fit `budget`, and ends
    with its page; a turn longer than that is a span of its own and is never
    cut. A first turn of role `system` is retained in every window. Null roles
    and texts are empty; a null conv is a conversation; `turn` is a number
    (nulls first), rows of equal turn keep all, ordered by role and text;
    other columns are left out; an empty table gives none.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    marked = turns.select(F.col(conv).alias("_c"), F.col(turn).alias("_t"), F.floor(F.col(turn) / BLOCK).alias("_k"), F.coalesce(F.col(role), F.lit("")).alias("_r"), raw.alias("_x"))
    head = F.concat(F.lit("<|"), escape(F.col("_r")), F.lit("|>\n"))
    shown = marked.select("_c", "_t", "_k", "_r", "_x", (F.regexp_count("_x", F.lit(token)) + 4).cast("long").alias("tokens"), F.char_length(head).cast("long").alias("head"), F.concat(head, escape(F.col("_x")), F.lit(END)).alias("shown"))
    by_turn = Window.partitionBy("_c", "_k").orderBy("_t", "_r", "_x")
    before = by_turn.rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    inside = shown.withColumn("chars", F.char_length("shown").cast("long")).select(
        "_c", "_k", "_r", "tokens", "head", "shown", "chars", F.row_number().over(by_turn).cast("long").alias("seq"), sum_before("tokens", before).alias("at"), sum_before("chars", before).alias("chars_at")
    )
    inside = written(inside, "turns")
    of_blocks = Window.partitionBy("_c").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    totals = inside.groupBy("_c", "_k").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.sum("chars").alias("ch"))
    offsets = totals.select(F.col("_c").alias("_c2"), F.col("_k").alias("_k2"), *[sum_before(c, of_blocks).alias(f"_{c}") for c in ("n", "t", "ch")])
    same_block = F.col("_c").eqNullSafe(F.col("_c2")) & F.col("_k").eqNullSafe(F.col("_k2"))
    placed = inside.join(offsets, same_block).select("_c", "_r", "tokens", "head", "shown", "chars", (F.col("seq") + F.col("_n")).alias("seq"), (F.col("at") + F.col("_t")).alias("at"), (F.col("chars_at") + F.col("_ch")).alias("chars_at"))
    system = placed.where("seq = 1 AND _r = 'system'").select(F.col("_c").alias("_s"), F.col("tokens").alias("s_tokens"), F.col("chars").alias("s_chars"), F.col("shown").alias("s_shown"))
    system = written(system, "system-turns")
    with_system = placed.join(system.select("_s", "s_tokens", F.lit(True).alias("_has")), F.col("_c").eqNullSafe(F.col("_s")), "left")
    body = with_system.where("NOT (seq = 1 AND _has IS NOT NULL)").withColumn("at", F.col("at") - F.coalesce("s_tokens", F.lit(0)))

    room = F.greatest(F.lit(1).cast("long"), F.lit(budget - history).cast("long") - F.coalesce("s_tokens", F.lit(0)))
    paged = body.select("_c", room.alias("room"), F.floor(F.col("at") / (PAGE * room)).alias("page"), "at", "seq", "tokens")
    # a page holds PAGE budgets of tokens and a turn has four or more: its array has a bounded size
    pages = paged.groupBy("_c", "page").agg(F.first("room").alias("room"), F.sort_array(F.collect_list(F.struct("seq", "at", "tokens"))).alias("body"))
    start = F.expr("CAST(array() AS array<struct<seq: bigint, at: bigint>>)")

    def choose(starts: Column, x: Column) -> Column:
        since = F.get(starts, F.size(starts) - 1).getField("at")
        more = (F.size(starts) == 0) | (x.getField("at") + x.getField("tokens") - since > F.col("room")) & (x.getField("at") > since)
        return F.when(more, F.concat(starts, F.array(F.struct(x.getField("seq"), x.getField("at"))))).otherwise(starts)

    spanned = pages.select("_c", F.aggregate("body", start, choose).alias("starts"), F.get("body", F.size("body") - 1).getField("seq").alias("last"))
    spans = spanned.select("_c", F.inline(F.transform("starts", lambda x, i: F.struct(x.getField("seq").alias("first"), x.getField("at").alias("base"), F.coalesce(F.get("starts", i + 1).getField("seq") - 1, F.col("last")).alias("last")))))
    windows = spans.select("*", (F.row_number().over(Window.partitionBy("_c").orderBy("first")) - 1).alias("window"))
    back = F.greatest(F.lit(1).cast("long"), F.col("first") - history // 4)
    members = windows.select(F.col("_c").alias("_w"), "window", "first", "base", F.explode(F.sequence(back, "last")).alias("_seq"))
    joined = members.join(body.select("_c", "seq", "at", "_r", "tokens", "head", "chars", "chars_at", "shown"), F.col("_w").eqNullSafe(F.col("_c")) & (F.col("_seq") == F.col("seq")))
    kept = joined.where((F.col("seq") >= F.col("first")) | (F.col("base") - F.col("at") <= history))
    one = F.struct("seq", (F.col("seq") >= F.col("first")).alias("own"), "tokens", "head", "chars", "chars_at", (F.col("_r") == "assistant").alias("target"), "shown")
    framed = kept.groupBy("_c", "window").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    alone = system.join(framed.where("window = 0").select("_c"), F.col("_s").eqNullSafe(F.col("_c")), "left_anti")
    nothing = alone.select(F.col("_s").alias("_c"), F.lit(0).alias("window"), F.lit(None).cast(framed.schema["turns"].dataType).alias("turns"))
    whole = framed.unionByName(nothing).withColumn("turns", F.coalesce("turns", F.expr(f"CAST(array() AS {framed.schema['turns'].dataType.simpleString()})")))
    whole = whole.join(system, F.col("_c").eqNullSafe(F.col("_s")), "left")

    def mask(x: Column) -> Column:
        at = F.coalesce("s_chars", F.lit(0).cast("long")) + x.getField("chars_at") - F.get("turns", F.lit(0)).getField("chars_at")
        return F.struct((at + x.getField("head")).alias("start"), (at + x.getField("chars") - len(END)).alias("end"))

    return whole.select(
        F.col("_c").alias(conv),
        "window",
        F.concat(F.coalesce("s_shown", F.lit("")), F.array_join(F.transform("turns", lambda x: x.getField("shown")), "")).alias("formatted"),
        F.transform(F.filter("turns", lambda x: x.getField("own") & x.getField("target")), mask).alias("loss_spans"),
        F.aggregate("turns", F.coalesce("s_tokens", F.lit(0).cast("long")), lambda a, x: a + x.getField("tokens")).alias("n_tokens"),
        (F.size(F.filter("turns", lambda x: ~x.getField("own"))) + F.when(F.col("s_chars").isNotNull() & (F.col("window") > 0), 1).otherwise(0)).alias("n_repeated"),
    )


def read_back(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, from its windows' text alone: turns (role, text) without repeats, loss_text and formatted_chars.

    The system turn leads each window, so what an earlier window had is the
    window's first n_repeated turns. A conversation's turns are gathered in
    one row, as its result asks for.
    """
    roles = F.regexp_extract_all("formatted", F.lit(TURNS), F.lit(1))
    texts = F.regexp_extract_all("formatted", F.lit(TURNS), F.lit(2))
    parsed = windows.select(
        conv, "window",
        F.arrays_zip(roles.alias("role"), texts.alias("text")).alias("_all"), "n_repeated",
        F.array_join(F.transform("loss_spans", lambda s: F.substring("formatted", (s.getField("start") + 1).cast("int"), (s.getField("end") - s.getField("start")).cast("int"))), "").alias("_loss"),
        F.char_length("formatted").cast("long").alias("_chars"),
    )
    new = F.transform(F.slice("_all", F.col("n_repeated") + 1, F.greatest(F.size("_all") - F.col("n_repeated"), F.lit(0))), lambda x: F.struct(unescape(x.getField("role")).alias("role"), unescape(x.getField("text")).alias("text")))
    gathered = parsed.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct("window", new.alias("turns"), "_loss"))).alias("_w"), F.sum("_chars").alias("formatted_chars"))
    return gathered.select(
        conv,
        F.flatten(F.transform("_w", lambda w: w.getField("turns"))).alias("turns"),
        unescape(F.array_join(F.transform("_w", lambda w: w.getField("_loss")), "")).alias("loss_text"),
        "formatted_chars",
    )
