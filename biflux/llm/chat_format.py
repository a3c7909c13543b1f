"""Chat transcripts as marked text that a deterministic parser turns back into the same turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

START, END, ESCAPE, LINE = "<|turn|>", "<|end|>\n", "<|lit|>", "<|line|>"
OPEN = "<|"


def escape(text: Column) -> Column:
    """No control string is left: each opening ``<|`` becomes the escape mark."""
    return F.replace(text, F.lit(OPEN), F.lit(ESCAPE))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit(ESCAPE), F.lit(OPEN))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """Array of (role, text): cut at the start marks, then at the first line end, then at the end mark."""
    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        rest = F.substr(piece, F.length(head) + 2)
        return F.struct(
            unescape(F.replace(head, F.lit(LINE), F.lit("\n"))).alias("role"),
            unescape(F.substring_index(rest, END, 1)).alias("text"))

    return F.transform(F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30), turn)


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", learn_role: str = "assistant") -> DataFrame:
    """One row per conversation: (conv, turns, formatted, loss_spans, identical).

    A turn is rendered as it is, parsed back and compared; where role or text don't come back they are escaped.
    ``loss_spans`` are (start, length) in characters of the learned role's texts in ``formatted``; ``identical`` compares
    the turns parsed from the whole text with the source. Order: turn, then role, then text; a null turn comes first, a
    null role or text is empty, rows with a null conversation are one conversation. Repeated rows stay turns of their
    own. An empty table gives no rows; other columns are ignored.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    source = F.array(F.struct(F.col("role"), F.col("text")))
    same = parse(render(F.col("role"), F.col("text"))) == source
    rows = rows.withColumn("same", same)
    rows = rows.withColumns({
        "head": F.when(F.col("same"), F.col("role")).otherwise(F.replace(escape(F.col("role")), F.lit("\n"), F.lit(LINE))),
        "body": F.when(F.col("same"), F.col("text")).otherwise(escape(F.col("text")))})
    rows = rows.withColumn("piece", render(F.col("head"), F.col("body")))
    before = Window.partitionBy("conv").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", (F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0))).cast("long"))
    body_at = F.col("start") + len(START) + F.length("head") + 1
    span = F.when(F.col("role") == learn_role, F.struct(body_at.alias("start"), F.length("body").cast("long").alias("length")))
    grouped = rows.groupBy("conv").agg(F.sort_array(F.collect_list(
        F.struct("start", "role", "text", "piece", span.alias("span")))).alias("rows"))
    out = grouped.select(
        "conv", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"),
        F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
        F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s.isNotNull()).alias("loss_spans"))
    return out.select(F.col("conv").alias(conv_col), "turns", "formatted", "loss_spans", (parse(F.col("formatted")) == F.col("turns")).alias("identical"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    pieces = F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"].cast("int") + 1, s["length"].cast("int"))))
    return F.array_join(pieces, "")
