"""Tables, lists and transcripts rendered as one document per key, as ordered aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.functions.meta import clock, clock_srt
from loomdoc.functions.text import render_cell, sanitize_cell


def joined(text: Column, order: Column, sep: str = "\n") -> Column:
    """Aggregate: texts of a group in order.  A rendered document is bounded by its row limit before this is used."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), sep)


def render_table(df: DataFrame, columns: Sequence[str], order: Sequence[str], *, style: str = "markdown", max_rows: int = 500, width: int = 80) -> DataFrame:
    """One row ``content, n_rows, truncated``: the first ``max_rows`` rows as a padded table.

    ``style`` is ``markdown`` (pipe table) or ``plain`` (aligned columns).  Widths are those of the shown
    cells, three at least.  All rows are counted, only the shown ones are gathered (a table's limit is its
    feature); nulls are empty cells; without columns the content is empty.
    """
    total = df.agg(F.count(F.lit(1)).alias("n_rows"))
    shown = df.orderBy(*order).limit(max_rows)
    cells = [F.coalesce(sanitize_cell(F.col(c).cast("string"), width), F.lit("")).alias(f"_{i}") for i, c in enumerate(columns)]
    heads = [sanitize_cell(F.lit(c), width) for c in columns]
    ranked = shown.withColumn("_o", F.row_number().over(Window.orderBy(*order))).select("_o", *cells)  # at most max_rows rows
    widths = ranked.agg(*[F.greatest(F.lit(3), F.length(h), F.coalesce(F.max(F.length(f"_{i}")), F.lit(0))).alias(f"w{i}") for i, h in enumerate(heads)])
    pad = lambda c, w: F.expr(f"rpad({c}, {w}, ' ')")
    both = ranked.crossJoin(F.broadcast(widths))  # one row
    names = range(len(columns))
    if style == "markdown":
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *[pad(f"_{i}", f"w{i}") for i in names]), F.lit(" |"))
    else:
        line = F.rtrim(F.concat_ws("  ", *[pad(f"_{i}", f"w{i}") for i in names]))
    body = both.agg(joined(line, F.col("_o")).alias("body"), F.count(F.lit(1)).alias("shown"))
    h = widths.select("*", *[c.alias(f"h{i}") for i, c in enumerate(heads)])
    if style == "markdown":
        head = F.concat(F.lit("| "), F.concat_ws(" | ", *[pad(f"h{i}", f"w{i}") for i in names]), F.lit(" |\n| "), F.concat_ws(" | ", *[F.expr(f"repeat('-', w{i})") for i in names]), F.lit(" |"))
        note = F.concat(F.lit("\n\n> **Note:** Table truncated to "), F.col("shown").cast("string"), F.lit(" of "), F.col("n_rows").cast("string"), F.lit(" rows."))
    else:
        head = F.concat(F.rtrim(F.concat_ws("  ", *[pad(f"h{i}", f"w{i}") for i in names])), F.lit("\n"), F.concat_ws("  ", *[F.expr(f"repeat('-', w{i})") for i in names]))
        note = F.concat(F.lit("\n\n(Table truncated to "), F.col("shown").cast("string"), F.lit(" of "), F.col("n_rows").cast("string"), F.lit(" rows.)"))
    one = h.select(head.alias("head")).crossJoin(body).crossJoin(total)
    text = F.concat(F.col("head"), F.when(F.col("shown") > 0, F.concat(F.lit("\n"), F.col("body"))).otherwise(""), F.when(F.col("n_rows") > F.col("shown"), note).otherwise(""))
    return one.select(text.alias("content"), "n_rows", (F.col("n_rows") > F.col("shown")).alias("truncated"))


def table_section(df: DataFrame, name: str, order: Sequence[str], *, schema_sql: str = "", view: bool = False, max_rows: int = 10) -> DataFrame:
    """One row ``name, n_rows, section``: schema block, row count and a sample of one table."""
    cols = df.columns
    total = df.agg(F.count(F.lit(1)).alias("n"))
    shown = df.orderBy(*order).limit(max_rows).withColumn("_o", F.row_number().over(Window.orderBy(*order)))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[render_cell(F.col(f"`{c}`")) for c in cols]), F.lit(" |"))
    body = shown.agg(joined(line, F.col("_o")).alias("b"), F.count(F.lit(1)).alias("k"))
    head = "| " + " | ".join(cols) + " |\n| " + " | ".join(["---"] * len(cols)) + " |\n"
    rows = F.concat(F.col("n").cast("string"), F.lit(" row"), F.when(F.col("n") == 1, "").otherwise("s"))
    note = F.when(F.col("n") > max_rows, F.concat(F.lit(f"\n_Showing {max_rows} of "), F.col("n").cast("string"), F.lit(" rows._\n"))).otherwise(F.concat(F.lit("\n_"), rows, F.lit("._\n")))
    sample = F.when(F.col("k") == 0, "_No rows._\n").otherwise(F.concat(F.lit(head), F.col("b"), F.lit("\n"), note))
    block = f"```sql\n{schema_sql.strip()}\n```\n" if schema_sql else "_No schema available._\n"
    badge = " _(view)_" if view else ""
    text = F.concat(F.lit(f"## `{name}`{badge}\n\n### Schema\n\n{block}\n### Data ("), rows, F.lit(")\n\n"), sample)
    return total.crossJoin(body).select(F.lit(name).alias("name"), F.col("n").alias("n_rows"), text.alias("section"))


def fixed_table(df: DataFrame, columns: Sequence[str], order: Sequence[str], *, max_rows: int = 500) -> DataFrame:
    """One row ``content``: rows as a listing of fixed width, columns as wide as their widest cell or name, two blanks apart."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(f"_{i}") for i, c in enumerate(columns)]
    shown = df.orderBy(*order).limit(max_rows).withColumn("_o", F.row_number().over(Window.orderBy(*order))).select("_o", *cells)  # at most max_rows rows
    widths = shown.agg(*[F.greatest(F.lit(len(c)), F.coalesce(F.max(F.length(f"_{i}")), F.lit(0))).alias(f"w{i}") for i, c in enumerate(columns)])
    names = range(len(columns))
    line = lambda cell: F.concat_ws("  ", *[F.rpad(cell(i), F.col(f"w{i}"), F.lit(" ")) for i in names])
    body = shown.crossJoin(F.broadcast(widths)).agg(joined(line(lambda i: F.col(f"_{i}")), F.col("_o")).alias("b"))  # one row of widths
    head = F.concat_ws("\n", line(lambda i: F.lit(columns[i])), F.concat_ws("  ", *[F.repeat(F.lit("-"), F.col(f"w{i}")) for i in names]))
    return widths.select(head.alias("h")).crossJoin(body).select(F.concat_ws("\n", "h", F.nullif("b", F.lit(""))).alias("content"))


def segments_srt(df: DataFrame, key: str, order: Sequence[str], start_ms: str, end_ms: str, text: str, speaker: str | None = None) -> DataFrame:
    """``key, content``: the segments of each key as SRT, numbered from 1 in order, optionally with ``[speaker]``."""
    w = Window.partitionBy(key).orderBy(*order)
    t = F.trim(F.col(text)) if speaker is None else F.concat(F.lit("["), F.col(speaker), F.lit("] "), F.col(text))
    n = df.withColumn("_n", F.row_number().over(w))
    block = F.concat_ws("\n", F.col("_n").cast("string"), F.concat(clock_srt(F.col(start_ms)), F.lit(" --> "), clock_srt(F.col(end_ms))), t)
    return n.groupBy(key).agg(joined(block, F.col("_n"), "\n\n").alias("content"))


def segments_markdown(df: DataFrame, key: str, order: Sequence[str], start_s: str, text: str, speaker: str | None = None, score: str | None = None) -> DataFrame:
    """``key, content``: timestamped paragraphs, or speaker headers with an optional score of a match of medium confidence."""
    w = Window.partitionBy(key).orderBy(*order)
    n = df.withColumn("_n", F.row_number().over(w))
    at = F.concat(F.lit("["), clock(F.col(start_s)), F.lit("]"))
    if speaker is None:
        block = F.concat(F.lit("**"), at, F.lit("** "), F.trim(F.col(text)), F.lit("\n"))
    else:
        mark = F.lit("") if score is None else F.coalesce(F.concat(F.lit(" ("), F.format_number(F.col(score), 2), F.lit(")")), F.lit(""))
        head = F.when(F.col(speaker).isNull(), F.concat(F.lit("**"), at, F.lit("**"))).otherwise(F.concat(F.lit("**"), F.col(speaker), F.lit("**"), mark, F.lit(" "), at))
        block = F.concat(head, F.lit("\n\n"), F.col(text), F.lit("\n"))
    return n.groupBy(key).agg(joined(block, F.col("_n"), "\n").alias("content"))


def segments_text(df: DataFrame, key: str, order: Sequence[str], text: str, speaker: str | None = None) -> DataFrame:
    """``key, content``: texts set apart by blank lines, optionally ``speaker: text``."""
    n = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    t = F.trim(F.col(text)) if speaker is None else F.concat(F.coalesce(F.concat(F.col(speaker), F.lit(": ")), F.lit("")), F.col(text))
    return n.groupBy(key).agg(joined(t, F.col("_n"), "\n\n").alias("content"))


def pages_markdown(df: DataFrame, key: str, page: str, text: str, thin: str) -> DataFrame:
    """``key, content``: ``## Page N`` sections in page order; an empty thin page is marked as an image."""
    body = F.when((F.coalesce(F.col(text), F.lit("")) == "") & F.col(thin), F.lit("*[This page appears to be image-only — no extractable text]*")).otherwise(F.coalesce(F.col(text), F.lit("")))
    return df.groupBy(key).agg(joined(F.concat(F.lit("## Page "), F.col(page).cast("string"), F.lit("\n\n"), body, F.lit("\n")), F.col(page)).alias("content"))


def pages_text(df: DataFrame, key: str, page: str, text: str) -> DataFrame:
    return df.where(F.col(text) != "").groupBy(key).agg(joined(F.col(text), F.col(page), "\n\n").alias("content"))


def speaker_display(names: Column, label: Column, present: Column) -> Column:
    """The matched name, the raw label of an unmatched one that the map lists, ``SPEAKER_n`` without a map entry."""
    return F.coalesce(names, F.when(present, label.cast("string")).otherwise(F.concat(F.lit("SPEAKER_"), label.cast("string"))))
