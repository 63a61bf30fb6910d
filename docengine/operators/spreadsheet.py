"""Sheets as Markdown tables within a size: cells, rows, and the longest head of rows that fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import text as T

SHEET_CAP, WORKBOOK_CAP, ROW_CAP = 40_000, 60_000, 10_000


def cell(text: Column) -> Column:
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*\r?\n\s*", " ")
    return F.trim(F.replace(flat, F.lit("|"), F.lit("\\|")))


def markdown_row(cells: Column, width: int | Column) -> Column:
    """A row of width cells: longer ones are cut, shorter ones filled."""
    filled = F.slice(F.concat(F.transform(F.coalesce(cells, F.array().cast("array<string>")), cell), F.array_repeat(F.lit(""), width)), 1, width)
    return F.concat(F.lit("| "), F.array_join(filled, " | "), F.lit(" |"))


def header_row(names: Column, width: int | Column) -> Column:
    """Blank names become col_ and their place, from 0."""
    named = F.transform(names, lambda x, i: F.when(cell(x) == "", F.concat(F.lit("col_"), i.cast("string"))).otherwise(cell(x)))
    return F.concat(F.lit("| "), F.array_join(F.slice(named, 1, width), " | "), F.lit(" |"))


def rows_within(rows: DataFrame, cap: int = SHEET_CAP, header_size: int | Column = 0, sheet: tuple[str, ...] = ("sheet",)) -> DataFrame:
    """The first rows of each sheet whose text stays within cap: a running sum of sizes, per sheet."""
    w = Window.partitionBy(*sheet).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("size", F.sum(F.length("line") + 1).over(w)).filter(F.col("size") <= cap - header_size)


def numbered(c: Column) -> Column:
    return F.format_number(c, 0)


def sheet_sections(rows: DataFrame, row_cap: int = ROW_CAP, sheet_cap: int = SHEET_CAP) -> DataFrame:
    """path, sheet_no, n_sheets, rows and text of every sheet, from rows as the sheet reader gives them. A sheet is a marker and
    a Markdown table of its header and as many rows as there is room for; footers say which rows were left out, and why. Rows
    beyond row_cap don't count as rows; without rows a sheet is said to be empty."""
    key = ("path", "sheet_no")
    good = rows.filter("error IS NULL")
    heads = good.filter("coalesce(pos, 0) = 0").select(*key, "n_sheets", "sheet", "n_rows", F.col("cells").alias("names"))
    width = F.size("names")
    ruler = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    heads = heads.withColumn("head", F.when(width > 0, F.concat(header_row(F.col("names"), width), F.lit("\n"), ruler)).otherwise(F.when(F.col("names").isNotNull(), "")))
    data = good.filter((F.col("pos") > 0) & (F.col("pos") <= row_cap)).join(heads.filter(width > 0).select(*key, width.alias("width"), F.length("head").alias("head_size")), list(key))
    fit = rows_within(data.select(*key, "pos", "head_size", markdown_row(F.col("cells"), F.col("width")).alias("line")), sheet_cap, F.col("head_size"), key)
    body = fit.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("lines"))
    out = heads.join(body, list(key), "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))
    kept, have = F.size("lines"), F.least("n_rows", F.lit(row_cap))
    flat = F.col("path").rlike(r"(?i)\.(csv|tsv)$")
    footers = F.concat(
        F.when(F.col("n_rows") > row_cap, F.concat(F.lit(f"\n\n*Truncated by row cap: showing first {row_cap:,} of "), numbered(F.col("n_rows")), F.lit(" data rows*"))).otherwise(""),
        F.when((width > 0) & (kept < have), F.concat(F.lit(f"\n\n*Truncated by char cap ({sheet_cap:,}): kept "), numbered(kept), F.lit(" of "), numbered(have), F.lit(" rows on this "), F.when(flat, "file").otherwise("sheet"), F.lit("*"))).otherwise(""),
    )
    marker = F.concat(F.lit('--- Sheet "'), F.col("sheet"), F.lit('" ('), F.col("sheet_no").cast("string"), F.lit(" of "), F.col("n_sheets").cast("string"), F.lit(") ---\n\n"))
    table = F.when(F.col("names").isNull(), F.concat(F.lit("*Empty "), F.when(flat, "file").otherwise("sheet"), F.lit("*"))).otherwise(F.concat(F.concat_ws("\n", "head", "lines"), footers))
    tables = F.col("names").isNotNull() & (~flat | (F.col("n_rows") > 0))
    return out.select(*key, "n_sheets", have.alias("rows"), tables.alias("is_table"), F.concat(marker, table).alias("text"))


def workbook_texts(rows: DataFrame, row_cap: int = ROW_CAP, sheet_cap: int = SHEET_CAP, workbook_cap: int = WORKBOOK_CAP) -> DataFrame:
    """Every file as one text with its sheets in order, cut at the last blank line within workbook_cap: path, sheet_count,
    row_count, tables_found, markdown and error. A file that can't be read has an error alone."""
    parts = sheet_sections(rows, row_cap, sheet_cap)
    whole = parts.groupBy("path").agg(
        F.max("n_sheets").alias("sheet_count"), F.sum("rows").alias("row_count"), F.count_if("is_table").alias("tables_found"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sheet_no", "text"))), lambda x: x["text"]), "\n\n").alias("text"),
    )
    n, end = F.length("text"), T.last_index(F.substring("text", 1, workbook_cap), "\n\n")
    cut = F.when(end > 1, end - 1).otherwise(workbook_cap)
    footer = F.concat(
        F.lit(f"\n\n*Truncated by workbook cap ({workbook_cap:,} chars): kept first "), numbered(cut), F.lit(" of "), numbered(n), F.lit(" total chars across "), F.col("sheet_count").cast("string"),
        F.lit(" sheet(s). Full data remains on disk at "), T.basename(F.col("path")), F.lit(".*"),
    )
    text = F.when(n <= workbook_cap, F.col("text")).otherwise(F.concat(F.substring(F.col("text"), F.lit(1), cut), footer))
    made = whole.select("path", "sheet_count", "row_count", "tables_found", text.alias("markdown"), F.lit(None).cast("string").alias("error"))
    failed = rows.filter("error IS NOT NULL").select("path", F.lit(None).cast("int").alias("sheet_count"), F.lit(None).cast("long").alias("row_count"), F.lit(None).cast("long").alias("tables_found"), F.lit(None).cast("string").alias("markdown"), "error")
    return made.unionByName(failed)
