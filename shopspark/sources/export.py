"""Writers, and the guard against formulas in exported cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def csv_guard(c: Column) -> Column:
    """A cell that a spreadsheet would read as a formula gets a leading quote."""
    text = c.cast("string")
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def write_csv(df: DataFrame, path: str) -> None:
    text = [name for name, kind in df.dtypes if kind == "string"]
    df.withColumns({c: csv_guard(F.col(c)) for c in text}).write.option("header", True).csv(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row, keys in column order, NULL cells left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def csv_cell(c: Column) -> Column:
    """A cell as CSV text: guarded, NULL as nothing, quoted where it holds a comma, a quote or a line end."""
    text = F.coalesce(csv_guard(c), F.lit(""))
    return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame, key: str, order: list[str], columns: dict[str, Column]) -> DataFrame:
    """(key, line_no, line): a CSV text per key, as lines; the header is line 0, rows follow from 1 in the given order.

    columns: what each column holds, by its name in the header. A key without rows has no text.
    """
    line = F.concat_ws(",", *[csv_cell(x) for x in columns.values()])
    rows = df.select(key, F.row_number().over(W.partitionBy(key).orderBy(*order)).alias("line_no"), line.alias("line"))
    head = F.array(F.struct(F.lit(0).alias("line_no"), F.concat_ws(",", *[csv_cell(F.lit(x)) for x in columns]).alias("line")))
    own = F.struct("line_no", "line")
    each = F.when(F.col("line_no") == 1, F.concat(head, F.array(own))).otherwise(F.array(own))
    return rows.select(key, F.explode(each).alias("e")).select(key, F.col("e.line_no").cast("long").alias("line_no"), "e.line")


def write_csv_texts(lines: DataFrame, key: str, path: str) -> None:
    """The texts of csv_lines, a folder per key; lines stay in order within it."""
    lines.repartition(key).sortWithinPartitions(key, "line_no").select(key, "line").write.partitionBy(key).text(path)
