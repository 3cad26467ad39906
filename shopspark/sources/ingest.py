"""Readers that fail closed: text first, then typed columns with a reason for every cell that isn't what it should be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NC_LINE_CAP = 100_000


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns as strings."""
    return spark.read.option("header", True).csv(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A file that holds one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def coerce(c: Column, kind: str, sep: str = ";") -> Column:
    """Lenient: a cell that can't be read is NULL. kind: int, double, bool, list or string."""
    c = blank_to_null(c)
    if kind == "bool":
        return F.when(c.isNotNull(), F.lower(c).isin("true", "1", "yes"))
    if kind == "list":
        return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), f"\\Q{sep}\\E"), lambda x: F.trim(x)), lambda x: x != "")
    return c if kind == "string" else c.try_cast(kind)


def coercion_errors(**cells: tuple[Column, str]) -> Column:
    """Strict: names of the cells that hold something which can't be read."""
    return F.array_compact(F.array(*[F.when(blank_to_null(c).isNotNull() & coerce(c, k).isNull(), F.lit(n)) for n, (c, k) in cells.items()]))


def typed(df: DataFrame, kinds: dict[str, str], sep: str = ";") -> DataFrame:
    return df.select(*[coerce(F.col(c), k, sep).alias(c) for c, k in kinds.items()])


def number(c: Column) -> Column:
    """A locale decimal such as 0,25."""
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")


def number_range(c: Column) -> Column:
    """struct(low, high) of texts such as '0,2–0,4*', '0.2-0.4' or '0,3'."""
    clean = F.regexp_replace(c, "[*\\s]", "")
    parts = F.split(clean, "[–-]")
    return F.struct(number(F.get(parts, F.lit(0))).alias("low"), number(F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))).alias("high"))


def lines(texts: DataFrame, text: str = "text", cap: int | None = None) -> DataFrame:
    """Numbered lines of texts; with a cap, a text of more lines gives one row with valid = false."""
    split = F.split(F.col(text), "\r\n|\r|\n")
    over = F.coalesce(F.size(split) > cap, F.lit(False)) if cap else F.lit(False)
    rows = texts.withColumn("valid", ~over).withColumn("_l", F.when(over, F.array(F.lit(None).cast("string"))).otherwise(split))
    return rows.select(*[c for c in texts.columns if c != text], "valid", F.posexplode("_l").alias("_n", "text")).withColumn("line_no", F.col("_n") + 1).drop("_n")


def nc_lines(programs: DataFrame, text: str = "text") -> DataFrame:
    """Numbered lines of NC texts; one of more than NC_LINE_CAP lines is refused: one row with valid = false."""
    return lines(programs, text, NC_LINE_CAP)


def reread(rows: DataFrame, block: int = NC_LINE_CAP // 2) -> DataFrame:
    """Line tables (program_id, line_no from 1 without gaps, text) written as texts of at most ``block`` lines and read again, so that no text grows with its program."""
    part = F.floor((F.col("line_no") - 1) / block).alias("_p")
    whole = rows.groupBy("program_id", part).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda s: F.coalesce(s["text"], F.lit(""))), "\r\n").alias("text"))
    return nc_lines(whole).select("program_id", (F.col("_p") * block + F.col("line_no")).cast("long").alias("line_no"), "valid", "text")


def markdown_cells(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Cells of Markdown tables: key, table number, row in table, column, value. Rules between header and body are left out."""
    from pyspark.sql import Window as W

    rows = lines(texts.select(key, F.col(text).alias("text"))).withColumn("is_row", F.col("text").rlike(r"^\s*\|.*\|\s*$"))
    w = W.partitionBy(key).orderBy("line_no")
    rows = rows.withColumn("table_no", F.sum((F.col("is_row") & ~F.coalesce(F.lag("is_row").over(w), F.lit(False))).cast("int")).over(w)).filter("is_row").filter(~F.col("text").rlike(r"^[\s|:-]+$"))
    rows = rows.withColumn("row_no", F.row_number().over(W.partitionBy(key, "table_no").orderBy("line_no")))
    cells = F.split(F.regexp_replace(F.trim("text"), r"^\||\|$", ""), r"\|")
    return rows.select(key, "table_no", "row_no", F.posexplode(cells).alias("col_no", "value")).withColumn("value", F.trim("value"))


def mesh_inventory(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Counts of vertices, normals, texture points and faces of OBJ and ASCII STL texts, and their object names."""
    first = F.lower(F.element_at(F.split(F.trim("text"), r"\s+"), 1))
    rows = lines(texts.select(key, F.col(text).alias("text"))).withColumn("tag", first)
    name = F.when(F.col("tag").isin("o", "g", "solid"), F.trim(F.regexp_replace(F.trim("text"), r"^\S+", "")))
    count = lambda *tags: F.count_if(F.col("tag").isin(*tags))
    return rows.groupBy(key).agg(count("v", "vertex").alias("vertices"), count("vn").alias("normals"), count("vt").alias("texcoords"), count("f", "facet").alias("faces"), F.array_join(F.sort_array(F.collect_set(name)), ",").alias("names"))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of columns joined by bars, NULL as the empty text."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)
