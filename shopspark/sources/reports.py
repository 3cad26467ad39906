"""Cutting parameters out of Markdown reports: headings carried down, columns by their headers, footnotes by their marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ingest import blank_to_null, lines, number_range

c = F.col

#: What a column's header may be called, and the unit where the header names none. Without a unit: scope.
ROLES = {
    "cutting_speed": (["vc", "cutting speed"], "m/min"),
    "feed_per_tooth": (["fz", "feed per tooth"], "mm/tooth"),
    "feed_per_rev": (["f", "fn", "feed per revolution"], "mm/rev"),
    "depth_of_cut": (["ap", "depth of cut"], "mm"),
    "iso_group": (["iso", "iso group", "material group", "material"], None),
    "tool_material": (["tool", "tool material"], None),
}
OPERATIONS = ["turning", "milling", "drilling", "reaming", "boring", "grinding"]
#: A table has a header, a rule and a row at least.
LEAST_LINES = 3


def _role(header: Column) -> Column:
    name = F.trim(F.regexp_replace(F.lower(header), r"\([^)]*\)|\[[^\]]*\]|[*†]", ""))
    return F.coalesce(*[F.when(name.isin(names), F.lit(role)) for role, (names, _) in ROLES.items()])


def _unit(header: Column, role: Column) -> Column:
    said = blank_to_null(F.regexp_extract(F.lower(header), r"[(\[]([^)\]]*)[)\]]", 1))
    return F.coalesce(said, *[F.when(role == r, F.lit(u)) for r, (_, u) in ROLES.items() if u])


def table_cells(reports: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Cells of the tables of reports: key, section (last heading above), table_no, row_no (0: header), col_no, cell, header, note.

    A table is a run of lines between bars; a rule line isn't a row. note is the section's line that begins with the mark (* or †)
    that ends a cell. Cells that a row has beyond its header have no header.
    """
    rows = lines(reports.select(key, F.col(text).alias("text"))).withColumn("text", F.trim("text"))
    w = W.partitionBy(key).orderBy("line_no")
    heading = F.when(c("text").rlike("^#+ "), F.trim(F.regexp_replace("text", "^#+ *", "")))
    rows = rows.withColumn("bar", F.startswith("text", F.lit("|"))).withColumn("section_no", F.sum(heading.isNotNull().cast("int")).over(w))
    rows = rows.withColumn("section", F.last(heading, ignorenulls=True).over(w))
    rows = rows.withColumn("table_no", F.sum((c("bar") & ~F.coalesce(F.lag("bar").over(w), F.lit(False))).cast("int")).over(w))
    notes = rows.filter(~c("bar") & c("text").rlike("^[*†] ")).groupBy(key, "section_no", F.substring("text", 1, 1).alias("mark")).agg(F.min_by(F.trim(F.regexp_replace("text", "^[*†] *", "")), "line_no").alias("note"))
    inside = rows.filter("bar").withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(key, "table_no"))).filter(c("_n") >= LEAST_LINES).filter(~c("text").rlike(r"^[\s|:-]+$"))
    inside = inside.withColumn("row_no", F.row_number().over(W.partitionBy(key, "table_no").orderBy("line_no")) - 1)
    split = F.transform(F.split(F.regexp_replace("text", r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    cells = inside.select(key, "section_no", "section", "table_no", "row_no", F.posexplode(split).alias("col_no", "cell"))
    header = F.max(F.when(c("row_no") == 0, c("cell"))).over(W.partitionBy(key, "table_no", "col_no"))
    cells = cells.withColumn("header", header).withColumn("mark", blank_to_null(F.regexp_extract("cell", r"([*†])$", 1)))
    return cells.join(notes, [key, "section_no", "mark"], "left").select(key, "section", "table_no", "row_no", "col_no", "cell", "header", "note")


def parameters(reports: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Parameter records of reports: key, source, operation, iso_group, tool_material, parameter_type, unit, low, high, note, problem.

    Only tables whose section or header names an operation, and columns whose header names a parameter, give records; a table's row gives
    one for each. An empty cell and a dash give none. problem tells why a record can't be used: NO_RANGE (the cell isn't a number or a
    range), REVERSED, NO_SCOPE (no material group); such records stay in the result. source is section, table and row.
    """
    cells = table_cells(reports, key, text).withColumn("role", _role(c("header")))
    table, row = W.partitionBy(key, "table_no"), W.partitionBy(key, "table_no", "row_no")
    words = F.lower(F.concat_ws(" ", c("section"), F.max(F.when((c("row_no") == 0) & (c("col_no") == 0), c("header"))).over(table)))
    operation = F.coalesce(*[F.when(words.rlike(rf"\b{o}\b"), F.lit(o)) for o in OPERATIONS])
    bare = blank_to_null(F.regexp_replace("cell", r"[*†]$", ""))
    scope = lambda r: F.max(F.when(c("role") == r, bare)).over(row)
    cells = cells.withColumns({"operation": operation, "iso_group": scope("iso_group"), "tool_material": scope("tool_material"), "bare": bare, "unit": _unit(c("header"), c("role"))})
    found = cells.filter((c("row_no") > 0) & c("operation").isNotNull() & c("role").isin([r for r, (_, u) in ROLES.items() if u]) & c("bare").isNotNull() & ~c("bare").isin("-", "–", "—"))
    found = found.withColumn("r", number_range(c("bare")))
    problem = F.when(c("r.low").isNull() | c("r.high").isNull(), "NO_RANGE").when(c("r.low") > c("r.high"), "REVERSED").when(c("iso_group").isNull(), "NO_SCOPE")
    source = F.concat_ws("/", c("section"), c("table_no"), c("row_no"))
    return found.select(key, source.alias("source"), "operation", "iso_group", "tool_material", c("role").alias("parameter_type"), "unit", c("r.low").alias("low"), c("r.high").alias("high"), "note", problem.alias("problem"))
