"""Feature control frames out of text, and features out of requirements that are each used once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

c = F.col

#: The geometric characteristics, and the signs for them.
CHARACTERISTICS = [
    "STRAIGHTNESS", "FLATNESS", "CIRCULARITY", "CYLINDRICITY", "PROFILE_OF_A_LINE", "PROFILE_OF_A_SURFACE", "PERPENDICULARITY", "ANGULARITY", "PARALLELISM", "POSITION", "CONCENTRICITY", "SYMMETRY", "CIRCULAR_RUNOUT", "TOTAL_RUNOUT",
]
SIGNS = {"⏤": "STRAIGHTNESS", "⏥": "FLATNESS", "○": "CIRCULARITY", "⌭": "CYLINDRICITY", "⌒": "PROFILE_OF_A_LINE", "⌓": "PROFILE_OF_A_SURFACE", "⟂": "PERPENDICULARITY", "∠": "ANGULARITY", "∥": "PARALLELISM", "⌖": "POSITION", "◎": "CONCENTRICITY", "⌯": "SYMMETRY", "↗": "CIRCULAR_RUNOUT", "⌰": "TOTAL_RUNOUT"}
MODIFIERS = {"MMC": "MMC", "LMC": "LMC", "RFS": "RFS", "Ⓜ": "MMC", "Ⓛ": "LMC"}
UNITS = {"MM": "mm", "IN": "inch", "INCH": "inch"}
_LEX = f"[0-9]+(?:[.][0-9]+)?|[A-Z_]+|[Ø⌀ⓂⓁ{''.join(SIGNS)}]"
_STATE = "struct<name:array<string>,value:double,unit:string,diameter:boolean,modifier:string,datums:array<string>>"


def _named(x: Column, names: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(x == k, F.lit(v)) for k, v in names.items()], F.lit(None).cast("string"))


def _step(s: Column, x: Column) -> Column:
    """The state after a token: before the value come the name and the diameter sign, behind it unit, modifier and datum letters."""
    before = s["value"].isNull()
    number, diameter = x.rlike("^[0-9]"), x.isin("Ø", "⌀")
    modifier, unit = _named(x, MODIFIERS), _named(x, UNITS)
    word = before & ~number & ~diameter & modifier.isNull()
    letter = ~before & x.rlike("^[A-Z]$") & ~F.array_contains(s["datums"], x)
    return F.struct(
        F.when(word, F.array_append(s["name"], F.coalesce(_named(x, SIGNS), x))).otherwise(s["name"]).alias("name"),
        F.when(before & number, x.try_cast("double")).otherwise(s["value"]).alias("value"),
        F.when(~before & s["unit"].isNull(), unit).otherwise(s["unit"]).alias("unit"),
        (s["diameter"] | (before & diameter)).alias("diameter"),
        F.coalesce(s["modifier"], modifier).alias("modifier"),
        F.when(letter, F.array_append(s["datums"], x)).otherwise(s["datums"]).alias("datums"),
    ).cast(_STATE)


def segment(text: Column, characteristic: Column | None = None) -> Column:
    """struct(characteristic, tolerance, unit, diameter, modifier, datums) of a frame's text; NULL where it names no characteristic.

    ``characteristic`` stands in for a band that doesn't repeat it. Datums are in order, each once. Without a unit it is mm; without a
    number there is neither tolerance nor unit, and what would follow it isn't read.
    """
    zero = F.struct(F.array().cast("array<string>").alias("name"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(False).alias("diameter"), F.lit(None).cast("string").alias("modifier"), F.array().cast("array<string>").alias("datums"))
    tokens = F.regexp_extract_all(F.translate(F.upper(text), ",", "."), F.lit(_LEX), F.lit(0))
    state = F.aggregate(tokens, zero.cast(_STATE), _step)

    def out(s: Column) -> Column:
        said = F.array_join(s["name"], "_")
        name = F.when(said.isin(CHARACTERISTICS), said)
        name = name if characteristic is None else F.coalesce(name, characteristic)
        unit = F.when(s["value"].isNotNull(), F.coalesce(s["unit"], F.lit("mm")))
        return F.when(name.isNotNull(), F.struct(name.alias("characteristic"), s["value"].alias("tolerance"), unit.alias("unit"), s["diameter"].alias("diameter"), s["modifier"].alias("modifier"), s["datums"].alias("datums")))

    return F.transform(F.array(state), out)[0]


def composite(upper: Column, lower: Column) -> Column:
    """struct(upper, lower, state) of a frame in two bands; the lower one takes the upper's characteristic where it names none.

    state: COMPOSITE; NO_FRAME where the upper band is none; NO_TOLERANCE where a band has none; LOWER_LARGER where the lower tolerance
    is above the upper's (not a valid frame); UNITS_DIFFER where they can't be compared.
    """
    top = segment(upper)

    def both(u: Column) -> Column:
        low = segment(lower, u["characteristic"])
        state = (
            F.when(u.isNull(), "NO_FRAME").when(u["tolerance"].isNull() | low["tolerance"].isNull(), "NO_TOLERANCE").when(u["unit"] != low["unit"], "UNITS_DIFFER")
            .when(low["tolerance"] > u["tolerance"], "LOWER_LARGER").otherwise("COMPOSITE")
        )
        return F.struct(u.alias("upper"), low.alias("lower"), state.alias("state"))

    return F.transform(F.array(top), both)[0]


#: What a dimension's note or type says it is, in the order of trial, with the rule's id.
BY_WORD = [("slot", "SLOT", "R-FR-003"), ("pocket", "POCKET", "R-FR-004"), ("chamfer", "CHAMFER", "R-FR-007"), ("fillet", "FILLET", "R-FR-008"), ("radius", "FILLET", "R-FR-008"), ("groove", "GROOVE", "R-FR-009")]


def recognised(requirements: DataFrame) -> DataFrame:
    """(drawing_id, req_id, feature_type, rule, size, depth_req_id, depth): features out of requirements, each of which is used once.

    requirements: drawing_id, req_id (their order), kind (THREAD or DIMENSION), dimension_type, value, note. Threads are features; the
    k-th diameter of a drawing is a hole with its k-th depth, if there are so many; what is left is taken by its words, and is no
    feature without any.
    """
    kind = F.lower(F.coalesce("dimension_type", F.lit("")))
    thread = c("kind") == "THREAD"
    role = F.when(thread, "T").when(kind.contains("diameter"), "D").when(kind.contains("depth"), "Z").otherwise("O")
    d = requirements.select("drawing_id", "req_id", "value", role.alias("role"), F.concat_ws(" ", kind, F.lower("note")).alias("words"))
    d = d.withColumn("k", F.row_number().over(W.partitionBy("drawing_id", "role").orderBy("req_id")))
    holes = d.filter("role = 'D'")
    depth = d.filter("role = 'Z'").select("drawing_id", "k", c("req_id").alias("depth_req_id"), c("value").alias("depth"))
    hole = holes.join(depth, ["drawing_id", "k"], "left").select("drawing_id", "req_id", F.lit("HOLE").alias("feature_type"), F.lit("R-FR-002").alias("rule"), c("value").alias("size"), "depth_req_id", "depth")
    many = holes.groupBy("drawing_id").agg(F.max("k").alias("_n"))
    left = d.filter("role IN ('O', 'Z')").join(many, "drawing_id", "left").filter((c("role") == "O") | (c("k") > F.coalesce("_n", F.lit(0))))
    said = F.coalesce(*[F.when(c("words").contains(w), F.struct(F.lit(f).alias("f"), F.lit(r).alias("r"))) for w, f, r in BY_WORD])
    none = [F.lit(None).cast(depth.schema["depth_req_id"].dataType).alias("depth_req_id"), F.lit(None).cast(depth.schema["depth"].dataType).alias("depth")]
    worded = left.withColumn("s", said).filter("s IS NOT NULL").select("drawing_id", "req_id", c("s.f").alias("feature_type"), c("s.r").alias("rule"), c("value").alias("size"), *none)
    threads = d.filter("role = 'T'").select("drawing_id", "req_id", F.lit("THREAD").alias("feature_type"), F.lit("R-FR-001").alias("rule"), c("value").alias("size"), *none)
    return threads.unionByName(hole).unionByName(worded)
