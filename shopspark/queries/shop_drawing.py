"""Drawing text, annotations, requirements and features, review links, evidence."""

from pyspark.sql import functions as F

from ..operators import drawing as dr
from ..operators import frames as fr
from ..operators import fusion as fu
from .registry import query

c = F.col


_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_T = "replace(replace(replace(replace(trim(text), '×', 'x'), '–', '-'), '—', '-'), ',', '.')"
#: Lexemes (lx), their capitals (up), shape (sh) and whether they are all of the text (wh); then kind (k) and size.
_LEX = f"""lx0 AS (SELECT *, {_T} AS t, regexp_extract_all({_T}, '{dr.LEXEME}') AS lx FROM v_token),
  lx1 AS (SELECT *, list_transform(lx, lambda x: upper(x)) AS up, array_to_string(list_transform(lx, lambda x: CASE WHEN x[1] BETWEEN '0' AND '9' THEN 'n' WHEN x IN ('-', '/', '#') THEN x ELSE 'a' END), '') AS sh, array_to_string(lx, '') = regexp_replace(t, '[ \\t]+', '', 'g') AS wh FROM lx0),
  tk AS (SELECT *, CASE WHEN wh AND regexp_matches(sh, '{dr.SHAPES['THREAD_METRIC']}') AND up[1] = 'M' AND (sh NOT LIKE 'anan%' OR up[3] = 'X') AND (sh NOT LIKE '%-a' OR up[-1] IN {_IN(dr.HANDS)}) THEN 'THREAD_METRIC'
    WHEN wh AND regexp_matches(sh, '{dr.SHAPES['THREAD_UN']}') AND list_has_any(up, [{_IN(dr.UNIFIED)[1:-1]}]) THEN 'THREAD_UN' WHEN wh AND regexp_matches(sh, '{dr.SHAPES['THREAD_BSP']}') AND up[1] IN {_IN(dr.PARALLEL)} AND (sh NOT LIKE '%a' OR up[-1] IN ('A', 'B')) THEN 'THREAD_BSP'
    WHEN wh AND regexp_matches(sh, '{dr.SHAPES['THREAD_NPT']}') AND up[-1] IN {_IN(dr.PIPE)} THEN 'THREAD_NPT' WHEN wh AND regexp_matches(sh, '{dr.SHAPES['FIT_PAIR']}') AND length(up[1]) <= 3 AND length(up[4]) <= 3 THEN 'FIT_PAIR'
    WHEN wh AND regexp_matches(sh, '{dr.SHAPES['FIT_SIZED']}') AND (sh LIKE 'n%' OR up[1] IN {_IN(dr.DIAMETER)}) AND length(up[-2]) <= 3 THEN 'FIT_SIZED'
    WHEN wh AND regexp_matches(sh, '{dr.SHAPES['SURFACE_FINISH']}') AND up[1] IN {_IN(dr.FINISH)} AND (sh NOT LIKE '%a' OR up[-1] IN {_IN(dr.FINISH_UNITS)}) THEN 'SURFACE_FINISH' WHEN array_to_string(up, '') IN {_IN(dr.PROHIBITED)} THEN 'NO_MACHINING' END AS k,
    ' ' || array_to_string(regexp_extract_all(upper(text), '[A-Z]+|[0-9]+'), ' ') || ' ' AS plain FROM lx1)"""


@query("drawing_tokens", f"WITH {_LEX} SELECT drawing_id, token_id, s, k AS kind, CASE WHEN k IN ('THREAD_METRIC', 'FIT_SIZED', 'SURFACE_FINISH') THEN TRY_CAST(list_filter(lx, lambda x: x[1] BETWEEN '0' AND '9')[1] AS DOUBLE) END AS size FROM tk")
def drawing_tokens(shop):
    """Thread, fit and finish tokens."""
    return shop.v_token.select("drawing_id", "token_id", "s", dr.token_kind(c("text")).alias("kind"), dr.token_size(c("text")).alias("size"))


@query("drawing_notes", f"""WITH {_LEX} SELECT drawing_id, token_id, s, CASE WHEN contains(plain, ' DIMENSION IN ') OR contains(plain, ' DIMENSIONS IN ') THEN 'UNIT' WHEN contains(plain, ' ISO 2768 ') THEN 'GENERAL_TOLERANCE' WHEN regexp_matches(plain, ' DATUM [A-Z] ') THEN 'DATUM' WHEN k LIKE 'THREAD%' THEN 'THREAD' WHEN k LIKE 'FIT%' THEN 'FIT' WHEN k IS NOT NULL THEN 'SURFACE_FINISH' ELSE 'TEXT' END AS category,
  CASE WHEN k IS NOT NULL THEN 0.95 ELSE 0.6 END AS confidence, k IS NULL AS needs_review FROM tk""")
def drawing_notes(shop):
    """Category, confidence of the way of reading, review below 0.85."""
    d = shop.v_token.withColumn("k", dr.token_kind(c("text")))
    sure = dr.confidence(F.when(c("k").isNotNull(), "EXACT_PATTERN").otherwise("HEURISTIC"))
    return d.select("drawing_id", "token_id", "s", dr.note_category(c("text")).alias("category"), sure.alias("confidence"), (sure < dr.REVIEW_BELOW).alias("needs_review"))


@query("drawing_units", """WITH d AS (SELECT drawing_id, bool_or(text = 'ALL DIMENSIONS IN MM') AS said FROM v_token GROUP BY drawing_id) SELECT drawing_id, CASE WHEN drawing_id % 5 = 0 THEN 'inch' WHEN said THEN 'mm' WHEN drawing_id % 3 = 0 THEN 'inch' WHEN drawing_id % 3 = 1 THEN 'mm' END AS unit FROM d""")
def drawing_units(shop):
    d = shop.v_token.groupBy("drawing_id").agg(F.max(F.when(c("text").rlike("(?i)DIMENSIONS IN"), c("text"))).alias("note"))
    standard = F.when(c("drawing_id") % 3 == 0, "ASME Y14.5").when(c("drawing_id") % 3 == 1, "ISO 8015")
    return d.select("drawing_id", dr.drawing_unit(F.when(c("drawing_id") % 5 == 0, "inches"), c("note"), standard).alias("unit"))


@query("unit_names", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE l_partkey % 6 WHEN 0 THEN 'mm' WHEN 1 THEN 'inch' WHEN 2 THEN 'um' WHEN 3 THEN 'deg' WHEN 4 THEN 'kg' END AS unit, CASE l_linenumber % 4 WHEN 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'SHAFT' ELSE 'HOLE' END WHEN 1 THEN 'THREADED_HOLE' WHEN 2 THEN CASE l_suppkey % 3 WHEN 0 THEN 'HOLE' WHEN 1 THEN 'FILLET' ELSE 'PLANAR_FACE' END ELSE 'UNKNOWN' END AS feature FROM lineitem""")
def unit_names(shop):
    """One name per unit, and the likely feature of an annotation."""
    raw = F.get(F.array(*map(F.lit, [" MM ", "Inches", "µm", "°", " Kg", None])), (c("l_partkey") % 6).cast("int"))
    kind = F.get(F.array(*map(F.lit, ["FIT", "THREAD", "DIMENSION", "LOGO"])), (c("l_linenumber") % 4).cast("int"))
    sub = F.when(c("l_linenumber") % 4 == 0, F.when(c("l_suppkey") % 2 == 0, "SHAFT_g6").otherwise("HOLE_H7")).otherwise(F.get(F.array(F.lit("DIAMETRAL"), F.lit("RADIAL"), F.lit("LINEAR")), (c("l_suppkey") % 3).cast("int")))
    return shop.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", dr.unit_name(raw).alias("unit"), dr.likely_feature(kind, sub).alias("feature"))


def _suits(kind, ft):
    return "CASE " + " ".join(f"WHEN {kind} = '{a}' AND {ft} = '{f}' THEN {v}" for (a, f), v in dr.SUITS.items()) + " ELSE 0.5 END"


_ANN = "an AS (SELECT DISTINCT drawing_id, page, token_id AS annotation_id, s, CASE token_id % 4 WHEN 0 THEN 'DIMENSION' WHEN 1 THEN 'FIT' WHEN 2 THEN 'THREAD' ELSE 'GDT' END AS kind, x, y FROM v_token), fe AS (SELECT DISTINCT part_id AS drawing_id, feature_id % 3 AS page, feature_id, feature_type, x * 6 AS x, y * 4 AS y FROM v_feature)"
_ASSOC = f"""{_ANN}, p AS (SELECT an.drawing_id, an.page, annotation_id, s, feature_id, 0.6 * greatest(0, 1 - sqrt(pow(an.x - fe.x, 2) + pow(an.y - fe.y, 2)) / 72) + 0.4 * {_suits('kind', 'feature_type')} AS score FROM an JOIN fe ON fe.drawing_id = an.drawing_id AND fe.page = an.page),
  b AS (SELECT drawing_id, page, annotation_id, s, feature_id, max(score) AS score FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY drawing_id, page, annotation_id, s ORDER BY score DESC, feature_id) AS rank FROM b)"""


def _annotations(shop):
    kind = F.get(F.array(F.lit("DIMENSION"), F.lit("FIT"), F.lit("THREAD"), F.lit("GDT")), (c("token_id") % 4).cast("int"))
    return shop.v_token.select("drawing_id", "page", F.struct("token_id", "s").alias("annotation_id"), kind.alias("kind"), "x", "y")


def _associated(shop):
    an = _annotations(shop)
    fe = shop.v_feature.select(c("part_id").alias("drawing_id"), (c("feature_id") % 3).cast("int").alias("page"), "feature_id", "feature_type", (c("x") * 6).alias("x"), (c("y") * 4).alias("y"))
    return dr.associated(an, fe, ["drawing_id", "page"])


@query("association_candidates", f"WITH {_ASSOC} SELECT drawing_id, page, annotation_id, s, feature_id, round(score, 6) AS score FROM r WHERE rank <= 5")
def association_candidates(shop):
    """The five best features of an annotation's page."""
    return _associated(shop).select("drawing_id", "page", c("annotation_id.token_id").alias("annotation_id"), c("annotation_id.s").alias("s"), "feature_id", F.round("score", 6).alias("score"))


@query("association_states", f"WITH {_ASSOC}, g AS (SELECT drawing_id, page, annotation_id, s, max(score) FILTER (WHERE rank = 1) AS s1, max(score) FILTER (WHERE rank = 2) AS s2, max(feature_id) FILTER (WHERE rank = 1) AS f FROM r WHERE rank <= 2 GROUP BY ALL) SELECT an.drawing_id, an.page, an.annotation_id, an.s, CASE WHEN s1 >= 0.7 AND (s2 IS NULL OR s2 < s1 - 0.15) THEN f END AS feature_id, CASE WHEN s1 IS NULL THEN 'UNRESOLVED' WHEN s1 >= 0.7 AND (s2 IS NULL OR s2 < s1 - 0.15) THEN 'AUTO_MATCHED' ELSE 'MULTIPLE_CANDIDATES' END AS state FROM (SELECT DISTINCT drawing_id, page, annotation_id, s FROM an) an LEFT JOIN g USING (drawing_id, page, annotation_id, s)")
def association_states(shop):
    """The best is taken where it leads by enough."""
    out = dr.association_state(_annotations(shop), _associated(shop), ["drawing_id", "page", "annotation_id"])
    return out.select("drawing_id", "page", c("annotation_id.token_id").alias("annotation_id"), c("annotation_id.s").alias("s"), "feature_id", "state")


_FE = """SELECT DISTINCT part_id, feature_id, CASE feature_id % 11 WHEN 0 THEN 'THROUGH_HOLE' WHEN 1 THEN 'BLIND_HOLE' WHEN 2 THEN 'HOLE' WHEN 3 THEN 'OPEN_SLOT' WHEN 4 THEN 'CLOSED_POCKET' WHEN 5 THEN 'PLANAR_FACE'
    WHEN 6 THEN 'OUTER_DIAMETER' WHEN 7 THEN 'INNER_DIAMETER' WHEN 8 THEN 'CHAMFER' WHEN 9 THEN 'FILLET' ELSE 'BOSS' END AS feature_type,
  CASE WHEN feature_id % 11 IN (0, 1, 2, 6, 7, 10) THEN d_mm END AS diameter, CASE WHEN feature_id % 11 IN (3, 4) THEN d_mm END AS width, CASE WHEN feature_id % 11 = 5 THEN depth_mm END AS length FROM {v_feature}"""
#: Every 19th part's requirements name a part without features, which leaves features without requirements.
_RQ = """SELECT DISTINCT CASE WHEN plan_id % 19 = 0 THEN -plan_id ELSE plan_id END AS part_id, characteristic_id, s, CASE WHEN s % 11 = 0 THEN 'NOTE' WHEN s % 11 = 1 THEN 'FIT' WHEN s % 11 = 2 THEN 'DATUM' WHEN s % 37 = 3 THEN NULL
    WHEN char_type = 'GDT' THEN 'GDT_FCF' ELSE char_type END AS kind, CASE WHEN s % 7 = 4 THEN NULL ELSE 0.5 + CAST(s % 11 AS DOUBLE) / 20 END AS source,
  CASE WHEN s % 13 = 5 THEN 'as shown' ELSE CASE s % 4 WHEN 0 THEN 'Ø' WHEN 1 THEN 'W ' WHEN 2 THEN 'diam. ' ELSE '' END || CAST(CAST(floor(nominal / 5) AS BIGINT) AS STRING) || ',' || CAST(CAST(floor(nominal) AS BIGINT) % 5 * 2 AS STRING) || CASE s % 3 WHEN 0 THEN ' depth' ELSE '' END END AS value FROM {v_char}"""
_SEVEN = "CASE " + " ".join(f"WHEN kind = '{k}' AND feature_type = '{f}' THEN {v}" for k, own in fu.SUITS.items() for f, v in own.items()) + f" ELSE {fu.OTHER} END"
_FUSED = f"""fe AS ({_FE.format(v_feature='v_feature')}), rq AS ({_RQ.format(v_char='v_char')}),
  pr AS (SELECT *, CAST(nullif(regexp_extract(replace(value, ',', '.'), '[0-9]+(\\.[0-9]+)?', 0), '') AS DOUBLE) AS asked, coalesce(value LIKE '%Ø%' OR lower(value) LIKE '%diam%', false) AS dia FROM rq),
  ow AS (SELECT pr.*, feature_id, feature_type, CASE WHEN kind = 'DIMENSION' AND NOT dia THEN coalesce(diameter, width, length) ELSE diameter END AS own FROM pr JOIN fe USING (part_id) WHERE kind NOT IN ('NOTE', 'TITLE_FIELD', 'UNKNOWN', 'GENERAL_TOLERANCE')),
  sc AS (SELECT *, round(0.25 * {_SEVEN} + 0.25 * CASE WHEN asked IS NULL THEN 0.5 WHEN kind IN ('SURFACE_FINISH', 'GDT_FCF') THEN 0.6 WHEN kind = 'DATUM' OR own IS NULL THEN 0.4 WHEN round(abs(asked - own), 9) <= 0.1 THEN 1
      WHEN round(abs(asked - own), 9) <= 0.5 THEN 0.85 WHEN round(abs(asked - own), 9) <= 2 THEN 0.6 WHEN round(abs(asked - own), 9) <= 10 THEN 0.3 ELSE 0.1 END + 0.2 + 0.05 * coalesce(source, 0.5), 6) AS score FROM ow),
  rk AS (SELECT *, row_number() OVER (PARTITION BY part_id, characteristic_id, s, kind, source, value ORDER BY score DESC, feature_id) AS rank FROM sc),
  tp AS (SELECT part_id, characteristic_id, s, kind, value, max(score) FILTER (WHERE rank = 1) AS score, max(score) FILTER (WHERE rank = 2) AS second, string_agg(feature_id::VARCHAR, ',' ORDER BY rank) AS candidates, max(feature_id) FILTER (WHERE rank = 1) AS best FROM rk WHERE rank <= 3 GROUP BY ALL),
  lk AS (SELECT pr.part_id, pr.characteristic_id AS req_id, pr.s, score, candidates, best, CASE WHEN pr.kind = 'DIMENSION' THEN CASE WHEN dia THEN 'DIAMETER' WHEN lower(pr.value) LIKE '%depth%' THEN 'DEPTH' WHEN pr.value LIKE '%W%' THEN 'WIDTH' ELSE 'LINEAR' END END AS role,
      CASE WHEN score IS NULL THEN 'DRAWING_ONLY' WHEN score < 0.7 THEN 'UNRESOLVED' WHEN coalesce(round(score - second, 6) < 0.15, false) THEN 'MULTIPLE_CANDIDATES' ELSE 'AUTO_MATCHED' END AS state
    FROM pr LEFT JOIN tp ON tp.part_id = pr.part_id AND tp.characteristic_id = pr.characteristic_id AND tp.s = pr.s AND tp.kind IS NOT DISTINCT FROM pr.kind AND tp.value IS NOT DISTINCT FROM pr.value),
  lo AS (SELECT DISTINCT part_id, feature_id, feature_type, k.part_id IS NOT NULL AND feature_type NOT IN ('CHAMFER', 'FILLET', 'EDGE_BREAK') AS asks FROM fe LEFT JOIN (SELECT DISTINCT part_id FROM rq) k USING (part_id)
    WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.state = 'AUTO_MATCHED' AND lk.part_id = fe.part_id AND lk.best = fe.feature_id) AND (k.part_id IS NULL OR feature_type <> 'PLANAR_FACE'))"""


def _fusion(shop):
    rows = lambda sql, **view: shop.spark.sql(sql.replace("SELECT DISTINCT", "SELECT", 1), **view).repartition("part_id").distinct()
    requirements = rows(_RQ, v_char=shop.v_char).select("part_id", F.struct("characteristic_id", "s").alias("req_id"), "kind", "value", "source")
    features = rows(_FE, v_feature=shop.v_feature)
    return requirements, features, fu.links(requirements, features)


@query("fusion_states", f"WITH {_FUSED} SELECT part_id, req_id, s, role, score, CASE WHEN state = 'MULTIPLE_CANDIDATES' THEN candidates END AS candidates, CASE WHEN state IN ('AUTO_MATCHED', 'MULTIPLE_CANDIDATES') THEN best END AS feature_id, state FROM lk")
def fusion_states(shop):
    """Requirements of a part met with its features by a score of seven parts."""
    several = F.when(c("state") == "MULTIPLE_CANDIDATES", F.array_join("candidates", ","))
    return _fusion(shop)[2].select("part_id", c("req_id.characteristic_id").alias("req_id"), c("req_id.s").alias("s"), "role", "score", several.alias("candidates"), "feature_id", "state")


@query("unasked_features", f"WITH {_FUSED} SELECT part_id, feature_id, feature_type, asks FROM lo")
def unasked_features(shop):
    """Features that no requirement is matched with."""
    return fu.leftovers(*_fusion(shop))


@query("fusion_outcomes", f"""WITH {_FUSED}, r AS (SELECT part_id, count(*) AS n_requirements, count(*) FILTER (WHERE state = 'AUTO_MATCHED') AS n_matched, count(*) FILTER (WHERE state = 'MULTIPLE_CANDIDATES') AS n_multiple, count(*) FILTER (WHERE state = 'UNRESOLVED') AS n_unresolved, count(*) FILTER (WHERE state IN ('UNRESOLVED', 'DRAWING_ONLY')) AS n_drawing_only FROM lk GROUP BY part_id),
  f AS (SELECT part_id, count(DISTINCT feature_id) AS n_features FROM fe GROUP BY part_id), u AS (SELECT part_id, count(*) AS n_cad_only, count(*) FILTER (WHERE asks) AS n_asks FROM lo GROUP BY part_id),
  d AS (SELECT part_id, coalesce(n_requirements, 0) AS n_requirements, coalesce(n_features, 0) AS n_features, coalesce(n_matched, 0) AS n_matched, coalesce(n_multiple, 0) AS n_multiple, coalesce(n_unresolved, 0) AS n_unresolved, coalesce(n_drawing_only, 0) AS n_drawing_only, coalesce(n_cad_only, 0) AS n_cad_only, coalesce(n_asks, 0) AS n_asks FROM r FULL JOIN f USING (part_id) LEFT JOIN u USING (part_id))
  SELECT part_id, n_requirements, n_features, n_matched, n_multiple, n_drawing_only, n_cad_only, n_multiple + n_unresolved + n_asks AS n_ambiguities, CASE WHEN n_requirements = 0 THEN 'CAD_ONLY' WHEN n_matched = 0 THEN 'DRAWING_ONLY' WHEN n_drawing_only = 0 AND n_cad_only = 0 THEN 'FULL' ELSE 'PARTIAL' END AS completeness FROM d""")
def fusion_outcomes(shop):
    """How complete the fusion of each part is."""
    requirements, features, linked = _fusion(shop)
    return fu.outcomes(linked, features, fu.leftovers(requirements, features, linked))


@query("link_states", """WITH e AS (SELECT user_id AS requirement_id, event_id, ts, CASE event_type WHEN 'click' THEN 'confirm' WHEN 'view' THEN 'reassign' WHEN 'error' THEN 'mark_drawing_only' ELSE 'comment' END AS action, CAST(floor(value) AS BIGINT) % 3 AS feature_id FROM events),
  m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY requirement_id ORDER BY ts DESC, event_id DESC) AS n FROM e WHERE action IN ('reassign', 'mark_drawing_only')) WHERE n = 1),
  k AS (SELECT e.requirement_id, max_by(e.feature_id, {'t': e.ts, 'i': e.event_id}) AS confirmed FROM e LEFT JOIN m USING (requirement_id) WHERE e.action = 'confirm' AND (m.ts IS NULL OR (e.ts, e.event_id) > (m.ts, m.event_id)) AND (m.action IS NULL OR (m.action = 'reassign' AND m.feature_id = e.feature_id)) GROUP BY e.requirement_id)
  SELECT u.requirement_id, CASE WHEN m.action = 'reassign' THEN m.feature_id WHEN k.requirement_id IS NOT NULL THEN confirmed END AS feature_id, CASE WHEN m.action = 'mark_drawing_only' THEN 'DRAWING_ONLY' WHEN m.action IS NOT NULL OR k.requirement_id IS NOT NULL THEN 'USER_MATCHED' ELSE 'PENDING' END AS status FROM (SELECT DISTINCT requirement_id FROM e) u LEFT JOIN m USING (requirement_id) LEFT JOIN k USING (requirement_id)""")
def link_states(shop):
    """Links after review events."""
    action = F.when(c("event_type") == "click", "confirm").when(c("event_type") == "view", "reassign").when(c("event_type") == "error", "mark_drawing_only").otherwise("comment")
    return dr.link_state(shop.events.select(c("user_id").alias("requirement_id"), "event_id", "ts", action.alias("action"), (F.floor("value").cast("long") % 3).alias("feature_id")))


_EV = "ev AS (SELECT l_orderkey AS page, CASE WHEN l_suppkey % 2 = 0 THEN 'AI' ELSE 'RULE' END AS side, l_partkey AS finding_id, l_linenumber AS source_id, l_partkey % 3 AS value FROM lineitem)"


@query("evidence_states", f"""WITH RECURSIVE {_EV}, nd AS (SELECT DISTINCT page, side, finding_id, value FROM ev), ed AS (SELECT DISTINCT a.page, a.side AS s1, a.finding_id AS f1, b.side AS s2, b.finding_id AS f2 FROM ev a JOIN ev b ON a.page = b.page AND a.source_id = b.source_id),
  t AS (SELECT page, s1, f1, s2, f2 FROM ed UNION SELECT t.page, t.s1, t.f1, ed.s2, ed.f2 FROM t JOIN ed ON ed.page = t.page AND ed.s1 = t.s2 AND ed.f1 = t.f2), cp AS (SELECT page, s1 AS side, f1 AS finding_id, min(s2 || lpad(CAST(f2 AS VARCHAR), 12, '0')) AS grp FROM t GROUP BY page, s1, f1),
  g AS (SELECT page, grp, count(DISTINCT CASE WHEN side = 'AI' THEN value END) AS a, count(DISTINCT CASE WHEN side = 'RULE' THEN value END) AS r, count(DISTINCT value) AS v FROM nd JOIN cp USING (page, side, finding_id) GROUP BY page, grp)
  SELECT page, CASE WHEN r = 0 THEN 'AI_ONLY' WHEN a = 0 THEN 'DETERMINISTIC_ONLY' WHEN a > 1 OR r > 1 THEN 'AMBIGUOUS' WHEN v = 1 THEN 'AGREES' ELSE 'CONFLICTS' END AS state, count(*) AS n FROM g GROUP BY ALL""")
def evidence_states(shop):
    """Evidence that shares source objects on a page, as groups with a state."""
    side = F.when(c("l_suppkey") % 2 == 0, "AI").otherwise("RULE")
    ev = shop.lineitem.select(c("l_orderkey").alias("page"), side.alias("side"), c("l_partkey").alias("finding_id"), c("l_linenumber").alias("source_id"), (c("l_partkey") % 3).alias("value"))
    of = lambda s: ev.filter(c("side") == s).select("page", "finding_id", "value").distinct()
    out = dr.reconciled(of("AI"), of("RULE"), dr.evidence_groups(ev))
    return out.groupBy("page", "state").agg(F.count(F.lit(1)).alias("n"))


@query("frame_segments", """SELECT drawing_id, frame_id, line_no, s, CASE WHEN line_no % 7 = 6 THEN NULL WHEN characteristic = 'PROFILE_OF_SURFACE' THEN 'PROFILE_OF_A_SURFACE' ELSE characteristic END AS characteristic, CASE WHEN line_no % 7 <> 6 THEN tolerance END AS tolerance, CASE WHEN line_no % 7 <> 6 THEN CASE WHEN s % 3 = 0 THEN 'inch' ELSE 'mm' END END AS unit,
  CASE WHEN line_no % 7 <> 6 THEN is_hole END AS diameter, CASE WHEN line_no % 7 <> 6 THEN modifier END AS modifier, CASE WHEN line_no % 7 <> 6 THEN coalesce(CASE length(datums) WHEN 2 THEN 'A,B' ELSE datums END, '') END AS datums,
  CASE WHEN line_no % 7 = 6 THEN 'NO_FRAME' WHEN lower_tolerance IS NULL THEN 'NO_TOLERANCE' WHEN s % 15 = 0 THEN 'UNITS_DIFFER' WHEN lower_tolerance > tolerance THEN 'LOWER_LARGER' ELSE 'COMPOSITE' END AS state, CASE WHEN line_no % 7 <> 6 THEN lower_tolerance END AS lower_tolerance FROM v_frame""")
def frame_segments(shop):
    """Frames of two bands, written as text and read again."""
    f = shop.v_frame
    name = F.when(c("line_no") % 7 == 6, "ROUGHNESS").when(c("characteristic") == "PROFILE_OF_SURFACE", "profile of a surface").when(c("characteristic") == "POSITION", "⌖").otherwise(F.replace("characteristic", F.lit("_"), F.lit(" ")))
    number = lambda x: F.translate(c(x).cast("decimal(12,4)").cast("string"), ".", ",")
    datums = F.when(F.length("datums") == 2, "A-B").otherwise(c("datums"))
    upper = F.concat_ws(" ", name, F.concat(F.when(c("is_hole"), "Ø").otherwise(""), number("tolerance")), F.when(c("s") % 3 == 0, "in"), F.when(c("modifier") == "MMC", "Ⓜ").otherwise(c("modifier")), datums)
    lower = F.concat_ws(" ", F.concat(F.lit("Ø"), number("lower_tolerance")), F.when((c("s") % 3 == 0) & (c("s") % 15 != 0), "in"), F.lit("A"))
    d = f.withColumn("f", fr.composite(upper, lower))
    return d.select("drawing_id", "frame_id", "line_no", "s", "f.upper.characteristic", "f.upper.tolerance", "f.upper.unit", "f.upper.diameter", "f.upper.modifier", F.array_join("f.upper.datums", ",").alias("datums"), "f.state", F.when(c("f.upper").isNotNull(), c("f.lower.tolerance")).alias("lower_tolerance"))


@query("recognised_features", f"""WITH d AS (SELECT drawing_id, req_id, value, CASE WHEN kind = 'THREAD' THEN 'T' WHEN dimension_type ILIKE '%diameter%' THEN 'D' WHEN dimension_type ILIKE '%depth%' THEN 'Z' ELSE 'O' END AS role, concat_ws(' ', lower(coalesce(dimension_type, '')), lower(note)) AS words FROM v_req),
  k AS (SELECT *, row_number() OVER (PARTITION BY drawing_id, role ORDER BY req_id) AS k, count(*) FILTER (WHERE role = 'D') OVER (PARTITION BY drawing_id) AS holes FROM d)
  SELECT drawing_id, req_id, 'THREAD' AS feature_type, 'R-FR-001' AS rule, value AS size, NULL::BIGINT AS depth_req_id, NULL::DOUBLE AS depth FROM k WHERE role = 'T' UNION ALL SELECT h.drawing_id, h.req_id, 'HOLE', 'R-FR-002', h.value, z.req_id, z.value FROM k h LEFT JOIN k z ON z.drawing_id = h.drawing_id AND z.role = 'Z' AND z.k = h.k WHERE h.role = 'D'
  UNION ALL SELECT drawing_id, req_id, CASE {' '.join(f"WHEN contains(words, '{w}') THEN '{f}'" for w, f, _ in fr.BY_WORD)} END AS f, CASE {' '.join(f"WHEN contains(words, '{w}') THEN '{r}'" for w, _, r in fr.BY_WORD)} END, value, NULL, NULL FROM k WHERE (role = 'O' OR (role = 'Z' AND k > holes)) AND regexp_matches(words, '{'|'.join(w for w, _, _ in fr.BY_WORD)}')""")
def recognised_features(shop):
    """Features out of requirements, each used once, holes with their depths."""
    return fr.recognised(shop.v_req)
