"""NC programs: motion, totals, limit checks, revision differences."""

from pyspark.sql import functions as F

from ..functions import nc as X
from ..operators import linediff, nc
from ..operators import validation as val
from .registry import query, r6

c = F.col

_NUM = r"([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))"


def _word(letter):
    return f"TRY_CAST(list_extract(regexp_extract_all(b, '{letter}\\s*{_NUM}', 1), -1) AS DOUBLE)"


def _last(letter, *wanted):
    lst = ", ".join(str(10 * w) for w in wanted)
    return f"(list_extract(list_filter(list_transform(regexp_extract_all(b, '{letter}\\s*{_NUM}', 1), lambda x: CAST(round(CAST(x AS DOUBLE) * 10) AS INT)), lambda x: x IN ({lst})), -1) / 10)::INT"


_NOTED = f"list_filter(list_transform(regexp_extract_all(b, 'G\\s*{_NUM}', 1), lambda x: CAST(round(CAST(x AS DOUBLE) * 10) AS INT)), lambda x: x IN ({', '.join(map(str, nc.NOTED))}))"
_O = "(PARTITION BY program_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _placed(frm, to, a, at, base, out):
    """Two steps: the group that each line of an axis is in, then its position."""
    o = f"(PARTITION BY program_id, k{out} ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""{to}k AS (SELECT *, sum(CASE WHEN {at} THEN 1 ELSE 0 END) OVER {_O} AS k{out} FROM {frm}), {to}p AS (SELECT *, first_value(CASE WHEN {at} THEN {base} END) OVER {o} + sum(CASE WHEN rel AND NOT home THEN coalesce(w{a}, 0) ELSE 0 END) OVER {o} AS p{out} FROM {to}k),
  {to} AS (SELECT *, lag(p{out}) OVER (PARTITION BY program_id ORDER BY line_no) AS s{out} FROM {to}p)"""


_SET = "home OR (w{a} IS NOT NULL AND NOT rel)"
_OWN = "CASE WHEN NOT home AND NOT rel THEN w{a} END"
_ZSET = "home OR (wz IS NOT NULL AND NOT rel AND NOT hole)"
_BY = "CASE plane WHEN 17 THEN {0} WHEN 18 THEN {1} ELSE {2} END"
_MOTION = f"""q0 AS (SELECT program_id, line_no, text, regexp_matches(text, '#') AS macro, CASE WHEN regexp_matches(text, '#') THEN '' ELSE upper(regexp_replace(regexp_replace(text, '\\([^)]*\\)', ' ', 'g'), ';.*$', '')) END AS b FROM v_nc),
  q1 AS (SELECT *, {_last('G', 20, 21)} AS gu, {_last('G', 90, 91)} AS ga, {_last('G', 0, 1, 2, 3, *range(80, 90))} AS gm, {_last('G', 0, 1, 2, 3)} AS gs, {_last('G', 17, 18, 19)} AS gp, {_last('G', 98, 99)} AS gr, {_last('G', *range(81, 86))} IS NOT NULL AS begins, {_last('G', 92)} IS NOT NULL AS shift, {_last('G', 93, 94, 95)} AS gf, {_NOTED} AS noted,
    {_last('M', 2, 30)} AS mend, {_last('G', 28)} IS NOT NULL AS home, {_last('M', 6)} IS NOT NULL AS chg, {', '.join(f"{_word(x)} AS {x.lower()}" for x in 'STFXYZIJKR')} FROM q0),
  q2 AS (SELECT *, min(CASE WHEN mend IS NOT NULL THEN line_no END) OVER (PARTITION BY program_id) AS fin FROM q1),
  q3 AS (SELECT *, coalesce(last_value(gu IGNORE NULLS) OVER o = 20, false) AS inch, coalesce(last_value(ga IGNORE NULLS) OVER o = 91, false) AND NOT shift AS rel, coalesce(last_value(gf IGNORE NULLS) OVER o, 94) AS fmode, CASE WHEN last_value(gm IGNORE NULLS) OVER o = 80 THEN last_value(gs IGNORE NULLS) OVER o ELSE last_value(gm IGNORE NULLS) OVER o END AS mode, coalesce(last_value(gp IGNORE NULLS) OVER o, 17) AS plane,
    coalesce(last_value(gr IGNORE NULLS) OVER o = 99, false) AS stays, last_value(s IGNORE NULLS) OVER o AS rpm, last_value(t IGNORE NULLS) OVER o AS tool FROM q2 WHERE fin IS NULL OR line_no <= fin WINDOW o AS {_O}),
  q4 AS (SELECT *, CASE WHEN inch THEN 25.4::DOUBLE ELSE 1 END AS sc FROM q3), q5 AS (SELECT *, {', '.join(f"{x} * sc AS w{x}" for x in 'xyzijkr')}, last_value(CASE WHEN fmode = 94 THEN f * sc END IGNORE NULLS) OVER o AS feed, last_value(CASE WHEN fmode = 95 THEN f * sc END IGNORE NULLS) OVER o AS feed_rev, sum(CASE WHEN chg AND tool IS NOT NULL THEN 1 ELSE 0 END) OVER o AS segment FROM q4 WINDOW o AS {_O}),
  q6 AS (SELECT *, coalesce(mode BETWEEN 81 AND 85 AND NOT shift AND NOT rel AND NOT home AND (wx IS NOT NULL OR wy IS NOT NULL), false) AS hole, last_value(CASE WHEN mode BETWEEN 81 AND 85 AND NOT shift THEN wz END IGNORE NULLS) OVER o AS depth, last_value(CASE WHEN mode BETWEEN 81 AND 85 AND NOT shift THEN wr END IGNORE NULLS) OVER o AS lev FROM q5 WINDOW o AS {_O}),
  {_placed('q6', 'qx', 'x', _SET.format(a='x'), _OWN.format(a='x'), 'x')}, {_placed('qx', 'qy', 'y', _SET.format(a='y'), _OWN.format(a='y'), 'y')},
  {_placed('qy', 'qa', 'z', f"{_ZSET} OR (hole AND stays)", f"CASE WHEN hole THEN lev ELSE {_OWN.format(a='z')} END", 'a')},
  qb AS (SELECT *, (last_value(CASE WHEN begins THEN {{'z': sa}} END IGNORE NULLS) OVER {_O}).z AS init FROM qa),
  {_placed('qb', 'qc', 'z', f"{_ZSET} OR hole", f"CASE WHEN hole THEN CASE WHEN stays THEN lev ELSE coalesce(init, lev) END ELSE {_OWN.format(a='z')} END", 'z')},
  q8 AS (SELECT *, coalesce((wx IS NOT NULL OR wy IS NOT NULL OR wz IS NOT NULL) AND NOT home AND NOT shift AND (mode BETWEEN 0 AND 3 OR mode BETWEEN 81 AND 89), false) AS mv, (wx IS NOT NULL AND (sx IS NULL OR px IS NULL)) OR (wy IS NOT NULL AND (sy IS NULL OR py IS NULL)) OR (wz IS NOT NULL AND (sz IS NULL OR pz IS NULL)) AS unk,
    {_BY.format('sx', 'sx', 'sy')} AS u0, {_BY.format('sy', 'sz', 'sz')} AS v0, {_BY.format('sz', 'sy', 'sx')} AS h0, {_BY.format('px', 'px', 'py')} AS u1, {_BY.format('py', 'pz', 'pz')} AS v1, {_BY.format('pz', 'py', 'px')} AS h1,
    {_BY.format('wi', 'wi', 'wj')} AS ci, {_BY.format('wj', 'wk', 'wk')} AS cj, {_BY.format('wz', 'wy', 'wx')} AS wh, abs(depth - lev) AS stroke FROM qc),
  q9 AS (SELECT *, CASE WHEN NOT unk THEN sqrt(CASE WHEN wx IS NULL THEN 0 ELSE pow(px - sx, 2) END + CASE WHEN wy IS NULL THEN 0 ELSE pow(py - sy, 2) END + CASE WHEN wz IS NULL THEN 0 ELSE pow(pz - sz, 2) END) END AS ln, CASE WHEN ci IS NOT NULL OR cj IS NOT NULL THEN sqrt(pow(coalesce(ci, 0), 2) + pow(coalesce(cj, 0), 2)) END AS r0,
    sqrt(pow(u1 - u0 - coalesce(ci, 0), 2) + pow(v1 - v0 - coalesce(cj, 0), 2)) AS r1, CASE WHEN mode = 2 THEN 1 ELSE -1 END * (atan2(-coalesce(cj, 0), -coalesce(ci, 0)) - atan2(v1 - v0 - coalesce(cj, 0), u1 - u0 - coalesce(ci, 0))) AS da, CASE WHEN wh IS NOT NULL THEN coalesce(h1 - h0, 0) ELSE 0 END AS rise FROM q8),
  q10 AS (SELECT *, da - 2 * pi() * floor(da / (2 * pi())) AS sw FROM q9),
  q11 AS (SELECT *, CASE WHEN mv THEN CASE WHEN mode = 1 THEN ln WHEN mode IN (2, 3) THEN CASE WHEN r0 > 0 AND abs(r0 - r1) < 1e-3 AND abs(r0 - r1) < 1e-4 * r0 THEN sqrt(pow(r0 * CASE WHEN sw <= 1e-12 THEN 2 * pi() ELSE sw END, 2) + rise * rise) END WHEN hole THEN CASE WHEN stroke >= 1e-9 THEN stroke * CASE WHEN mode IN (84, 85) THEN 2 ELSE 1 END WHEN stroke IS NOT NULL THEN 0 END END END AS feed_len,
    CASE WHEN mv THEN CASE WHEN mode = 0 THEN ln WHEN hole AND stroke IS NOT NULL THEN coalesce(sqrt(pow(px - sx, 2) + pow(py - sy, 2)), 0) + coalesce(abs(sz - lev), 0) + CASE WHEN stroke >= 1e-9 AND NOT stays THEN coalesce(abs(lev - init), 0) ELSE 0 END END END AS rapid_len FROM q10),
  q AS (SELECT *, coalesce(feed_len + rapid_len, feed_len, rapid_len) AS length, coalesce(mv AND (coalesce(feed_len, rapid_len) IS NULL OR (hole AND (stroke IS NULL OR stroke < 1e-9 OR mode IN (83, 84) OR (NOT stays AND init IS NULL)))), false) AS skipped FROM q11)"""


@query("nc_moves", f"WITH {_MOTION} SELECT program_id, line_no, mode, rpm, round(feed + 1e-9, 6) AS feed, segment::BIGINT AS segment, round(px + 1e-9, 6) AS px, round(py + 1e-9, 6) AS py, round(pz + 1e-9, 6) AS pz, skipped, round(length + 1e-9, 6) AS length FROM q")
def nc_moves(shop):
    m = nc.motion(shop.v_nc)
    return m.select("program_id", "line_no", "mode", "rpm", r6(c("feed")).alias("feed"), c("segment").cast("long").alias("segment"), *[r6(c(p)).alias(p) for p in ("px", "py", "pz")], F.coalesce("skipped", F.lit(False)).alias("skipped"), r6(c("length")).alias("length"))


@query("nc_segments", f"WITH {_MOTION} SELECT program_id, segment::BIGINT AS segment, max_by(tool, line_no) AS tool, round(sum(feed_len), 4) AS feed_mm, round(sum(rapid_len), 4) AS rapid_mm, count(length) AS moves, count(*) FILTER (WHERE skipped) AS skipped, min(feed) FILTER (WHERE mode = 1 AND length IS NOT NULL) AS min_feed, max(feed) FILTER (WHERE mode = 1 AND length IS NOT NULL) AS max_feed FROM q GROUP BY program_id, segment")
def nc_segments(shop):
    return nc.segments(nc.motion(shop.v_nc)).withColumns({"segment": c("segment").cast("long"), "feed_mm": F.round("feed_mm", 4), "rapid_mm": F.round("rapid_mm", 4)})


_PROGRAM = f"{_MOTION}, pr AS (SELECT program_id, count(*) AS n_lines, sum(feed_len) AS feed_mm, sum(rapid_len) AS rapid_mm, max(segment)::BIGINT AS tool_changes, count(*) FILTER (WHERE skipped) AS skipped, count(*) FILTER (WHERE macro) AS macros, max_by(rpm, line_no) AS last_rpm, max_by(feed, line_no) AS last_feed, max(rpm) AS max_rpm, max(feed) AS max_feed, bool_or(fin IS NOT NULL) AS ended, list_sort(list_distinct(flatten(list(noted)))) AS noted, max_by(feed_rev, line_no) AS last_feed_rev FROM q GROUP BY program_id)"


@query("nc_programs", f"WITH {_PROGRAM} SELECT program_id, n_lines, round(feed_mm, 4) AS feed_mm, round(rapid_mm, 4) AS rapid_mm, tool_changes, skipped, macros, last_rpm, last_feed, max_rpm, max_feed, ended, array_to_string(list_transform(noted, lambda x: 'G' || (x // 10)), ',') AS noted, last_feed_rev, CASE WHEN macros > 0 THEN 'UNSUPPORTED' WHEN skipped > 0 OR list_contains(noted, 930) THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM pr")
def nc_programs(shop):
    return nc.programs(nc.motion(shop.v_nc)).withColumns({"tool_changes": c("tool_changes").cast("long"), "feed_mm": F.round("feed_mm", 4), "rapid_mm": F.round("rapid_mm", 4)})


_LIMITS = f"{_PROGRAM}, lim AS (SELECT pr.*, m.max_rpm AS m_rpm, t.max_rpm AS t_rpm, h.max_rpm AS h_rpm, m.max_feed AS m_feed FROM pr LEFT JOIN v_machine m ON m.machine_id = program_id % 97 LEFT JOIN v_tool t ON t.tool_id = program_id * 3 LEFT JOIN v_holder h ON h.holder_id = program_id % 30)"


@query("nc_limit_findings", f"""WITH {_LIMITS}, f AS (SELECT program_id, 'MACHINE_RPM' AS check_id, max_rpm AS observed, m_rpm AS lim FROM lim UNION ALL SELECT program_id, 'TOOL_RPM', max_rpm, t_rpm FROM lim UNION ALL SELECT program_id, 'HOLDER_RPM', max_rpm, h_rpm FROM lim UNION ALL SELECT program_id, 'MACHINE_FEED', max_feed, m_feed FROM lim)
  SELECT program_id, check_id, CASE WHEN observed IS NULL OR lim IS NULL THEN 'INSUFFICIENT_DATA' WHEN observed > lim THEN 'BLOCKING' ELSE 'INFO' END AS severity, round(observed / lim, 4) AS utilisation FROM f""")
def nc_limit_findings(shop):
    return _findings(shop).select("program_id", "check_id", "severity", val.utilisation(c("observed"), c("lim")).alias("utilisation"))


def _limits(shop):
    p = nc.programs(nc.motion(shop.v_nc))
    m = shop.v_machine.select(c("machine_id").alias("_m"), c("max_rpm").alias("m_rpm"), c("max_feed").alias("m_feed"))
    t = shop.v_tool.select(c("tool_id").alias("_t"), c("max_rpm").alias("t_rpm"))
    h = shop.v_holder.select(c("holder_id").alias("_h"), c("max_rpm").alias("h_rpm"))
    return p.join(m, c("program_id") % 97 == c("_m"), "left").join(t, c("program_id") * 3 == c("_t"), "left").join(h, c("program_id") % 30 == c("_h"), "left")


def _findings(shop):
    rows = [("MACHINE_RPM", "max_rpm", "m_rpm"), ("TOOL_RPM", "max_rpm", "t_rpm"), ("HOLDER_RPM", "max_rpm", "h_rpm"), ("MACHINE_FEED", "max_feed", "m_feed")]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("check_id"), c(o).cast("double").alias("observed"), c(x).cast("double").alias("lim")) for k, o, x in rows])).alias("f")
    severity = F.when(c("observed").isNull() | c("lim").isNull(), "INSUFFICIENT_DATA").when(c("observed") > c("lim"), "BLOCKING").otherwise("INFO")
    return _limits(shop).select("program_id", "status", each).select("program_id", "status", "f.*").withColumn("severity", severity)


@query("nc_effective_limit", f"""WITH {_LIMITS} SELECT program_id, least(m_rpm, t_rpm, h_rpm) AS effective_rpm, CASE least(m_rpm, t_rpm, h_rpm) WHEN m_rpm THEN 'MACHINE' WHEN t_rpm THEN 'TOOL' WHEN h_rpm THEN 'HOLDER' END AS source FROM lim""")
def nc_effective_limit(shop):
    named = F.array(*[F.struct(c(x).cast("long").alias("rpm"), F.lit(i).alias("prio"), F.lit(n).alias("source")) for i, (x, n) in enumerate([("m_rpm", "MACHINE"), ("t_rpm", "TOOL"), ("h_rpm", "HOLDER")])])
    return _limits(shop).select("program_id", F.array_min(F.filter(named, lambda s: s["rpm"].isNotNull())).alias("e")).select("program_id", c("e.rpm").alias("effective_rpm"), c("e.source").alias("source"))


@query("nc_review_status", f"""WITH {_LIMITS}, lp AS (SELECT *, skipped > 0 OR list_contains(noted, 930) AS part FROM lim), f AS (SELECT program_id, macros, part, max_rpm AS observed, m_rpm AS lim FROM lp UNION ALL SELECT program_id, macros, part, max_rpm, t_rpm FROM lp UNION ALL SELECT program_id, macros, part, max_rpm, h_rpm FROM lp UNION ALL SELECT program_id, macros, part, max_feed, m_feed FROM lp),
  s AS (SELECT program_id, any_value(macros) AS macros, any_value(part) AS part, count(*) FILTER (WHERE observed > lim) AS blocking, count(*) FILTER (WHERE observed IS NULL OR lim IS NULL) AS insufficient FROM f GROUP BY program_id)
  SELECT program_id, blocking, insufficient, CASE WHEN blocking > 0 THEN 'BLOCKED' WHEN macros > 0 THEN 'UNSUPPORTED' WHEN part THEN 'WARNING' WHEN insufficient > 0 THEN 'INSUFFICIENT_DATA' ELSE 'PASS' END AS review FROM s""")
def nc_review_status(shop):
    n = lambda v: F.count_if(c("severity") == v)
    review = F.when(n("BLOCKING") > 0, "BLOCKED").when(F.first("status") == "UNSUPPORTED", "UNSUPPORTED").when(F.first("status") == "PARTIAL", "WARNING").when(n("INSUFFICIENT_DATA") > 0, "INSUFFICIENT_DATA").otherwise("PASS")
    return _findings(shop).groupBy("program_id").agg(n("BLOCKING").alias("blocking"), n("INSUFFICIENT_DATA").alias("insufficient"), review.alias("review"))


@query("nc_line_diff", """WITH a AS (SELECT program_id, trim(text) AS text, row_number() OVER (PARTITION BY program_id, trim(text) ORDER BY line_no) AS occurrence FROM v_nc), b AS (SELECT program_id, trim(text) AS text, row_number() OVER (PARTITION BY program_id, trim(text) ORDER BY line_no) AS occurrence FROM v_nc_b)
  SELECT program_id, text, occurrence, CASE WHEN b.text IS NULL THEN 'REMOVED' WHEN a.text IS NULL THEN 'ADDED' ELSE 'UNCHANGED' END AS change FROM a FULL JOIN b USING (program_id, text, occurrence)""")
def nc_line_diff(shop):
    return nc.line_diff(shop.v_nc, shop.v_nc_b)


@query("nc_ordered_diff", None)
def nc_ordered_diff(shop):
    """The lines of two revisions in order; no SQL, held against a longest common subsequence in tests."""
    return linediff.ordered_diff(shop.v_nc, shop.v_nc_b).select("program_id", "change", "a_line", "b_line")


@query("nc_block_classes", """SELECT class, count(*) AS n FROM (SELECT CASE WHEN trim(text) = '' THEN 'EMPTY' WHEN b = '' THEN 'COMMENT' WHEN text LIKE '%#%' THEN 'MACRO' WHEN regexp_matches(b, '\\bT[0-9]|\\bM0*6\\b') THEN 'TOOL' WHEN regexp_matches(b, '\\bS[0-9]|\\bM0*[345]\\b') THEN 'SPINDLE' WHEN regexp_matches(b, '\\bG0*0\\b') THEN 'RAPID'
  WHEN regexp_matches(b, '\\bG0*[123]\\b') THEN 'CUT' WHEN regexp_matches(b, '\\bG(17|18|19|20|21|90|91|94|95)\\b') THEN 'MODAL' WHEN regexp_matches(b, '[XYZ]') THEN 'MOVE' ELSE 'OTHER' END AS class FROM (SELECT text, trim(upper(regexp_replace(regexp_replace(text, '\\([^)]*\\)', ' ', 'g'), ';.*$', ''))) AS b FROM v_nc)) GROUP BY class""")
def nc_block_classes(shop):
    return shop.v_nc.select(X.block_class(c("text")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("nc_words_changed", """WITH x AS MATERIALIZED (SELECT program_id, line_no, list_distinct(regexp_extract_all(text, '[A-Z]-?[0-9]+')) AS wa FROM v_nc), y AS MATERIALIZED (SELECT program_id, line_no, list_distinct(regexp_extract_all(text, '[A-Z]-?[0-9]+')) AS wb FROM v_nc_b), j AS (SELECT program_id, line_no, wa, wb FROM x JOIN y USING (program_id, line_no))
  SELECT program_id, line_no, array_to_string(list_sort(list_filter(wa, lambda x: NOT list_contains(wb, x))), ',') AS gone, array_to_string(list_sort(list_filter(wb, lambda x: NOT list_contains(wa, x))), ',') AS came FROM j""")
def nc_words_changed(shop):
    words = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit("[A-Z]-?[0-9]+"), F.lit(0)))
    j = shop.v_nc.select("program_id", "line_no", words(c("text")).alias("wa")).join(shop.v_nc_b.select("program_id", "line_no", words(c("text")).alias("wb")), ["program_id", "line_no"])
    return j.select("program_id", "line_no", F.array_join(F.sort_array(F.array_except("wa", "wb")), ",").alias("gone"), F.array_join(F.sort_array(F.array_except("wb", "wa")), ",").alias("came"))


@query("nc_arcs", """WITH a AS (SELECT part_id, feature_id, x AS x0, y AS y0, x + 2 * d_mm AS x1, CASE WHEN feature_id % 5 = 0 THEN y + 9 ELSE y END AS y1, d_mm AS i, 0.0::DOUBLE AS j, depth_mm AS rise, feature_id % 2 = 0 AS cw FROM v_feature),
  s AS (SELECT *, sqrt(i * i + j * j) AS r0, sqrt(pow(x1 - x0 - i, 2) + pow(y1 - y0 - j, 2)) AS r1, atan2(-j, -i) AS a0, atan2(y1 - y0 - j, x1 - x0 - i) AS a1 FROM a),
  t AS (SELECT *, CASE WHEN cw THEN a0 - a1 ELSE a1 - a0 END AS d FROM s), u AS (SELECT *, d - 2 * pi() * floor(d / (2 * pi())) AS sw FROM t)
  SELECT part_id, feature_id, rise, x0, y0, round(CASE WHEN r0 > 0 AND abs(r0 - r1) < 1e-3 AND abs(r0 - r1) < 1e-4 * r0 THEN sqrt(pow(r0 * CASE WHEN sw <= 1e-12 THEN 2 * pi() ELSE sw END, 2) + rise * rise) END, 4) AS length FROM u""")
def nc_arcs(shop):
    f = shop.v_feature
    y1 = F.when(c("feature_id") % 5 == 0, c("y") + 9).otherwise(c("y"))
    length = X.arc_length(c("x"), c("y"), c("x") + 2 * c("d_mm"), y1, c("d_mm"), F.lit(0.0), c("depth_mm"), c("feature_id") % 2 == 0)
    return f.select("part_id", "feature_id", c("depth_mm").alias("rise"), c("x").alias("x0"), c("y").alias("y0"), F.round(length, 4).alias("length"))


@query("nc_lines", "SELECT program_id, line_no, true AS valid, text FROM v_nc")
def nc_lines(shop):
    """Program texts split into numbered lines."""
    from ..sources import ingest

    return ingest.reread(shop.v_nc.select("program_id", "line_no", "text"))
