"""Revision review of NC programs."""

import re

from pyspark.sql import functions as F

from ..operators import changes as ch
from ..operators import nc
from ..operators.graph import _cut
from . import shop_nc as base
from .registry import query

c = F.col

#: The motion of the second revision: the same steps under other names.
_MOTION_B = re.sub(r"\bv_nc\b", "v_nc_b", re.sub(r"\bq(\d*|[xyabc][kp]?)\b", r"rev\1", base._MOTION))
_SEG = "SELECT program_id, segment::BIGINT AS segment, max_by(tool, line_no) AS tool, sum(feed_len) AS feed_mm, sum(rapid_len) AS rapid_mm, min(feed) FILTER (WHERE mode = 1 AND length IS NOT NULL) AS min_feed, max(feed) FILTER (WHERE mode = 1 AND length IS NOT NULL) AS max_feed FROM {t} GROUP BY program_id, segment"
_D = "(round(coalesce(b.{k}, 0) - coalesce(a.{k}, 0), 4) + 0.0)"


def _segments(shop, view):
    s = nc.segments(nc.motion(shop.view(view)))
    return s.select("program_id", c("segment").cast("long").alias("segment"), "tool", "feed_mm", "rapid_mm", "min_feed", "max_feed")


@query("nc_segment_diff", f"""WITH {base._MOTION}, {_MOTION_B}, a AS ({_SEG.format(t='q')}), b AS ({_SEG.format(t='rev')}), na AS (SELECT program_id, max(segment) AS x FROM a GROUP BY 1), nb AS (SELECT program_id, max(segment) AS y FROM b GROUP BY 1), un AS (SELECT program_id, x IS DISTINCT FROM y AS uncertain FROM na FULL JOIN nb USING (program_id)),
  j AS (SELECT program_id, segment, a.program_id IS NULL AS no_a, b.program_id IS NULL AS no_b, a.tool IS DISTINCT FROM b.tool AS tc, a.min_feed IS DISTINCT FROM b.min_feed OR a.max_feed IS DISTINCT FROM b.max_feed AS fc, {_D.format(k='feed_mm')} AS fd, {_D.format(k='rapid_mm')} AS rd FROM (SELECT *, program_id AS p, segment AS g FROM a) a FULL JOIN b USING (program_id, segment))
  SELECT program_id, segment, CASE WHEN no_a THEN 'ADDED' WHEN no_b THEN 'REMOVED' WHEN uncertain THEN 'MATCH_UNCERTAIN' WHEN tc OR fc OR abs(fd) > 0 OR abs(rd) > 0 THEN 'MODIFIED' ELSE 'UNCHANGED' END AS change, CASE WHEN NOT no_a AND NOT no_b THEN tc END AS tool_changed, CASE WHEN NOT no_a AND NOT no_b THEN fd END AS feed_delta, CASE WHEN NOT no_a AND NOT no_b THEN rd END AS rapid_delta FROM j JOIN un USING (program_id)""")
def nc_segment_diff(shop):
    """Segments of two revisions by number."""
    return ch.segment_changes(_segments(shop, "v_nc"), _segments(shop, "v_nc_b"))


#: What a program uses, and whether that is measured.
_FEATURES = [("MACRO", "#", "UNSUPPORTED"), ("REFERENCE_RETURN", "G28", "SUPPORTED"), ("INCH", "G20", "SUPPORTED"), ("INCREMENTAL", "G91", "SUPPORTED"), ("FEED_999", "F999", "UNSUPPORTED"), ("SPINDLE_STOP", "M5", "SUPPORTED")]


def _detected() -> list:
    """Per feature, whether a line of the program uses it."""
    return [F.bool_or(F.contains("text", F.lit(t))).alias(n) for n, t, _ in _FEATURES]


def _coverage_of(programs):
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), c(n).alias("detected"), F.lit(s).alias("full")) for n, _, s in _FEATURES])).alias("f")
    return programs.select("program_id", each).select("program_id", "f.feature", "f.detected", F.when(c("f.detected"), c("f.full")).otherwise("NOT_DETECTED").alias("state"))


def _coverage(shop, view):
    return _coverage_of(shop.view(view).groupBy("program_id").agg(*_detected()))


def _cov_sql(t):
    rows = ", ".join(f"('{n}', '{x}', '{s}')" for n, x, s in _FEATURES)
    return f"SELECT program_id, f.feature, bool_or(contains(text, f.token)) AS detected, CASE WHEN bool_or(contains(text, f.token)) THEN any_value(f.full_state) ELSE 'NOT_DETECTED' END AS state FROM {t} CROSS JOIN (VALUES {rows}) f(feature, token, full_state) GROUP BY program_id, f.feature"


_COV = f"ca AS ({_cov_sql('v_nc')}), cb AS ({_cov_sql('v_nc_b')}), cv AS (SELECT program_id, feature, CASE WHEN coalesce(cb.detected, false) AND NOT coalesce(ca.detected, false) THEN 'FEATURE_NEWLY_DETECTED' WHEN coalesce(ca.detected, false) AND NOT coalesce(cb.detected, false) THEN 'FEATURE_NO_LONGER_DETECTED' WHEN ca.state IS DISTINCT FROM cb.state THEN 'FEATURE_STATE_CHANGED' ELSE 'FEATURE_UNCHANGED' END AS change, cb.state AS state FROM ca FULL JOIN cb USING (program_id, feature))"


@query("nc_coverage_diff", f"WITH {_COV} SELECT * FROM cv")
def nc_coverage_diff(shop):
    """Features detected in two revisions."""
    return ch.coverage_changes(_coverage(shop, "v_nc"), _coverage(shop, "v_nc_b"))


def _words() -> list:
    """Last feed and speed words of a program's lines, and how many cut."""
    word = lambda k: F.regexp_extract("text", rf"{k}(\d+)", 1).try_cast("double")
    last = lambda k: F.max_by(word(k), F.when(word(k).isNotNull(), c("line_no")))
    return [last("F").alias("feed"), last("S").alias("rpm"), F.count_if(F.contains("text", F.lit("G1"))).alias("cuts")]


def _commands_of(programs):
    """Programs with their machine and tool, and their known time at a rapid of 5 m/min."""
    return programs.withColumns({"machine_id": c("program_id") % 97, "tool_id": F.when(c("feed") > 300, c("program_id") * 3), "known_s": F.when(c("feed") > 0, c("cuts") * 600 / c("feed"))})


def _commands(shop, view):
    return _commands_of(shop.view(view).groupBy("program_id").agg(*_words()))


def _cmd_sql(t):
    return f"SELECT *, program_id % 97 AS machine_id, CASE WHEN feed > 300 THEN program_id * 3 END AS tool_id, CASE WHEN feed > 0 THEN cuts * 600 / feed END AS known_s FROM (SELECT program_id, arg_max(TRY_CAST(regexp_extract(text, 'F(\\d+)', 1) AS DOUBLE), line_no) FILTER (WHERE regexp_matches(text, 'F\\d')) AS feed, arg_max(TRY_CAST(regexp_extract(text, 'S(\\d+)', 1) AS DOUBLE), line_no) FILTER (WHERE regexp_matches(text, 'S\\d')) AS rpm, count(*) FILTER (WHERE contains(text, 'G1')) AS cuts FROM {t} GROUP BY program_id)"


_CMD = f"ma AS ({_cmd_sql('v_nc')}), mb AS ({_cmd_sql('v_nc_b')})"
_FIELDS = ["feed", "rpm", "machine_id", "tool_id"]
_CFG = "cf AS (" + " UNION ALL ".join(f"SELECT program_id, '{f}' AS field, ma.{f} IS DISTINCT FROM mb.{f} AS changed FROM ma JOIN mb USING (program_id)" for f in _FIELDS) + ")"


@query("nc_command_diff", f"WITH {_CMD}, {_CFG} SELECT * FROM cf")
def nc_command_diff(shop):
    """Feed, speed and configuration fields of two revisions."""
    return ch.field_changes(_commands(shop, "v_nc"), _commands(shop, "v_nc_b"), "program_id", _FIELDS).select("program_id", "field", "changed")


@query("nc_time_diff", f"WITH {_CMD} SELECT program_id, round(ma.known_s, 6) AS was_s, round(mb.known_s, 6) AS now_s, round(mb.known_s - ma.known_s, 6) AS delta_s, ma.known_s IS NOT NULL AND mb.known_s IS NOT NULL AS comparable FROM ma JOIN mb USING (program_id)")
def nc_time_diff(shop):
    d = ch.time_change(_commands(shop, "v_nc"), _commands(shop, "v_nc_b"))
    return d.withColumns({"was_s": F.round("was_s", 6), "now_s": F.round("now_s", 6)})


def _found(shop, commands):
    """Findings of a revision: speed over the machine's limit, feed over 350, no feed."""
    d = commands.join(shop.v_machine.select(c("machine_id"), "max_rpm"), "machine_id", "left")
    cases = [
        ("RPM_LIMIT", F.when(c("rpm") > c("max_rpm"), "BLOCKING").when(c("max_rpm").isNull() | c("rpm").isNull(), "INSUFFICIENT_DATA"), c("rpm"), c("max_rpm").cast("double")),
        ("FEED_LIMIT", F.when(c("feed") > 900, "BLOCKING").when(c("feed") > 350, "WARNING"), c("feed"), F.lit(350.0)), ("NO_FEED", F.when(c("feed").isNull(), "WARNING"), F.lit(None).cast("double"), F.lit(None).cast("double")),
    ]
    each = F.filter(F.array(*[F.struct(F.lit(k).alias("code"), s.alias("severity"), o.alias("observed"), m.alias("lim"), F.lit("CATALOG").alias("source")) for k, s, o, m in cases]), lambda x: x["severity"].isNotNull())
    return d.select("program_id", F.explode(each).alias("f")).select("program_id", "f.*")


def _found_sql(m):
    own = f"(SELECT m.*, max_rpm FROM {m} m LEFT JOIN v_machine v ON v.machine_id = m.machine_id)"
    return f"""SELECT program_id, 'RPM_LIMIT' AS code, CASE WHEN rpm > max_rpm THEN 'BLOCKING' ELSE 'INSUFFICIENT_DATA' END AS severity, rpm AS observed, max_rpm::DOUBLE AS lim FROM {own} WHERE rpm > max_rpm OR max_rpm IS NULL OR rpm IS NULL
  UNION ALL SELECT program_id, 'FEED_LIMIT', CASE WHEN feed > 900 THEN 'BLOCKING' ELSE 'WARNING' END, feed, 350.0 FROM {own} WHERE feed > 350 UNION ALL SELECT program_id, 'NO_FEED', 'WARNING', NULL, NULL FROM {own} WHERE feed IS NULL"""


_FND = f"fa AS ({_found_sql('ma')}), fb AS ({_found_sql('mb')}), fc AS (SELECT program_id, code, CASE WHEN fa.severity IS NULL THEN 'FINDING_ADDED' WHEN fb.severity IS NULL THEN 'FINDING_RESOLVED' WHEN fa.severity <> fb.severity THEN 'FINDING_SEVERITY_CHANGED' WHEN fa.observed IS DISTINCT FROM fb.observed THEN 'FINDING_VALUE_CHANGED' WHEN fa.lim IS DISTINCT FROM fb.lim THEN 'FINDING_LIMIT_CHANGED' ELSE 'FINDING_UNCHANGED' END AS change, fb.severity AS severity FROM fa FULL JOIN fb USING (program_id, code))"


@query("nc_finding_diff", f"WITH {_CMD}, {_FND} SELECT * FROM fc")
def nc_finding_diff(shop):
    """Findings of two revisions by code."""
    return ch.finding_changes(*[_found(shop, _commands(shop, v)) for v in ("v_nc", "v_nc_b")])


@query("nc_change_review", f"""WITH {_CMD}, {_FND}, {_COV}, {_CFG}, la AS (SELECT program_id, trim(text) AS text, row_number() OVER (PARTITION BY program_id, trim(text) ORDER BY line_no) AS o FROM v_nc), lb AS (SELECT program_id, trim(text) AS text, row_number() OVER (PARTITION BY program_id, trim(text) ORDER BY line_no) AS o FROM v_nc_b),
  ld AS (SELECT program_id, count(*) FILTER (WHERE la.text IS NULL) AS added, count(*) FILTER (WHERE lb.text IS NULL) AS removed FROM (SELECT *, text AS t FROM la) la FULL JOIN (SELECT *, text AS t FROM lb) lb USING (program_id, t, o) GROUP BY program_id),
  f AS (SELECT program_id, count(*) FILTER (WHERE change = 'FINDING_ADDED') AS findings_added, count(*) FILTER (WHERE change = 'FINDING_RESOLVED') AS findings_resolved, count(*) FILTER (WHERE change IN ('FINDING_ADDED', 'FINDING_SEVERITY_CHANGED') AND severity = 'BLOCKING') AS new_blocking FROM fc GROUP BY program_id),
  v AS (SELECT program_id, count(*) FILTER (WHERE change = 'FEATURE_NEWLY_DETECTED' AND state = 'UNSUPPORTED') AS new_unsupported FROM cv GROUP BY program_id), k AS (SELECT program_id, count(*) FILTER (WHERE changed) AS fields_changed FROM cf GROUP BY program_id),
  d AS (SELECT p.program_id, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(findings_added, 0) AS findings_added, coalesce(findings_resolved, 0) AS findings_resolved, coalesce(new_blocking, 0) AS new_blocking, coalesce(new_unsupported, 0) AS new_unsupported, coalesce(fields_changed, 0) AS fields_changed FROM (SELECT DISTINCT program_id FROM v_nc) p LEFT JOIN ld USING (program_id) LEFT JOIN f USING (program_id) LEFT JOIN v USING (program_id) LEFT JOIN k USING (program_id)),
  e AS (SELECT *, CASE WHEN added + removed > 0 AND fields_changed > 0 THEN 'PROGRAM_AND_CONFIGURATION_CHANGED' WHEN added + removed > 0 THEN 'PROGRAM_CHANGED' WHEN fields_changed > 0 THEN 'CONFIGURATION_CHANGED' ELSE 'UNCHANGED' END AS status, CASE WHEN new_blocking > 0 THEN 'CRITICAL_REVIEW_REQUIRED' WHEN fields_changed > 0 THEN 'MAJOR_REVIEW_REQUIRED' WHEN added + removed > 0 THEN 'MINOR_CHANGE' ELSE 'NO_CHANGE' END AS severity,
    concat_ws(',', CASE WHEN new_blocking > 0 THEN 'NEW_BLOCKING_FINDING' END, CASE WHEN new_unsupported > 0 THEN 'NEW_UNSUPPORTED_FEATURE' END, CASE WHEN added + removed > 0 THEN 'NC_PROGRAM_CHANGED' END, CASE WHEN fields_changed > 0 THEN 'CONFIGURATION_CHANGED' END) AS reasons FROM d)
  SELECT *, reasons <> '' AS re_review FROM e""")
def nc_change_review(shop):
    """The change review of each program."""
    lines = nc.line_counts(shop.v_nc, shop.v_nc_b)
    a, b = (_cut(shop.view(v).groupBy("program_id").agg(*_words(), *_detected())) for v in ("v_nc", "v_nc_b"))  # a row per program, read five times
    was, now = _commands_of(a), _commands_of(b)
    config = ch.field_changes(was, now, "program_id", _FIELDS)
    return ch.summary(a, lines, ch.finding_changes(_found(shop, was), _found(shop, now)), ch.coverage_changes(_coverage_of(a), _coverage_of(b)), config)


@query("comparability", """SELECT o_orderkey AS id, CASE WHEN (o_custkey % 11 = 0) OR (o_custkey % 7 = 0 AND o_custkey % 11 <> 0 AND o_orderkey % 2 = 0) OR (o_orderkey % 13 = 0) THEN 'NOT_COMPARABLE' WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN 'PARTIALLY_COMPARABLE' ELSE 'COMPARABLE' END AS state FROM orders""")
def comparability(shop):
    o, u = c("o_orderkey"), c("o_custkey")
    newer = F.when(u % 11 == 0, "2.0").when(o % 3 == 0, "1.1").otherwise("1.0")
    profile = F.when((u % 7 == 0) & (o % 2 == 0), "B").otherwise("A")
    return shop.orders.select(o.alias("id"), ch.comparability(F.lit("1.0"), newer, F.lit("A"), profile, F.lit(False), o % 13 == 0, o % 5 != 0).alias("state"))
