"""Pluggable engineering rules: metadata, required inputs and a status expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import missing_inputs


@dataclass(frozen=True)
class Rule:
    rule_id: str
    inputs: tuple[str, ...]
    status: Callable[..., Column]  # over the inputs: PASS, WARNING or FAIL

    def column(self) -> Column:
        """struct(rule_id, status, missing); a missing input gives INSUFFICIENT_DATA."""
        cols = {n: F.col(n) for n in self.inputs}
        missing = missing_inputs(**cols)
        return F.struct(F.lit(self.rule_id).alias("rule_id"), F.when(F.size(missing) > 0, "INSUFFICIENT_DATA").otherwise(self.status(**cols)).alias("status"), missing.alias("missing"))


class RuleRegistry:
    """Rules by id; an id can be taken once."""

    def __init__(self, rules=()):
        self._rules: dict[str, Rule] = {}
        for r in rules:
            self.register(r)

    def register(self, rule: Rule) -> None:
        if rule.rule_id in self._rules:
            raise ValueError(f"rule {rule.rule_id} is registered already")
        self._rules[rule.rule_id] = rule

    def get(self, rule_id: str) -> Rule:
        return self._rules[rule_id]

    def all(self) -> list[Rule]:
        return list(self._rules.values())


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One struct column per rule, named by its id."""
    return df.withColumns({r.rule_id: r.column() for r in rules})


def _limit(ok: Callable[..., Column], otherwise: str = "FAIL"):
    return lambda **c: F.when(ok(**c), "PASS").otherwise(otherwise)


STEP_RULES = RuleRegistry([
    Rule("positive_speed", ("vc",), _limit(lambda vc: vc > 0)),
    Rule("diameter_range", ("d_mm",), _limit(lambda d_mm: d_mm.between(3, 40))),
    Rule("deep_hole", ("path_mm", "d_mm"), _limit(lambda path_mm, d_mm: path_mm / d_mm <= 10, "WARNING")),
    Rule("dwell_limit", ("dwell_s", "rapid_mm"), _limit(lambda dwell_s, rapid_mm: dwell_s <= 6)),
])
