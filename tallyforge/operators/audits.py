"""Audits of what is stored against the rules that made it, of the weights, and the report over all."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rating_violations(ratings: DataFrame) -> DataFrame:
    """rule and violations of rows that call something under- or overrated on less evidence than they must."""
    from ..sources.sinks import violations

    strong = ratings.where(F.col("rating_signal").isin("underrated", "overrated"))
    return violations(strong, {
        "rating_confidence": F.col("rating_confidence") >= 0.50, "polarization": F.coalesce("polarization", F.lit(0.0)) < 60, "evidence": F.col("evidence") >= 4,
        "scored": F.col("scored") >= 3, "sources": F.col("sources") >= 2, "perception_confidence": F.col("perception_confidence") >= 0.55})


def tactical_violations(rows: DataFrame, unsupported: tuple[str, ...] = ("counter_attack", "high_press", "low_block")) -> DataFrame:
    """rule and violations: more formations than matches, or claims that nothing supports."""
    from ..sources.sinks import violations

    return violations(rows, {"formation_matches": F.col("formation_matches") <= F.col("matches"), "style_signal": ~F.col("style_signal").isin(*unsupported), "defensive_signal": ~F.col("defensive_signal").isin(*unsupported)})


def prevalence(rows: DataFrame, signal: str) -> DataFrame:
    return rows.groupBy(F.col(signal).alias("signal")).agg(F.count("*").alias("rows"))


def column_coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, present, rows, pct and state: available, partial, unavailable, or unknown without rows."""
    counts = rows.agg(F.count("*").alias("rows"), *(F.count(f"`{c}`").alias(c) for c in columns)).unpivot("rows", columns, "column", "present")
    state = F.when(F.col("rows") == 0, "unknown").when(F.col("present") == 0, "unavailable").when(F.col("present") == F.col("rows"), "available").otherwise("partial")
    return counts.select("column", "present", "rows", F.round(F.try_divide(100.0 * F.col("present"), F.col("rows")), 2).alias("pct"), state.alias("state"))


def weight_faults(groups: Mapping[str, Mapping[str, float]], known: set[str] | None = None) -> list[str]:
    """What is wrong with groups of weights: empty ones, sums other than 1, weights that are nought or not finite, unknown metrics."""
    out = []
    for group, weights in groups.items():
        if not weights:
            out.append(f"{group} is empty")
            continue
        total = sum(abs(w) for w in weights.values())
        if abs(total - 1) > 1e-9:
            out.append(f"{group}: weights sum to {total}")
        out += [f"{group}: the weight of {m} is {w}" for m, w in weights.items() if not w or not math.isfinite(w)]
        out += [f"{group}: {m} is unknown" for m in weights if known is not None and m not in known]
    return out


def report(checks: Mapping[str, DataFrame], faults: list[str]) -> str:
    """JSON of all checks (rule, violations) and faults; hard_status is fail if there is any."""
    found = {name: {r.rule: r.violations for r in df.collect()} for name, df in checks.items()}
    bad = bool(faults) or any(n for rules in found.values() for n in rules.values())
    return json.dumps({"hard_status": "fail" if bad else "pass", "checks": found, "faults": faults}, sort_keys=True)
