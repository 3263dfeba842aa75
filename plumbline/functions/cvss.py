"""CVSS v3 base scores by the public formula, as arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the standard.
AV = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}
AC = {"L": 0.77, "H": 0.44}
PR = {"N": 0.85, "L": 0.62, "H": 0.27}
PR_CHANGED = {"N": 0.85, "L": 0.68, "H": 0.5}
UI = {"N": 0.85, "R": 0.62}
IMPACT = {"H": 0.56, "L": 0.22, "N": 0.0}


def metric(vector: Column, name: str, weights: dict[str, float]) -> Column:
    value = F.regexp_extract(vector, f"(?:^|/){name}:([A-Z])(?:/|$)", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), value)


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def base_score(vector: Column, old_rounding: bool = False) -> Column:
    """The base score of a vector with or without prefix; null if a metric is missing or unknown."""

    def parts(v: Column) -> Column:
        changed = F.regexp_extract(v, "(?:^|/)S:([UC])(?:/|$)", 1) == "C"
        iss = 1 - (1 - metric(v, "C", IMPACT)) * (1 - metric(v, "I", IMPACT)) * (1 - metric(v, "A", IMPACT))
        privileges = F.when(changed, metric(v, "PR", PR_CHANGED)).otherwise(metric(v, "PR", PR))
        exploit = 8.22 * metric(v, "AV", AV) * metric(v, "AC", AC) * privileges * metric(v, "UI", UI)
        known = v.rlike("(?:^|/)S:[UC](?:/|$)")
        return F.struct(iss.alias("iss"), F.when(known, exploit).alias("exploit"), changed.alias("changed"))

    def impact(p: Column) -> Column:
        value = F.when(p["changed"], 7.52 * (p["iss"] - 0.029) - 3.25 * F.pow(p["iss"] - 0.02, F.lit(15))).otherwise(6.42 * p["iss"])
        return F.struct(value.alias("impact"), p["exploit"].alias("exploit"), p["changed"].alias("changed"))

    def rounded(raw: Column) -> Column:
        if old_rounding:
            return F.ceil(raw * 10) / 10
        return let(F.round(raw * 100000).cast("long"), lambda w: F.when(w % 10000 == 0, w / 100000).otherwise((F.floor(w / 10000) + 1) / 10))

    def score(p: Column) -> Column:
        total = p["impact"] + p["exploit"]
        raw = F.least(F.when(p["changed"], 1.08 * total).otherwise(total), F.lit(10.0))
        return F.when(total.isNull(), F.lit(None).cast("double")).when(p["impact"] <= 0, F.lit(0.0)).otherwise(let(raw, rounded))

    return let(F.upper(vector), lambda v: let(parts(v), lambda p: let(impact(p), score)))
