"""Roles: classification, group intersection, filters and the leak audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify(prefix: Column, text: Column, prefixes: dict[str, str], keywords: dict[str, list[str]], default: str = "General") -> Column:
    """The first label whose id prefix holds, else whose keyword occurs, in the order given."""
    low = F.lower(text)
    cases = [(prefix.startswith(p), label) for label, p in prefixes.items()] + [(reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in ks]), label) for label, ks in keywords.items()]
    return reduce(lambda out, case: F.when(case[0], F.lit(case[1])).otherwise(out), reversed(cases), F.lit(default))


def roles_known(roles: list[str], known: dict[str, str]) -> list[str]:
    """Canonical names in order, once each; none left is an error."""
    out = list(dict.fromkeys(known[r] for r in roles if r in known))
    if not out:
        raise ValueError("no known role")
    return out


def permitted(rows: DataFrame, roles: list[str], column: str = "allowed_roles") -> DataFrame:
    return rows.where(F.arrays_overlap(column, F.array(*map(F.lit, roles))))


def group_roles(rows: DataFrame, by: str, roles: str = "allowed_roles", default: str = "Admin") -> DataFrame:
    """Roles that all rows of a group allow, joined; the default where none does.  Counts are aggregated, no group is gathered."""
    total = rows.groupBy(by).agg(F.count("*").alias("n"))
    each = rows.select(by, F.explode(F.array_distinct(roles)).alias("role")).groupBy(by, "role").agg(F.count("*").alias("k"))
    common = each.join(total, by).where("k = n").groupBy(by).agg(F.array_join(F.array_sort(F.collect_list("role")), ",").alias("roles"))
    return total.select(by).join(common, by, "left").select(by, F.coalesce("roles", F.lit(default)).alias("roles"))


def leak_audit(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """hits (case_id, authorized, doc_id, score), cases (case_id, target): FAIL if an unauthorized run shows the target, WARN if no authorized one does."""
    seen = F.coalesce(F.col("doc_id") == F.col("target"), F.lit(False))
    out = cases.join(hits, "case_id", "left").groupBy("case_id").agg(F.sum((seen & ~F.col("authorized")).cast("long")).alias("leaks"), F.sum((seen & F.col("authorized")).cast("long")).alias("found"))
    return out.select("case_id", F.coalesce("leaks", F.lit(0)).alias("leaks"), F.coalesce("found", F.lit(0)).alias("found")).withColumn("verdict", F.when(F.col("leaks") > 0, "FAIL").when(F.col("found") == 0, "WARN").otherwise("PASS"))
