"""Drift between a baseline and a production window, feature by feature."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.columns import finite, is_numeric, normalise_missing, unpivot
from millwright.functions.prefix import running_within
from millwright.functions.quantiles import at_ranks

SEVERITIES = ("LOW", "MEDIUM", "HIGH")
#: Pairs of readings of two windows up to which the p-value of their distance is exact.
EXACT_PAIRS = 10_000


@dataclass(frozen=True)
class DriftPlan:
    psi: tuple[float, float] = (0.10, 0.25)
    ks: tuple[float, float] = (0.10, 0.20)
    shift: tuple[float, float] = (0.5, 1.0)
    missing: tuple[float, float] = (0.05, 0.15)
    bins: int = 10
    epsilon: float = 1e-6


def align(base: DataFrame, prod: DataFrame, columns: Sequence[str] | None = None) -> tuple[list[str], list[str], list[str]]:
    """Columns of both windows, and those of the baseline and of production only; a wanted column that is missing is an error."""
    if columns is not None:
        if lost := [c for c in columns if c not in base.columns or c not in prod.columns]:
            raise ValueError(f"missing columns: {lost}")
        return list(columns), [], []
    both = [c for c in base.columns if c in prod.columns]
    return both, [c for c in base.columns if c not in both], [c for c in prod.columns if c not in both]


def _cells(base: DataFrame, prod: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """column, value, side (0 baseline, 1 production)."""
    parts = [unpivot(normalise_missing(df), columns, kind).withColumn("side", F.lit(i)) for i, df in enumerate((base, prod))]
    return parts[0].unionByName(parts[1])


def _present(base: DataFrame, prod: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = _cells(base, prod, columns, "double")
    return cells.withColumn("value", finite(F.col("value"))).filter("value is not null")


def ordered_counts(base: DataFrame, prod: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value, b, p: occurrences on both sides, with running sums (below_b, below_p) and those of the column (_all), from one global order."""
    counts = _present(base, prod, columns).groupBy("column", "value").agg(F.count_if(F.col("side") == 0).alias("b"), F.count_if(F.col("side") == 1).alias("p"))
    return running_within(counts, "column", ["value"], {"below_b": "b", "below_p": "p"})


def psi_numeric(base: DataFrame, prod: DataFrame, columns: Sequence[str], bins: int = 10, epsilon: float = 1e-6, ordered: DataFrame | None = None) -> DataFrame:
    """column, n_bins, psi over the baseline's quantile bins and two overflow bins; null with fewer than two different edges or an empty side."""
    ordered = ordered_counts(base, prod, columns) if ordered is None else ordered
    edges = at_ranks(ordered, [i / bins for i in range(bins + 1)], n="b", upto="below_b").select("column", F.array_distinct("q").alias("edges"))
    last = F.element_at("edges", -1)
    place = F.when(F.col("value") == last, F.size("edges") - 1).otherwise(F.size(F.filter("edges", lambda e: e <= F.col("value"))))
    counts = ordered.select("column", "value", "b", "p").join(F.broadcast(edges), "column").withColumn("bin", place)  # one row for each column
    counts = counts.groupBy("column", "bin").agg(F.sum("b").alias("b"), F.sum("p").alias("p"))
    grid = edges.select("column", F.size("edges").alias("k"), F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    full = grid.join(counts, ["column", "bin"], "left").fillna(0, ["b", "p"])
    total = Window.partitionBy("column")
    full = full.withColumns({"n_bins": F.col("k") + 1, "b_all": F.sum("b").over(total), "p_all": F.sum("p").over(total)})
    share = lambda n, all_: (F.col(n) + epsilon) / (F.col(all_) + epsilon * F.col("n_bins"))
    term = (share("p", "p_all") - share("b", "b_all")) * F.ln(share("p", "p_all") / share("b", "b_all"))
    out = full.groupBy("column", "k", "n_bins", "b_all", "p_all").agg(F.sum(term).alias("psi"))
    return out.select("column", "n_bins", F.when((F.col("k") >= 2) & (F.col("b_all") > 0) & (F.col("p_all") > 0), F.col("psi")).alias("psi"))


def ks_two_sample(base: DataFrame, prod: DataFrame, columns: Sequence[str], ordered: DataFrame | None = None) -> DataFrame:
    """column, ks, p_value, method: the largest distance of the distribution functions, over the different values of a column.

    The p-value is exact for windows of at most EXACT_PAIRS pairs of readings (method exact), else the asymptotic series.
    """
    ordered = ordered_counts(base, prod, columns) if ordered is None else ordered
    counts = ordered.withColumnsRenamed({"below_b_all": "b_all", "below_p_all": "p_all"})
    d = F.abs(F.try_divide(F.col("below_b"), F.col("b_all")) - F.try_divide(F.col("below_p"), F.col("p_all")))
    out = counts.groupBy("column", "b_all", "p_all").agg(F.max(d).alias("ks"))
    n = F.col("b_all") * F.col("p_all") / (F.col("b_all") + F.col("p_all"))
    x = F.col("ks") * F.sqrt(n)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * x * x))
    asymptotic = F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))
    small = F.col("b_all") * F.col("p_all") <= EXACT_PAIRS
    exact = F.pandas_udf(_exact_p_values, "double")(*[F.when(small, F.col(c)) for c in ("b_all", "p_all", "ks")])  # of one row for each column
    return out.select("column", "ks", F.when(small & F.col("ks").isNotNull(), exact).otherwise(asymptotic).alias("p_value"), F.when(F.col("ks").isNotNull(), F.when(small, "exact").otherwise("asymptotic")).alias("method"))


def exact_p_value(n: int, m: int, ks: float) -> float:
    """The probability of a KS distance of at least ks between samples of n and m readings of one continuous distribution.

    All orders of the readings are lattice paths from (0, 0) to (n, m); those that stay nearer to the diagonal than ks are counted row by
    row, as shares of all paths, so that no number overflows. Ties are taken as for continuous readings.
    """
    bound = round(ks * n * m)  # a path is at |i * m - j * n|
    if bound <= 0:
        return 1.0
    column = np.arange(m + 1)
    inside = np.where(column * n < bound, 1.0, 0.0)
    for i in range(1, n + 1):
        near = np.abs(i * m - column * n) < bound
        inside = np.where(near, np.cumsum(np.where(near, inside * (i / (i + m)), 0.0)), 0.0)
    return float(min(1.0, max(0.0, 1.0 - inside[m])))


def _exact_p_values(n: pd.Series, m: pd.Series, ks: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(d) else exact_p_value(int(a), int(b), float(d)) for a, b, d in zip(n, m, ks, strict=True)], dtype="float64")


def moment_shift(base: DataFrame, prod: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, mean_shift and std_shift in baseline standard deviations (population); null if the baseline is constant."""
    s = {f"{f}{i}": agg(F.when(F.col("side") == i, F.col("value"))) for i in (0, 1) for f, agg in (("m", F.avg), ("s", F.stddev_pop))}
    out = _present(base, prod, columns).groupBy("column").agg(*[x.alias(n) for n, x in s.items()])
    return out.select("column", F.try_divide(F.col("m1") - F.col("m0"), F.col("s0")).alias("mean_shift"), F.try_divide(F.col("s1") - F.col("s0"), F.col("s0")).alias("std_shift"))


def new_category_rows(base: DataFrame, prod: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, category, n: categories that only production has and how often it has them, one row each, so a column may have any number."""
    cells = _cells(base, prod, columns, "string").filter("value is not null")
    counts = cells.groupBy("column", "value").agg(F.max(F.col("side") == 0).alias("known"), F.count("*").alias("n"))
    return counts.filter(~F.col("known")).select("column", F.col("value").alias("category"), "n")


def psi_categorical(base: DataFrame, prod: DataFrame, columns: Sequence[str], epsilon: float = 1e-6) -> DataFrame:
    """column, psi over the categories of both sides, total_variation, new_categories (of production only, sorted)."""
    cells = _cells(base, prod, columns, "string").filter("value is not null")
    counts = cells.groupBy("column", "value").agg(F.count_if(F.col("side") == 0).alias("b"), F.count_if(F.col("side") == 1).alias("p"))
    totals = counts.groupBy("column").agg(F.sum("b").alias("b_all"), F.sum("p").alias("p_all"), F.count("*").alias("k"))
    full = counts.join(F.broadcast(totals), "column")  # one row for each column
    share = lambda n, all_: (F.col(n) + epsilon) / (F.col(all_) + epsilon * F.col("k"))
    term = (share("p", "p_all") - share("b", "b_all")) * F.ln(share("p", "p_all") / share("b", "b_all"))
    apart = F.abs(F.try_divide(F.col("p"), F.col("p_all")) - F.try_divide(F.col("b"), F.col("b_all")))
    new = F.array_sort(F.collect_list(F.when((F.col("b") == 0) & (F.col("p") > 0), F.col("value"))))
    known = (F.col("b_all") > 0) & (F.col("p_all") > 0)
    out = full.groupBy("column", "b_all", "p_all").agg(F.sum(term).alias("psi"), (0.5 * F.sum(apart)).alias("total_variation"), new.alias("new_categories"))
    return out.select("column", F.when(known, F.col("psi")).alias("psi"), F.when(known, F.col("total_variation")).alias("total_variation"), "new_categories")


def missing_shift(base: DataFrame, prod: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, missing_shift: the change of the rate of nulls."""
    gone = F.col("value").isNull().cast("int")
    out = _cells(base, prod, columns, "string").groupBy("column").agg(F.avg(F.when(F.col("side") == 1, gone)).alias("p"), F.avg(F.when(F.col("side") == 0, gone)).alias("b"))
    return out.select("column", (F.col("p") - F.col("b")).alias("missing_shift"))


def severity_rank(value: Column, bands: tuple[float, float]) -> Column:
    """0, 1 or 2; an undefined value is 0."""
    return F.when(value >= bands[1], 2).when(value >= bands[0], 1).otherwise(0)


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in SEVERITIES]), rank + 1)


def drift_report(base: DataFrame, prod: DataFrame, columns: Sequence[str] | None = None, plan: DriftPlan = DriftPlan()) -> DataFrame:
    """column, psi, ks, total_variation, mean_shift, std_shift, missing_shift, new_categories, severity: one row for each feature.

    Booleans count as categories.
    """
    columns, _, _ = align(base, prod, columns)
    numbers = [c for c in columns if is_numeric(base.schema[c].dataType, booleans=False)]
    names = [c for c in columns if c not in numbers]
    empty = {"psi": "double", "ks": "double", "total_variation": "double", "mean_shift": "double", "std_shift": "double", "new_categories": "array<string>"}
    parts = []
    if numbers:
        ordered = ordered_counts(base, prod, numbers)  # serves both
        part = psi_numeric(base, prod, numbers, plan.bins, plan.epsilon, ordered).drop("n_bins")
        part = part.join(ks_two_sample(base, prod, numbers, ordered).drop("p_value", "method"), "column", "full_outer").join(moment_shift(base, prod, numbers), "column", "full_outer")
        parts.append(part)
    if names:
        parts.append(psi_categorical(base, prod, names, plan.epsilon))
    parts = [p.select("column", *[(F.col(c) if c in p.columns else F.lit(None)).cast(t).alias(c) for c, t in empty.items()]) for p in parts]
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = missing_shift(base, prod, columns).join(out, "column", "left")
    rank = F.greatest(
        severity_rank(F.col("psi"), plan.psi), severity_rank(F.col("ks"), plan.ks), severity_rank(F.col("total_variation"), plan.ks),
        severity_rank(F.abs("mean_shift"), plan.shift), severity_rank(F.abs("std_shift"), plan.shift), severity_rank(F.abs("missing_shift"), plan.missing),
    )
    return out.withColumn("severity", severity_name(rank))


def overall_severity(report: DataFrame) -> DataFrame:
    """One row: the worst severity and the number of features of each."""
    rank = F.array_position(F.array(*[F.lit(x) for x in SEVERITIES]), F.col("severity")) - 1
    return report.agg(severity_name(F.coalesce(F.max(rank), F.lit(0)).cast("int")).alias("severity"), *[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in SEVERITIES])


def by_severity(report: DataFrame) -> DataFrame:
    return report.orderBy(F.array_position(F.array(*[F.lit(x) for x in SEVERITIES]), F.col("severity")).desc(), "column")
