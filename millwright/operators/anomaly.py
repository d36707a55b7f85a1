"""Anomalies of sensor rows against a fitted baseline: robust scores, an isolation forest, and both combined."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.columns import finite, normalise_missing, seeded_order, unpivot
from millwright.functions.quantiles import median_mad, ordered_values, quantiles, value_counts

TREES, SAMPLE, THRESHOLD = 100, 256, 3.0


def fit_robust_baseline(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, median, mad, std (population) over finite values; zeros for a column without any. At least 4 rows are needed."""
    if df.limit(4).count() < 4:
        raise ValueError("a baseline needs at least 4 rows")
    cells = unpivot(normalise_missing(df), columns, "double").withColumn("value", finite(F.col("value")))
    one = cells.groupBy("column").agg(F.stddev_pop("value").alias("std"))
    two = median_mad(ordered_values(value_counts(cells)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return one.join(two, "column", "left").select("column", zero("median"), zero("mad"), zero("std"))


@dataclass(frozen=True)
class RobustStats:
    """The baseline's numbers by column, collected: one row for each column."""

    median: dict[str, float]
    scale: dict[str, float]

    @staticmethod
    def of(stats: DataFrame) -> RobustStats:
        rows = stats.collect()
        return RobustStats({r["column"]: r["median"] for r in rows}, {r["column"]: r["mad"] / 0.6745 if r["mad"] else r["std"] for r in rows})

    def z(self, column: str) -> Column:
        """Signed robust z; 0 for an imputed value and for a column without spread."""
        x = finite(F.col(column).cast("double"))
        return F.coalesce((x - self.median[column]) / self.scale[column], F.lit(0.0)) if self.scale[column] else F.lit(0.0)


def robust_scores(df: DataFrame, stats: RobustStats, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """The key, z (array, in the order of columns) and robust_score, the largest absolute z. A projection: no shuffle."""
    z = F.array(*[stats.z(c) for c in columns])
    out = normalise_missing(df).select(*key, *[c for c in columns if c not in key], z.alias("z"))
    return out.withColumn("robust_score", F.array_max(F.transform("z", lambda v: F.abs(v))))


def top_deviating(scores: DataFrame, columns: Sequence[str], k: int = 3) -> DataFrame:
    """scores with top: for each row its k most deviating columns (column, z, value), the first column of equal ones first."""
    each = F.array(*[F.struct((-F.abs(F.col("z")[i])).alias("o"), F.lit(i).alias("i"), F.lit(c).alias("column"), F.col("z")[i].alias("z"), finite(F.col(c).cast("double")).alias("value")) for i, c in enumerate(columns)])
    best = F.slice(F.array_sort(each), 1, k)
    return scores.withColumn("top", F.transform(best, lambda x: F.struct(x["column"].alias("column"), x["z"].alias("z"), x["value"].alias("value"))))


def top_anomalies(scores: DataFrame, score: str, key: Sequence[str], n: int = 20) -> DataFrame:
    """The n rows with the highest score, without values."""
    return scores.orderBy(F.desc(score), *key).limit(n).select(*key, score)


def anomaly_listing(scores: DataFrame, score: str, key: Sequence[str], columns: Sequence[str], n: int = 20, k: int = 3) -> DataFrame:
    """The n rows with the highest score: key, score, top (their k most deviating columns with z, without values), and rows_omitted, those not listed.

    scores has z, as robust_scores gives it. Only n rows are ranked and shown; the others are counted, by a pass that reads no column.
    """
    shown = top_deviating(scores, columns, k).orderBy(F.desc(score), *key).limit(n)
    shown = shown.select(*key, score, F.transform("top", lambda x: F.struct(x["column"].alias("column"), x["z"].alias("z"))).alias("top"))
    rest = scores.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("rows_omitted"))
    return shown.join(F.broadcast(rest))  # one row


def path_length(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> list[tuple]:
    """Nodes (node, feature or -1, cut or depth, left, right) of one tree; a leaf's cut is its path length."""
    nodes: list[tuple] = []
    work = [(0, x, 0)]
    nodes.append(())
    while work:
        node, rows, d = work.pop()
        spread = np.flatnonzero(np.ptp(rows, axis=0) > 0) if len(rows) > 1 else []
        if d == depth or not len(spread):
            nodes[node] = (node, -1, float(d + path_length(len(rows))), -1, -1)
            continue
        f = int(rng.choice(spread))
        cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        left, right = len(nodes), len(nodes) + 1
        nodes += [(), ()]
        nodes[node] = (node, f, cut, left, right)
        below = rows[:, f] < cut
        work += [(left, rows[below], d + 1), (right, rows[~below], d + 1)]
    return nodes


def tree_sample(rows: DataFrame, key: str, trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """tree, rank and the columns of rows: for each tree the `sample` rows of least rank, of those that are dealt to it. Every row is as likely as any other.

    One md5 of a row's key deals it to a few successive trees, just so many that a tree gets four times its sample (all trees where rows are
    few), and gives it a rank for each. Each task keeps the least `sample` rows of a tree, and such samples merge into the least of
    all, so rows are read once and no task holds more than trees x sample rows of a partition.
    """
    n = rows.count()
    few = min(trees, -(-4 * trees * sample // max(1, n)))
    digest = seeded_order(F.col(key), seed)
    word = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    kept = [c for c in rows.columns if c not in ("tree", "rank")]
    dealt = rows.select(*kept, *[word(i).alias(f"__w{i}") for i in range(3)], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(few - 1).cast("long"))).alias("__j"))
    rank = F.pmod(F.col("__w1") + F.col("__j") * F.col("__w2"), F.lit(1 << 32))
    dealt = dealt.select(*kept, F.pmod(F.col("__w0") + F.col("__j"), F.lit(trees)).cast("int").alias("tree"), rank.alias("rank"))
    if 4 * sample * trees < n * few:  # a tree's least ranks are below this for any table
        dealt = dealt.filter(F.col("rank") < int(4 * sample * trees / (n * few) * 2**32))
    order = [("tree", "ascending"), ("rank", "ascending"), (key, "ascending")]

    def least(held: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(held).sort_by(order)
        tree = table.column("tree").to_numpy()
        return table.filter(pa.array(np.arange(len(tree)) - np.searchsorted(tree, tree) < sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count > 4 * trees * sample:
                held = least(held).to_batches()
                count = sum(b.num_rows for b in held)
        if count:
            yield from least(held).to_batches()

    partial = dealt.mapInArrow(run, dealt.schema)
    return partial.repartition("tree").sortWithinPartitions("tree", "rank", key).mapInArrow(_first_of_each(sample), dealt.schema)


def _first_of_each(sample: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first `sample` rows of each tree, of rows sorted by tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            tree = b.column(b.schema.get_field_index("tree")).to_numpy()
            place = np.arange(len(tree)) - np.searchsorted(tree, tree) + np.where(tree == last, seen, 0)
            yield b.filter(pa.array(place < sample))
            last, seen = tree[-1], int(place[-1]) + 1

    return run


def fit_isolation_forest(df: DataFrame, stats: RobustStats, columns: Sequence[str], key: str, trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """tree, node, feature, cut, left, right: a table of trees x 2 x sample rows at most. Each tree grows from its rows of tree_sample."""
    filled = [F.coalesce(finite(F.col(c).cast("double")), F.lit(stats.median[c])).alias(f"x{i}") for i, c in enumerate(columns)]
    rows = normalise_missing(df).select(F.col(key).alias("key"), *filled)
    names = [f"x{i}" for i in range(len(columns))]

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["rank", "key"])
        tree = int(part["tree"].iloc[0])
        depth = int(np.ceil(np.log2(max(2, len(part)))))
        nodes = _grow(part[names].to_numpy(float), np.random.default_rng([seed, tree]), depth)
        return pd.DataFrame([(tree, *x) for x in nodes], columns=["tree", "node", "feature", "cut", "left", "right"])

    return tree_sample(rows, "key", trees, sample, seed).groupBy("tree").applyInPandas(grow, "tree int, node int, feature int, cut double, left int, right int")


def isolation_scores(df: DataFrame, forest: DataFrame, stats: RobustStats, columns: Sequence[str], key: Sequence[str], sample: int = SAMPLE) -> DataFrame:
    """The key and isolation_score, higher for stranger rows (above 0 stranger than most)."""
    table = forest.toPandas().sort_values(["tree", "node"])  # bounded by trees and sample
    trees = [g[["feature", "cut", "left", "right"]].to_numpy(float).T for _, g in table.groupby("tree")]
    size = max((int((t[0] < 0).sum()) for t in trees), default=2)
    shared = df.sparkSession.sparkContext.broadcast((trees, float(path_length(np.array(max(2, min(sample, size)))))))
    filled = [F.coalesce(finite(F.col(c).cast("double")), F.lit(stats.median[c])).alias(f"__x{i}") for i, c in enumerate(columns)]
    rows = normalise_missing(df).select(*key, *filled)
    names = [f"__x{i}" for i in range(len(columns))]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, norm = shared.value
        for part in parts:
            x, total = part[names].to_numpy(float), np.zeros(len(part))
            for feature, cut, left, right in trees:
                at = np.zeros(len(part), int)
                open_ = np.arange(len(part))[feature[at] >= 0] if len(part) else np.arange(0)
                while len(open_):
                    node = at[open_]
                    below = x[open_, feature[node].astype(int)] < cut[node]
                    at[open_] = np.where(below, left[node], right[node]).astype(int)
                    open_ = open_[feature[at[open_]] >= 0]
                total += cut[at]
            yield part[list(key)].assign(isolation_score=2.0 ** (-total / max(1, len(trees)) / norm) - 0.5)

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)
    return rows.mapInPandas(run, f"{kinds}, isolation_score double")


@dataclass(frozen=True)
class Combiner:
    """Centre and scale of each score on the baseline, and the threshold of their mean."""

    centre: dict[str, float]
    scale: dict[str, float]
    threshold: float = THRESHOLD

    def score(self) -> Column:
        parts = [(F.col(s) - self.centre[s]) / self.scale[s] for s in self.centre]
        return sum(parts[1:], parts[0]) / len(parts)


def fit_combiner(baseline: DataFrame, scores: Sequence[str], contamination: float | None = None) -> Combiner:
    """Scores are centred by the baseline's median and scaled by MAD / 0.6745, else std, else 1; contamination sets the threshold's quantile."""
    std = baseline.agg(*[F.stddev_pop(s).alias(s) for s in scores]).first()
    rows = {r["column"]: r for r in median_mad(ordered_values(value_counts(unpivot(baseline, scores, "double")))).collect()}  # one for each score
    if lost := [s for s in scores if s not in rows]:
        raise ValueError(f"no values of {lost}")
    centre = {s: rows[s]["median"] for s in scores}
    scale = {s: rows[s]["mad"] / 0.6745 if rows[s]["mad"] else std[s] or 1.0 for s in scores}
    out = Combiner(centre, scale)
    if contamination is None:
        return out
    counts = value_counts(baseline.select(F.lit(0).alias("column"), out.score().alias("value")))
    return Combiner(centre, scale, quantiles(counts, [1 - contamination]).first()["q"][0])


def combined_score(df: DataFrame, combiner: Combiner) -> DataFrame:
    """df with combined_score and flagged (strictly above the threshold)."""
    return df.withColumn("combined_score", combiner.score()).withColumn("flagged", F.col("combined_score") > combiner.threshold)


def anomaly_summary(scored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: n_rows, n_flagged, rate (six decimals), features."""
    rate = F.round(F.coalesce(F.try_divide(F.count_if("flagged"), F.count("*")), F.lit(0.0)), 6)
    return scored.agg(F.count("*").alias("n_rows"), F.count_if("flagged").alias("n_flagged"), rate.alias("rate")).withColumn("features", F.array(*[F.lit(c) for c in columns]))
