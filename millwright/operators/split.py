"""Folds of a table that leak neither the future nor assets; the result is the input with the column fold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.columns import seeded_order, to_ts
from millwright.functions.prefix import global_order
from millwright.operators.quality import Roles


class SplitError(ValueError):
    """The table or the settings do not allow this split."""


@dataclass(frozen=True)
class SplitPlan:
    test: float = 0.20
    validation: float = 0.20
    seed: int = 42


def choose_strategy(roles: Roles, classification: bool) -> str:
    if roles.asset and roles.ts:
        return "group_time"
    if roles.asset:
        return "group"
    if roles.ts:
        return "chronological"
    return "stratified" if classification and roles.target else "random"


def _held_out(n: Column, fraction: float) -> Column:
    """The number of rows (or assets) to hold out: the fraction rounded up, at least one."""
    return F.greatest(F.lit(1), F.ceil(n * fraction))


def _fold(df: DataFrame, out: Column, name: str) -> DataFrame:
    return df.withColumn("fold", F.when(out, name).otherwise("train"))


def split_group_time(df: DataFrame, roles: Roles, fraction: float = 0.2, name: str = "test") -> DataFrame:
    """The last rows of each asset are held out; an asset with one row stays in train."""
    asset = Window.partitionBy(roles.asset)
    last_first = asset.orderBy(F.desc(roles.ts), F.desc(roles.key))
    df = df.withColumn("__n", F.count("*").over(asset)).withColumn("__rn", F.row_number().over(last_first))
    return _fold(df, (F.col("__n") > 1) & (F.col("__rn") <= _held_out(F.col("__n"), fraction)), name).drop("__n", "__rn")


def split_group(df: DataFrame, roles: Roles, fraction: float = 0.2, seed: int = 42, name: str = "test") -> DataFrame:
    """Whole assets are held out, in an order by seed."""
    assets = df.select(F.col(roles.asset).alias("__asset")).distinct().withColumn("__order", seeded_order(F.col("__asset"), seed))
    ranked = global_order(assets, ["__order", "__asset"])
    chosen = ranked.filter(F.col("rank") <= _held_out(F.col("total"), fraction)).select("__asset", F.lit(True).alias("__out"))
    joined = df.join(chosen, F.col(roles.asset) == F.col("__asset"), "left")
    return _fold(joined, F.coalesce("__out", F.lit(False)), name).drop("__asset", "__out")


def split_chronological(df: DataFrame, roles: Roles, fraction: float = 0.2, name: str = "test") -> DataFrame:
    """The last rows overall are held out."""
    ranked = global_order(df, [F.desc(roles.ts), F.desc(roles.key)])
    return _fold(ranked, F.col("rank") <= _held_out(F.col("total"), fraction), name).drop("rank", "total")


def split_stratified(df: DataFrame, roles: Roles, fraction: float = 0.2, seed: int = 42, name: str = "test") -> DataFrame:
    """Of each class its share, to the nearest row, is held out, in an order by seed.

    Rows of a class are ranked within their seeded bucket; cumulated bucket sizes, at most 4096 numbers for a
    class, give the rank in the class, so a class that holds most rows is not sorted in one task.
    """
    order = seeded_order(F.col(roles.key), seed)
    df = df.withColumn("__order", order).withColumn("__bucket", F.substring("__order", 1, 3))
    sizes = df.groupBy(roles.target, "__bucket").agg(F.count("*").alias("__size"))
    classes = Window.partitionBy(roles.target)
    sizes = sizes.withColumn("__n", F.sum("__size").over(classes)).withColumn("__before", F.sum("__size").over(classes.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)))
    within = Window.partitionBy(roles.target, "__bucket").orderBy("__order", roles.key)
    df = df.withColumn("__rn", F.row_number().over(within)).join(sizes.drop("__size"), [roles.target, "__bucket"])
    rank = F.col("__rn") + F.coalesce("__before", F.lit(0))
    return _fold(df, rank <= F.round(F.col("__n") * fraction), name).drop("__order", "__bucket", "__rn", "__n", "__before")


def split_random(df: DataFrame, roles: Roles, fraction: float = 0.2, seed: int = 42, name: str = "test") -> DataFrame:
    """A share of all rows is held out, in an order by seed."""
    ranked = global_order(df.withColumn("__order", seeded_order(F.col(roles.key), seed)), ["__order", roles.key])
    return _fold(ranked, F.col("rank") <= _held_out(F.col("total"), fraction), name).drop("rank", "total", "__order")


def _apply(df: DataFrame, strategy: str, roles: Roles, fraction: float, seed: int, name: str) -> DataFrame:
    if strategy == "group_time":
        return split_group_time(df, roles, fraction, name)
    if strategy == "chronological":
        return split_chronological(df, roles, fraction, name)
    return {"group": split_group, "stratified": split_stratified, "random": split_random}[strategy](df, roles, fraction, seed, name)


def validate(df: DataFrame, roles: Roles, strategy: str, plan: SplitPlan) -> int:
    """Raise SplitError where the split is impossible, by one aggregate; the number of rows."""
    if not (0 < plan.test < 1 and 0 <= plan.validation < 1 and plan.test + plan.validation < 1):
        raise SplitError("fractions must be within 0 and 1, and their sum below 1")
    needed = {"group_time": (roles.asset, roles.ts), "group": (roles.asset,), "chronological": (roles.ts,), "stratified": (roles.target,), "random": ()}[strategy]
    if missing := [c for c in (*needed, roles.key) if c not in df.columns]:
        raise SplitError(f"missing columns: {missing}")
    facts = df.agg(F.count("*").alias("n"), *[F.count_if(to_ts(F.col(c)).isNull() if c == roles.ts else F.col(c).isNull()).alias(f"bad_{c}") for c in needed]).first()
    if facts["n"] < 4:
        raise SplitError("fewer than 4 rows")
    if bad := [c for c in needed if facts[f"bad_{c}"]]:
        raise SplitError(f"rows without a valid value: {bad}")
    if strategy == "group" and df.select(roles.asset).distinct().limit(2).count() < 2:
        raise SplitError("fewer than 2 assets")
    if strategy == "stratified":
        least, classes = df.groupBy(roles.target).count().agg(F.min("count"), F.count("*")).first()
        if classes < 2 or least < 2:
            raise SplitError("each of at least 2 classes needs 2 rows")
    return facts["n"]


def _without_empty_fold(df: DataFrame, other: str) -> DataFrame:
    counts = df.agg(F.count_if(F.col("fold") == "train"), F.count_if(F.col("fold") == other)).first()
    if not all(counts):
        raise SplitError(f"an empty fold: train has {counts[0]} rows, {other} has {counts[1]}")
    return df


def split(df: DataFrame, roles: Roles, strategy: str, plan: SplitPlan = SplitPlan()) -> DataFrame:
    """df with fold: train, validation or test; split_with_note() tells why there is no validation fold, if it was asked for."""
    return split_with_note(df, roles, strategy, plan)[0]


def split_with_note(df: DataFrame, roles: Roles, strategy: str, plan: SplitPlan = SplitPlan()) -> tuple[DataFrame, str | None]:
    """df with fold, and a note where validation cannot be carved from train by the same strategy: then train stays whole."""
    validate(df, roles, strategy, plan)
    if strategy == "group_time" and df.groupBy(roles.asset).count().filter("count > 1").isEmpty():
        strategy = "chronological"
    first = _without_empty_fold(_apply(df, strategy, roles, plan.test, plan.seed, "test"), "test")
    train, share = first.filter("fold = 'train'").drop("fold"), plan.validation / (1 - plan.test)
    if not plan.validation:
        return first, None
    try:
        validate(train, roles, strategy, SplitPlan(test=share, validation=0.0, seed=plan.seed))
        second = _without_empty_fold(_apply(train, strategy, roles, share, plan.seed, "validation"), "validation")
    except SplitError as reason:
        return first, f"no validation fold: {reason}"
    return second.unionByName(first.filter("fold <> 'train'")), None


def split_by_source(train: DataFrame, test: DataFrame) -> DataFrame:
    """An official holdout: the source decides the fold."""
    return train.withColumn("fold", F.lit("train")).unionByName(test.withColumn("fold", F.lit("test")))


def split_audit(df: DataFrame, roles: Roles) -> DataFrame:
    """fold, n, assets, and for each fold the number of its assets that are also in train, and of those with readings before train ends."""
    by = [F.col(roles.asset).alias("asset"), "fold"]
    each = df.groupBy(*by).agg(F.count("*").alias("n"), F.min(roles.ts).alias("first"), F.max(roles.ts).alias("last"))
    train = each.filter("fold = 'train'").select("asset", F.col("last").alias("train_last"))
    joined = each.join(train, "asset", "left")
    other = F.col("fold") != "train"
    return joined.groupBy("fold").agg(
        F.sum("n").alias("n"), F.count("*").alias("n_assets"), F.count_if(other & F.col("train_last").isNotNull()).alias("shared_assets"),
        F.count_if(other & (F.col("first") < F.col("train_last"))).alias("early_assets"),
    )
