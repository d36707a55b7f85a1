"""Feature preparation, fitted on the train fold and applied anywhere."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.functions.columns import boolean_code, coarse_dtype, is_numeric, normalise_missing, unpivot
from millwright.functions.quantiles import modes, quantiles, value_counts
from millwright.operators.profile import boolean_like, column_profile


class FeatureError(ValueError):
    """No usable features, or a feature that is missing."""


def resolve_features(train: DataFrame, target: str, excluded: Sequence[str] = (), near_unique: float = 0.9) -> list[str]:
    """Columns in their order without the target, excluded ones, datetimes and nearly unique texts."""
    out = [f.name for f in train.schema if f.name != target and f.name not in excluded and coarse_dtype(f.dataType) != "datetime" and isinstance(f.dataType, (T.NumericType, T.BooleanType, T.StringType))]
    texts = [c for c in out if coarse_dtype(train.schema[c].dataType) == "string"]
    if texts:
        unique = {r[0] for r in column_profile(train, texts).filter(F.col("unique_ratio") >= near_unique).collect()}  # a row for each column
        out = [c for c in out if c not in unique]
    if not out:
        raise FeatureError("no usable feature")
    return out


def classify_columns(train: DataFrame, features: Sequence[str]) -> dict[str, str]:
    """numeric, boolean or categorical for each feature; drop for one without a value."""
    profile = {r["column"]: r for r in column_profile(train, features).collect()}
    booleans = {r[0] for r in boolean_like(train, features).filter("boolean_like").collect()}
    out = {}
    for c in features:
        if profile[c]["n_distinct"] == 0:
            out[c] = "drop"
        else:
            out[c] = "boolean" if c in booleans else "numeric" if is_numeric(train.schema[c].dataType) else "categorical"
    return out


@dataclass(frozen=True)
class Preprocessor:
    """Statistics of the train fold: median, mean and population std of numbers (after imputation), modes of the others."""

    kinds: dict[str, str]
    fills: dict[str, float | str | None]
    means: dict[str, float]
    stds: dict[str, float]
    encoder: PipelineModel | None

    def columns(self) -> list[str]:
        return [f"{c}__{'index' if k == 'categorical' else 'x'}" for c, k in self.kinds.items() if k != "drop"]

    def impute(self, df: DataFrame) -> DataFrame:
        """df with c__x for each numeric (scaled) and boolean (0 and 1) feature and c__text for each categorical one, nulls filled."""
        df, new = normalise_missing(df), {}
        for c, kind in self.kinds.items():
            if kind == "numeric":
                x = F.coalesce(F.col(c).cast("double"), F.lit(self.fills[c]))
                new[f"{c}__x"] = (x - self.means[c]) / self.stds[c] if self.stds[c] else x - self.means[c]
            elif kind == "boolean":
                new[f"{c}__x"] = F.coalesce(boolean_code(F.col(c), df.schema[c].dataType), F.lit(self.fills[c]))
            elif kind == "categorical":
                new[f"{c}__text"] = F.coalesce(F.col(c).cast("string"), F.lit(self.fills[c]))
        return df.withColumns(new)

    def transform(self, df: DataFrame) -> DataFrame:
        """df with the vector column features; an unknown level of a category is all zeros."""
        out = self.impute(df)
        out = self.encoder.transform(out)
        return out.drop(*[c for c in out.columns if c.endswith(("__x", "__text", "__index", "__hot"))])

    def names(self) -> list[str]:
        """What each place of the vector stands for."""
        out = [c for c, k in self.kinds.items() if k in ("numeric", "boolean")]
        texts = [c for c, k in self.kinds.items() if k == "categorical"]
        if texts:
            indexer = self.encoder.stages[0]
            out += [f"{c}={level}" for c, levels in zip(texts, indexer.labelsArray, strict=True) for level in levels]
        return out


def fit_preprocessor(train: DataFrame, features: Sequence[str]) -> Preprocessor:
    """Counts of values give the fills, one aggregate the moments after filling."""
    train = normalise_missing(train)
    kinds = classify_columns(train, features)
    codes = {c: boolean_code(F.col(c), train.schema[c].dataType) for c, k in kinds.items() if k == "boolean"}
    fills = _medians(train, [c for c, k in kinds.items() if k == "numeric"]) | _modes(train, [c for c, k in kinds.items() if k == "categorical"])
    if codes:  # zeros and ones
        fills |= train.agg(*[F.when(F.count_if(x == 1.0) > F.count_if(x == 0.0), 1.0).otherwise(0.0).alias(c) for c, x in codes.items()]).first().asDict()
    numbers = [c for c, k in kinds.items() if k == "numeric"]
    means, stds = {}, {}
    if numbers:
        filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(fills[c])) for c in numbers}
        row = train.agg(*[F.avg(x).alias(f"m_{c}") for c, x in filled.items()], *[F.stddev_pop(x).alias(f"s_{c}") for c, x in filled.items()]).first()
        means, stds = {c: row[f"m_{c}"] for c in numbers}, {c: row[f"s_{c}"] for c in numbers}
    half = Preprocessor(kinds, fills, means, stds, None)
    texts = [c for c, k in kinds.items() if k == "categorical"]
    stages = []
    if texts:
        stages.append(StringIndexer(inputCols=[f"{c}__text" for c in texts], outputCols=[f"{c}__index" for c in texts], handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=[f"{c}__index" for c in texts], outputCols=[f"{c}__hot" for c in texts], dropLast=True))
    plain = [f"{c}__x" for c, k in kinds.items() if k in ("numeric", "boolean")]
    stages.append(VectorAssembler(inputCols=plain + [f"{c}__hot" for c in texts], outputCol="features"))
    return Preprocessor(kinds, fills, means, stds, Pipeline(stages=stages).fit(half.impute(train)))


def _medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    found = quantiles(value_counts(unpivot(train, columns, "double")), [0.5]).collect() if columns else []  # a row for each column
    return dict.fromkeys(columns) | {r["column"]: r["q"][0] for r in found}


def _modes(train: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    found = modes(unpivot(train, columns, "string")).collect() if columns else []  # a row for each column
    return dict.fromkeys(columns) | {r["column"]: r["mode"] for r in found}


def feature_baseline(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: the median of each number, the mode of every other feature."""
    train = normalise_missing(train)
    numbers = [c for c in features if is_numeric(train.schema[c].dataType, booleans=False)]
    fills = _medians(train, numbers) | _modes(train, [c for c in features if c not in numbers])
    kinds = {c: T.DoubleType() if c in numbers else train.schema[c].dataType for c in features}
    return train.sparkSession.range(1).select(*[F.lit(fills[c]).cast(kinds[c]).alias(c) for c in features])
