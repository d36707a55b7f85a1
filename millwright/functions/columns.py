"""Column expressions and rules over column names that the operators share."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Substrings of normalised column names and words that stand for truth values.
IDENTIFIER_HINTS = (
    "id", "uid", "udi", "uuid", "serial", "asset", "machine", "equipment", "device", "unit", "part", "component", "tag", "code", "plate",
    "vin", "index", "no", "number",
)
SENSOR_HINTS = (
    "temp", "temperature", "pressure", "vibration", "rpm", "speed", "torque", "flow", "power", "current", "voltage", "force", "load", "heat",
    "humidity", "level", "rotational", "air", "process", "celcius", "fahrenheit",
)
TARGET_HINTS = (
    "failure", "fault", "fail", "label", "target", "class", "status", "condition", "rul", "ttf", "health", "remaining", "defect", "anomaly",
    "error", "alarm", "maintenance", "breakdown", "down",
)
TIMESTAMP_HINTS = ("time", "date", "datetime", "timestamp", "created", "recorded", "logged", "day", "hour", "minute")
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n", "1", "0", "t", "f", "on", "off")
TRUE_WORDS = ("true", "t", "yes", "y", "1", "on", "1.0")
FALSE_WORDS = ("false", "f", "no", "n", "0", "off", "0.0")


def coarse_dtype(kind: T.DataType) -> str:
    """bool, datetime, int, float or string."""
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(kind, T.IntegralType):
        return "int"
    return "float" if isinstance(kind, (T.FractionalType,)) else "string"


def is_numeric(kind: T.DataType, booleans: bool = True) -> bool:
    return isinstance(kind, T.NumericType) or booleans and isinstance(kind, T.BooleanType)


def normalise_name(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def has_hint(name: str, hints: Sequence[str]) -> bool:
    """Whether a hint is a substring of the normalised name."""
    return any(h in normalise_name(name) for h in hints)


def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN becomes null, so that one concept of missing holds everywhere."""
    fractions = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in fractions}) if fractions else df


def finite(c: Column) -> Column:
    """The value, or null if it is infinite or not a number."""
    return F.when(F.abs(c) < float("inf"), c)


def to_num(c: Column) -> Column:
    """A number, or null if it is none."""
    return c.try_cast("double")


def to_ts(c: Column) -> Column:
    """A timestamp, or null if it is none."""
    return c.try_cast("timestamp_ntz")


def boolean_code(c: Column, kind: T.DataType) -> Column:
    """1.0, 0.0 or null: numbers and booleans as they are, words by the fixed lists."""
    if is_numeric(kind):
        return c.cast("double")
    word = F.lower(F.trim(c))
    return F.when(word.isin(*TRUE_WORDS), 1.0).when(word.isin(*FALSE_WORDS), 0.0)


def decode_label(index: Column, labels: Sequence[str]) -> Column:
    """Class index to label, in the order of labels."""
    return F.try_element_at(F.array(*[F.lit(x) for x in labels]), index.cast("int") + 1)


def input_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the named columns as JSON, in the order of their names."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def config_hash(settings: Mapping) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


def redact(df: DataFrame, allow: Sequence[str]) -> DataFrame:
    """Only the allowed columns, in their order in df."""
    return df.select([c for c in df.columns if c in allow])


def redact_nested(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df without the columns, struct fields and entries of maps that have one of the names (in any case), however deeply they are nested.

    Null values stay null; a struct that would have no field left goes, and so does an array or map of such structs.
    """
    gone = {n.lower() for n in names}

    def cleaned(value: Column, kind: T.DataType) -> Column | None:
        if isinstance(kind, T.StructType):
            fields = {f.name: cleaned(value.getField(f.name), f.dataType) for f in kind if f.name.lower() not in gone}
            kept = [c.alias(n) for n, c in fields.items() if c is not None]
            return F.when(value.isNotNull(), F.struct(*kept)) if kept else None
        if isinstance(kind, T.ArrayType):
            return None if _hollow(kind.elementType, gone) else F.transform(value, lambda x: cleaned(x, kind.elementType)) if _nested(kind.elementType) else value
        if isinstance(kind, T.MapType):
            if _hollow(kind.valueType, gone):
                return None
            value = F.map_filter(value, lambda k, _: ~F.lower(k).isin(*gone)) if isinstance(kind.keyType, T.StringType) and gone else value
            return F.transform_values(value, lambda _, x: cleaned(x, kind.valueType)) if _nested(kind.valueType) else value
        return value

    kept = {f.name: cleaned(F.col(f"`{f.name}`"), f.dataType) for f in df.schema if f.name.lower() not in gone}
    return df.select(*[c.alias(n) for n, c in kept.items() if c is not None])


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.ArrayType, T.MapType))


def _hollow(kind: T.DataType, gone: set[str]) -> bool:
    """Whether nothing is left of a type without the fields of these names."""
    if isinstance(kind, T.StructType):
        return all(f.name.lower() in gone or _hollow(f.dataType, gone) for f in kind)
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType if isinstance(kind, T.MapType) else None
    return inner is not None and _hollow(inner, gone)


def percent_text(c: Column) -> Column:
    return F.concat(F.format_number(c * 100, 1), F.lit("%"))


def seeded_order(key: Column, seed: int) -> Column:
    """A pseudo-random order that does not depend on partitioning."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def unpivot(df: DataFrame, columns: Sequence[str], kind: str, keep: Sequence[str] = ()) -> DataFrame:
    """column, value (cast to kind), with the columns to keep: one row for each cell."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(kind).alias("value")) for c in columns])
    rows = df.select(*keep, F.explode(cells).alias("cell"))
    return rows.select(*rows.columns[:-1], "cell.column", "cell.value")
