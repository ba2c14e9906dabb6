"""Non-finite numbers to NULL, anywhere in a nested schema, with a count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.columns import is_floating, ref


def _bad(value: Column) -> Column:
    return F.isnan(value) | (F.abs(value) == F.lit(float("inf")))


def _clean(value: Column, dtype: T.DataType) -> Column:
    if is_floating(dtype):
        return F.when(_bad(value), F.lit(None)).otherwise(value)
    if isinstance(dtype, T.StructType) and _has_float(dtype):
        fields = [_clean(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType) and _has_float(dtype):
        return F.transform(value, lambda x: _clean(x, dtype.elementType))
    if isinstance(dtype, T.MapType) and _has_float(dtype):
        return F.transform_values(value, lambda _, v: _clean(v, dtype.valueType))
    return value


def _count(value: Column, dtype: T.DataType) -> Column:
    zero = F.lit(0).cast("bigint")
    if is_floating(dtype):
        return F.when(_bad(value), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    if isinstance(dtype, T.StructType):
        parts = [_count(value[f.name], f.dataType) for f in dtype.fields if _has_float(f.dataType)]
        return reduce(lambda a, b: a + b, parts, zero)
    if isinstance(dtype, (T.ArrayType, T.MapType)) and _has_float(dtype):
        items = F.map_values(value) if isinstance(dtype, T.MapType) else value
        inner = dtype.valueType if isinstance(dtype, T.MapType) else dtype.elementType
        total = F.aggregate(items, zero, lambda acc, x: acc + _count(x, inner))
        return F.coalesce(total, zero)
    return zero


def _has_float(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_float(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_float(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_float(dtype.valueType)
    return is_floating(dtype)


def nonfinite_to_null(df: DataFrame, count_column: str | None = None) -> DataFrame:
    """Replace NaN and infinities by NULL; optionally add the replacements per row."""
    shown = [_clean(ref(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    if count_column:
        parts = [_count(ref(f.name), f.dataType) for f in df.schema.fields if _has_float(f.dataType)]
        total = reduce(lambda a, b: a + b, parts, F.lit(0).cast("bigint"))
        shown.append(total.alias(count_column))
    return df.select(*shown)
