"""Masking of secret-looking columns and map keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab


def is_secret(name: str) -> bool:
    low = name.lower()
    if low.endswith("_env"):
        return False
    return low in vocab.SECRET_KEYS or low.endswith(vocab.SECRET_SUFFIXES)


def _is_secret_key(key: Column) -> Column:
    low = F.lower(key)
    test = low.isin(*vocab.SECRET_KEYS)
    for suffix in vocab.SECRET_SUFFIXES:
        test = test | low.endswith(suffix)
    return test & ~low.endswith("_env")


def _masked(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.when(col.isNotNull() & (col != ""), F.lit("***")).otherwise(col)
    # a non-string secret has no room for the mask: it is cleared instead
    return F.lit(None).cast(kind)


def _walk(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.when(
            col.isNotNull(),
            F.struct(
                *[
                    (_masked(col[f.name], f.dataType) if is_secret(f.name) else _walk(col[f.name], f.dataType)).alias(
                        f.name
                    )
                    for f in kind.fields
                ]
            ),
        )
    if isinstance(kind, T.ArrayType) and _nested(kind.elementType):
        return F.transform(col, lambda x: _walk(x, kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return F.transform_values(
            col,
            lambda k, v: F.when(_is_secret_key(k), _masked(v, kind.valueType)).otherwise(_walk(v, kind.valueType)),
        )
    return col


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.ArrayType, T.MapType))


def redact(df: DataFrame) -> DataFrame:
    """Mask secrets at every depth; the walk is over the schema, not the rows."""
    return df.select(
        *[
            (_masked(F.col(f"`{f.name}`"), f.dataType) if is_secret(f.name) else _walk(F.col(f"`{f.name}`"), f.dataType)).alias(
                f.name
            )
            for f in df.schema.fields
        ]
    )
