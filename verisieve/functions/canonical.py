"""Canonical JSON and fingerprints."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of canonical text that one list fingerprint may take.
LIST_BYTES = 512 * 1024 * 1024


def canonical(payload: object) -> str:
    """Keys sorted, no spaces, characters as they are."""
    return json.dumps(payload, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def fingerprint(payload: object) -> str:
    return "sha256:" + hashlib.sha256(canonical(payload).encode()).hexdigest()


def _sorted(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        # A null struct stays null instead of becoming one of nulls.
        return F.when(c.isNotNull(), F.struct(*(_sorted(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name))))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _sorted(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(c)))
    return c


def _exact(kind: T.DataType) -> bool:
    """Types that Spark writes as Python does."""
    if isinstance(kind, T.StructType):
        return all(_exact(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _exact(kind.elementType)
    if isinstance(kind, T.MapType):
        return isinstance(kind.keyType, T.StringType) and _exact(kind.valueType)
    return isinstance(kind, (T.StringType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.BooleanType))


def canonical_column(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Canonical JSON of a row's columns; nulls are written.

    Text, integers, booleans and nests of these stay in the JVM; other types
    (floating point among them) go through Python for the same bytes.
    """
    fields = sorted((f for f in df.schema.fields if columns is None or f.name in columns), key=lambda f: f.name)
    row = F.struct(*(_sorted(F.col(f.name), f.dataType).alias(f.name) for f in fields))
    if all(_exact(f.dataType) for f in fields):
        return F.to_json(row, {"ignoreNullFields": "false"})

    @F.arrow_udf("string")
    def dump(rows: pa.Array) -> pa.Array:
        return pa.array([canonical(x) for x in rows.to_pylist()], pa.string())

    return dump(row)


def row_fingerprints(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of a row's canonical JSON."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_column(df, columns), 256))


def list_fingerprint(df: DataFrame, order: str, columns: list[str] | None = None) -> DataFrame:
    """fingerprint: of the list of all rows in order, for frozen sets.

    The hash of a list needs it in one piece; beyond LIST_BYTES use
    ``tree_fingerprint``. An empty table has the fingerprint of ``[]``.
    """
    rows = df.select(F.col(order).alias("o"), canonical_column(df, columns).alias("j"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("j") + 1), F.lit(0))).first()[0]
    if size > LIST_BYTES:
        raise ValueError(f"{size} bytes are too many for one list; use tree_fingerprint")
    whole = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "j"))), lambda x: x["j"]), ","), F.lit("]"))
    return rows.agg(F.concat(F.lit("sha256:"), F.sha2(whole, 256)).alias("fingerprint"))


def tree_fingerprint(df: DataFrame, key: str, columns: list[str] | None = None, fan: int = 4096, depth: int = 4) -> DataFrame:
    """fingerprint: hash of hashes over blocks of ``fan`` successive keys, ``depth`` levels up; no group is larger than ``fan``.

    key: a unique whole number. Equal tables have equal fingerprints whatever their partitions.
    """
    level = df.select(F.col(key).alias("k"), F.sha2(canonical_column(df, columns), 256).alias("h"))
    for _ in range(depth):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), ",")
        level = level.groupBy(F.floor(F.col("k") / fan).alias("k2")).agg(F.sha2(joined, 256).alias("h")).withColumnRenamed("k2", "k")
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), ",")
    return level.agg(F.concat(F.lit("sha256-tree:"), F.sha2(top, 256)).alias("fingerprint"))
