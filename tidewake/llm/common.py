"""Helpers shared by the corpus operators: text columns, folds, and skew-proof joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Prefix of every helper column that is added to a caller's table, so that it can't clash with theirs.
OWN = "__tw_"

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key's decimal text, modulo ``folds``; NULL for a NULL key."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def salted_left_join(left: DataFrame, right: DataFrame, keys: list[str], salt_by: Column, salts: int = 16) -> DataFrame:
    """``left`` LEFT JOIN ``right`` (unique in ``keys``), with every key dealt to ``salts`` tasks.

    The right side is repeated ``salts`` times, so it should have few columns; it is not broadcast by us, though
    Spark may do so by its own size check.
    """
    salt = OWN + "salt"
    spread = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn(salt, F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")).join(spread, [*keys, salt], "left").drop(salt)


def quoted(name: str) -> str:
    """A column's name for F.col, whatever characters it has."""
    return f"`{name.replace('`', '``')}`"


def mapped(docs: DataFrame, batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], more: Sequence[StructField] = ()) -> DataFrame:
    """``docs.mapInArrow`` to the same columns and ``more``; Spark's own can't resolve names with dots, so columns are numbered meanwhile."""
    fields = docs.schema.fields
    schema = StructType([*(StructField(f"c{i}", f.dataType, True) for i, f in enumerate(fields)), *more])
    return docs.toDF(*[f"c{i}" for i in range(len(fields))]).mapInArrow(batches, schema).toDF(*[f.name for f in fields], *[f.name for f in more])
