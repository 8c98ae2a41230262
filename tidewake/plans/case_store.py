"""A store of cases in which saving a case again replaces it.

A save writes its rows to a folder of their own and then one small entry in the store's log; readers take the folders that the log names, so
they see a save as a whole or not at all.  The last save of a case counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts that a save is dealt to by case, so that looking up one case reads one of them per save.
PARTS = 64
_KEY, _PART, _SAVE = "case_id", "__tw_part", "__tw_save"


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.Path


def _entries(spark: SparkSession, path: str) -> list[str]:
    """Names of log entries in order: number, kind and folder, as in 00000003-save-1f..; from the last ``base`` on."""
    fs, make = _fs(spark, path)
    log = make(f"{path}/log")
    names = sorted(s.getPath().getName() for s in fs.listStatus(log)) if fs.exists(log) else []
    names = [n for n in names if n.count("-") == 2]
    last = max((i for i, n in enumerate(names) if "-base-" in n), default=0)
    return names[last:]


def _commit(spark: SparkSession, path: str, kind: str, folder: str, after: int | None) -> None:
    """Adds a log entry; its number is held by a file that can be created once, so of two writers one comes later.  With ``after`` it must be the
    next number, or nothing is added."""
    fs, make = _fs(spark, path)
    for _ in range(1000):
        n = max((int(s.getPath().getName().split("-")[0]) for s in fs.listStatus(make(f"{path}/held"))), default=0) + 1 if fs.exists(make(f"{path}/held")) else 1
        if after is not None and n != after + 1:
            raise RuntimeError("the store was saved to meanwhile")
        try:
            if fs.createNewFile(make(f"{path}/held/{n:08}")):
                fs.create(make(f"{path}/log/{n:08}-{kind}-{folder}"), False).close()
                return
        except Exception as e:  # noqa: BLE001  another writer holds the number
            if "already exists" not in str(e):
                raise
    raise RuntimeError("no number in the log was free")


def _write(rows: DataFrame, path: str) -> str:
    folder = uuid.uuid4().hex
    rows.withColumn(_PART, F.pmod(F.xxhash64(_KEY), F.lit(PARTS))).repartition(_PART).write.partitionBy(_PART).parquet(f"{path}/data/{folder}")
    return folder


def save(cases: DataFrame, path: str, newest: Column | None = None) -> None:
    """Saves rows by ``case_id``: those that the store has are replaced.  Of rows of one case that come together, the greatest
    ``newest`` stays, by default any one."""
    rows = cases if newest is None else cases.withColumn("__tw_newest", newest)
    whole = F.struct(*cases.columns)
    one = rows.groupBy(_KEY).agg((F.any_value(whole) if newest is None else F.max_by(whole, F.col("__tw_newest"))).alias("r")).select("r.*")
    _commit(cases.sparkSession, path, "save", _write(one, path), None)


def cases(spark: SparkSession, path: str, case_id: str | None = None) -> DataFrame:
    """The last save of each case, or of one, of which only that part of each save is read.  Stores without saves have no rows and
    the column case_id alone."""
    names = _entries(spark, path)
    if not names:
        return spark.createDataFrame([], T.StructType([T.StructField(_KEY, T.StringType())]))
    every = None
    for name in names:
        number, _, folder = name.split("-")
        part = spark.read.parquet(f"{path}/data/{folder}").withColumn(_SAVE, F.lit(int(number)))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    if case_id is not None:
        every = every.where((F.col(_PART) == F.pmod(F.xxhash64(F.lit(case_id)), F.lit(PARTS))) & (F.col(_KEY) == case_id))
    columns = [c for c in every.columns if c not in (_PART, _SAVE)]
    return every.groupBy(_KEY).agg(F.max_by(F.struct(*columns), _SAVE).alias("r")).select("r.*")


def compact(spark: SparkSession, path: str) -> None:
    """Rewrites the last save of each case as one; later reads start from it.  Fails, and changes nothing, if a save came meanwhile."""
    names = _entries(spark, path)
    if len(names) > 1:
        _commit(spark, path, "base", _write(cases(spark, path), path), int(names[-1].split("-")[0]))
