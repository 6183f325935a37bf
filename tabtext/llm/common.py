"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Words are maximal runs of characters other than the space and the five ASCII controls tab to return.
WORD = r"[^\x20\x09-\x0D]+"

#: A key with at least 1 / HOT_SHARE of all rows is hot; there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts the lineage, so a
    lost executor costs a re-read and not a recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application (``addPyFile``), so that tasks can import it wherever
    the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="py-files-"), f"{os.path.basename(root)}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


#: Rows of an Arrow batch.  Rows carry whole texts: Spark's default of 10,000 would hold tens of MB several times over.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_tasks(df: DataFrame, task: Callable, schema) -> DataFrame:
    """``df.mapInArrow(task, schema)`` with this package at hand in the tasks, in batches of ``BATCH_ROWS`` rows (or
    fewer, where the session says so: the setting is the session's, and is lowered here)."""
    spark = df.sparkSession
    ship_package(spark)
    rows = int(spark.conf.get(_BATCH))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return df.mapInArrow(task, schema)


def lower_ascii(col):
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def attach(rows: DataFrame, groups: DataFrame, key: str, freq: str, total: int, how: str = "left") -> DataFrame:
    """Equi-join of ``rows`` with ``groups`` (one row per key, ``freq`` = its rows), safe for hot keys.

    Keys that hold at least 1 / HOT_SHARE of ``total`` rows are at most HOT_SHARE rows of
    ``groups`` (a proven bound): they are broadcast and their rows never meet in one
    task.  Every other key holds fewer rows than that and is joined by a shuffle.  A null key
    matches nothing, and its rows are spread by a hash of the row.  ``groups`` should be a written table, as it is read twice."""
    cut = F.lit(HOT_SHARE) * F.col(freq) >= F.lit(total)
    values = [c for c in groups.columns if c != key]
    hot = groups.filter(cut)
    cold = groups.filter(~cut)
    marked = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), key, "left")
    done = marked.filter("__hot").drop("__hot")
    plain = [c for c, t in rows.dtypes if "map<" not in t and "variant" not in t]
    spread = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(HOT_SHARE))).otherwise(F.lit(0))
    rest = marked.filter("__hot is null").drop("__hot", *values).withColumn("__spread", spread.cast("int"))
    zero = F.pmod(F.col(freq), F.lit(1)).cast("int")  # as a literal, the optimizer would take it out of the join's keys
    rest = rest.join(cold.withColumn("__spread", zero), [key, "__spread"], how).drop("__spread")
    return done.unionByName(rest)


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named ``__c0, __c1, ...``, and their names by column: no helper column of an
    operator can clash with one of the caller's."""
    names = [f"__c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


def own_names(df: DataFrame, at: dict[str, str]) -> DataFrame:
    """The caller's columns under their own names."""
    return df.select(*[F.col(n).alias(c) for c, n in at.items()])
