"""FEA-4 as one sparse vector: equal to the wide form, any number of levels, hot and null levels."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import SF001
from tabtext.operators import features as FE
from tabtext.plans import fixtures as X
from tabtext.plans import jobs as J

CATS = ["o_orderstatus", "o_orderpriority", "o_month"]


@pytest.mark.parametrize("drop_first", [True, False])
@pytest.mark.parametrize("bound", [FE.MAX_LEVELS, 1])
def test_sparse_equals_wide(spark, drop_first, bound):
    df = spark.createDataFrame([(1, "b", 10, 0.5), (2, "a", 2, 1.5), (3, None, None, 2.0), (4, "c", 10, -1.0), (4, "c", 10, -1.0),
                                (None, "é", 7, 0.0)], "key long, c string, m int, x double")
    wide = FE.dummies(df, ["c", "m"], drop_first)
    names = [c for c in wide.columns if c not in ("key", "x")]
    rows, layout = FE.sparse_dummies(df, ["c", "m"], drop_first, numeric=["x"], broadcast_levels=bound)
    got = rows.collect()
    assert sorted(str((r["key"], [float(v) for v in r["features"].toArray()])) for r in got) == sorted(
        str((k, list(v))) for k, v in wide.select("key", F.array("x", *[F.col(f"`{n}`").cast("double") for n in names])).collect())
    assert len(got) == 6 and rows.columns == ["key", "x", "active", "features"]
    skip = int(drop_first)
    assert layout == {"c": (1, 4 - skip), "m": (1 + 4 - skip, 3 - skip)}
    for r in got:  # the positions are the vector's ones
        ones = [i for i, v in enumerate(r["features"].toArray()) if i and v == 1.0]
        assert r["active"] == ones


def test_one_level_and_none(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None)], "key long, c string, d string")
    with pytest.raises(ValueError):
        FE.sparse_dummies(df, ["c", "d"])
    rows, layout = FE.sparse_dummies(df, ["c", "d"], drop_first=False)
    assert layout == {"c": (0, 1), "d": (1, 0)} and [r["active"] for r in rows.collect()] == [[0], [0]]


def test_many_levels_with_a_hot_and_a_null_level(spark):
    """100,000 levels; a level and null hold a third of the rows each."""
    df = spark.range(450_000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None).otherwise(
        F.format_string("v%06d", F.col("id") % 100_000)).alias("c"))
    n = df.filter("c is not null").select("c").distinct().count()
    assert n > 90_000
    rows, layout = FE.sparse_dummies(df, ["c"])
    assert layout == {"c": (0, n - 1)}
    f = rows.agg(F.count(F.lit(1)), F.count(F.when(F.size("active") == 0, 1)), F.countDistinct("active"), F.max(F.get("active", F.lit(0)))).first()
    assert tuple(f) == (450_000, 300_000, n, n - 2)  # "hot" sorts first and is dropped
    v = rows.filter("id = 2").first()["features"]
    assert (v.size, len(v.indices), v.indices.tolist()) == (n - 1, 1, rows.filter("id = 2").first()["active"])


def test_classifier_equals_the_wide_one(spark):
    df = X.fx_cat(spark, SF001)
    wide = J.run_numeric_classifier(FE.dummies(df, CATS), profile="fast").select("key", "label", "predicted_label").collect()
    sparse = J.run_sparse_dummies(df, CATS, profile="fast").collect()
    a, b = ({r["key"]: (r["label"], r["predicted_label"]) for r in x} for x in (wide, sparse))
    assert a.keys() == b.keys() and [a[k][0] for k in sorted(a)] == [b[k][0] for k in sorted(b)]
    same = sum(a[k][1] == b[k][1] for k in a)
    assert same == len(a), (same, len(a))


def test_null_keys_do_not_meet_in_one_task(spark):
    from tabtext.operators.joins import hot_key_join
    big = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("t"), F.col("id") % 500)).alias("k"))
    small = big.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.length("k"))
    small = small.unionByName(spark.createDataFrame([(None, 1, 9)], "k string, n long, w int"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {c: spark.conf.get(c, None) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        j = hot_key_join(big, small, "k", "n", hot_n=3, how="left")
        assert j.count() == 20_000 and j.filter("k is null and w is not null").count() == 0
        sizes = [r["n"] for r in j.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert max(sizes) < 2 * sum(sizes) / len(sizes), sizes
    finally:
        for c, v in old.items():
            spark.conf.set(c, v) if v is not None else spark.conf.unset(c)
