"""Stream scoring with a fitted model; leave-one-out attributions on an
additive scorer."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from tabtext.operators.attributions import occlusion_attributions
from tabtext.plans import fixtures as X
from tabtext.plans import jobs as J
from tabtext.streaming import score_stream


def test_score_stream_matches_batch(spark):
    df = X.fx_num_class(spark, SF001).drop("p_type")
    batch, model, mapping = J.run_numeric_classifier(df, algo="rf", return_model=True, profile="fast")
    va = df.filter("split = 'valid'").drop("target")
    folder = os.path.join(tempfile.mkdtemp(prefix="tabtext-stream-"), "in")
    va.write.parquet(folder)
    stream = spark.readStream.schema(va.schema).parquet(folder)
    rows = [(r["value"], r["code"]) for r in mapping.collect()]
    q = (score_stream(model, stream, rows).writeStream.format("memory").queryName("scored_stream")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {r["key"]: r["predicted_label"] for r in spark.table("scored_stream").collect()}
    want = {r["key"]: r["predicted_label"] for r in batch.collect()}
    assert got == want


def test_occlusion_on_additive_scorer(spark):
    df = spark.createDataFrame([(1, "aa bb cc"), (2, "dd")], "key int, sentence string")

    def scorer(d):
        n = F.size(F.split(F.col("sentence"), " ")).cast("double")
        n = F.when(F.col("sentence") == "", F.lit(0.0)).otherwise(n)
        return d.withColumn("scores", F.array(-n, n))
    a = occlusion_attributions(df, scorer, classes=[0, 1])
    rows = a.collect()
    assert len(rows) == 2 * 4
    assert all(r["shap_value"] == pytest.approx(1.0 if r["class"] == 1 else -1.0) for r in rows)
