"""MOD-18 on a stream: fitted model + argmax + label decode, stateless."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import argmax
from ..operators.models import class_scores


def score_stream(model, stream: DataFrame, mapping_rows: list[tuple], key: str = "key") -> DataFrame:
    """Score a streaming DataFrame with a fitted classifier pipeline.  The code ->
    label mapping is passed as its (small, one row per class) rows and applied
    with a literal map, so the stream needs no join with a static table."""
    scored = model.transform(stream)
    code = argmax(class_scores(scored))
    pairs = []
    for value, c in mapping_rows:
        pairs += [F.lit(int(c)), F.lit(value)]
    decoded = F.element_at(F.create_map(*pairs), code) if pairs else code
    return scored.select(key, code.alias("predicted_code"), decoded.alias("predicted_label"))
