"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Largest row count we hand to ``broadcast()`` on the strength of a parameter
# (vocabulary cap, top-n, number of classes).  Sides without such a bound are
# left to the planner and AQE, which measure them at run time.
MAX_BROADCAST_ROWS = 2_000_000


def bounded_broadcast(df: DataFrame, bound: int) -> DataFrame:
    """Broadcast ``df`` whose row count is bounded by ``bound`` (a parameter such as
    a vocabulary cap or a top-n); above ``MAX_BROADCAST_ROWS`` leave the join
    strategy to the planner."""
    return F.broadcast(df) if bound <= MAX_BROADCAST_ROWS else df


def scalars(agg: DataFrame) -> Column:
    """A global aggregate (exactly one row) as a struct-valued scalar subquery.

    Spark runs the subquery once, ahead of the main query, and folds the value
    into the projection as a literal: no join, no cross product, and the
    consuming stage keeps its whole-stage codegen.  Read fields with
    ``s["name"]``."""
    return agg.select(F.struct(*agg.columns).alias("__s")).scalar()


def split_col(key: str = "key", modulus: int = 5) -> "F.Column":
    """The fixture split rule: ``valid`` when ``key % 5 = 0``, else ``train``."""
    return F.when(F.col(key) % modulus == 0, F.lit("valid")).otherwise(F.lit("train"))
