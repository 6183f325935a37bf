"""Join helpers (JON-1..3).

The reference never joins on keys; its membership tests become semi/anti joins
and its dictionaries become lookup joins.  ``hot_key_join`` handles a join key
that may hold a third of all rows (a frequent token): its hot keys are joined
by a bounded broadcast, the rest by an ordinary shuffle join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, UserDefinedType

from .common import bounded_broadcast


def semi(df: DataFrame, keys: DataFrame, on: Sequence[str], bound: int | None = None) -> DataFrame:
    """JON-1 / FIL-4: rows of ``df`` whose ``on`` values occur in ``keys``; ``keys`` is
    broadcast when a parameter bounds its size (e.g. top-n x classes)."""
    k = bounded_broadcast(keys.select(*on), bound) if bound is not None else keys.select(*on)
    return df.join(k, list(on), "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: Sequence[str], bound: int | None = None) -> DataFrame:
    """JON-2: rows of ``df`` whose ``on`` values do not occur in ``keys`` (a null key
    never matches, so null rows are kept, like pandas ``~isin``)."""
    k = bounded_broadcast(keys.select(*on), bound) if bound is not None else keys.select(*on)
    return df.join(k, list(on), "left_anti")


def lookup(df: DataFrame, mapping: DataFrame, left_on: str, right_on: str, bound: int | None = None,
           how: str = "left") -> DataFrame:
    """JON-3: dictionary lookup join (label <-> code, id <-> name)."""
    m = bounded_broadcast(mapping, bound) if bound is not None else mapping
    return df.join(m, df[left_on] == m[right_on], how).drop(m[right_on])


def hot_key_join(big: DataFrame, small: DataFrame, on: str, freq: str, hot_n: int = 10_000,
                 how: str = "inner", spread: int = 1024) -> DataFrame:
    """Equi-join on one key column where a few keys may hold a large share of
    ``big`` (a token such as "the" occurs in nearly every document).

    ``small`` has one row per key and a column ``freq`` counting (or
    approximating) that key's rows in ``big``; the choice of hot keys only
    affects balance, never the result.

    * The ``hot_n`` most frequent keys (``TakeOrdered`` over ``small``: at most
      ``hot_n`` rows, a proven broadcast bound) are joined map-side by a
      broadcast hash join, so their rows are never grouped by key.
    * Every other key holds at most ``1 / hot_n`` of ``big`` (each is rarer than
      all hot keys) and goes through an ordinary shuffle join, which AQE may
      still turn into a broadcast after measuring ``small``.
    * Rows already matched by the broadcast, and rows whose own key is NULL, enter the
      shuffle join with a NULL key, which matches nothing, and a hash spread column, so
      they are spread over ``spread`` buckets instead of collecting on the NULL key's partition.

    One pass over ``big``; output = ``big``'s columns + ``small``'s value columns."""
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    vals = [c for c in small.columns if c not in (on, freq)]
    hot = (small.orderBy(F.desc(freq), F.asc(on)).limit(hot_n)
           .select(on, *[F.col(c).alias(f"__h_{c}") for c in vals], F.lit(True).alias("__hot")))
    b = big.join(bounded_broadcast(hot, hot_n), on, "left")
    is_hot = F.col("__hot").isNotNull()
    spread = 1 << (int(spread) - 1).bit_length()
    # One struct key (key or NULL, spread bucket): the optimizer cannot fold the
    # cold side's constant bucket out of it, so the shuffle join partitions on
    # both parts and the matched rows stay spread.
    # Spread by a hash of the row's atomic columns (deterministic, so a
    # recomputed task routes its rows the same way; vectors and arrays skipped).
    atomic = [f.name for f in big.schema.fields
              if not isinstance(f.dataType, (ArrayType, MapType, StructType, UserDefinedType))] or big.columns
    b = b.select("*", F.struct(F.when(~is_hot, F.col(on)).alias("k"),
                               F.when(is_hot | F.col(on).isNull(), F.xxhash64(*atomic).bitwiseAND(F.lit(spread - 1)))
                               .otherwise(F.lit(0)).cast("int").alias("s")).alias("__k"))
    cold = small.filter(F.col(on).isNotNull()).select(F.struct(F.col(on).alias("k"), F.lit(0).alias("s")).alias("__k"),
                        *[F.col(c).alias(f"__c_{c}") for c in vals], F.lit(True).alias("__cold"))
    j = b.join(cold, "__k", "left")
    if how == "inner":
        j = j.filter(is_hot | F.col("__cold").isNotNull())
    return j.select(*big.columns, *[F.coalesce(F.col(f"__h_{c}"), F.col(f"__c_{c}")).alias(c) for c in vals])
