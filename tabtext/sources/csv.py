"""CSV sources (SRC-1..5).

The reference reads two CSV files (train, validation) with pandas.  Here:
header, line ends inside quotes and doubled-quote escaping, all
columns first as strings; the pandas missing-value tokens become NULL; then
types are inferred in one aggregate pass (integer, double, boolean, string;
an integer column holding a NULL becomes double, as in pandas) or taken from a
given schema.  Files whose values hold line ends are split, too (``csv_split``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Strings pandas reads as missing by default.
NA_VALUES = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
INT_RE = r"^\s*[+-]?[0-9]+\s*$"
#: How every text begins that casts to a double (others may, too): the cast of a text that is no number throws and catches.
NUMBER_RE = r"^[\x00-\x20]*[0-9+\-.iInN]"
BOOL_VALUES = ("True", "False", "true", "false", "TRUE", "FALSE")


def _raw(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``multi_line``: values may hold line ends; records are then found over split ranges (``csv_split``)."""
    if multi_line:
        from .csv_split import read_numbered
        return read_numbered(spark, path, "__number").drop("__number")
    return _plain(spark, path, False)


def _plain(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Spark's own reader; with ``multi_line`` a file is one task."""
    return (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
            .option("mode", "FAILFAST").csv(path))


def infer_types(df: DataFrame) -> DataFrame:
    """Cast string columns to the narrowest of bigint / double / boolean / string
    that holds every non-null value (one aggregate job)."""
    checks = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        checks += [F.count(col).alias(f"{c}__n"),
                   F.count(F.when(col.rlike(INT_RE), 1)).alias(f"{c}__i"),
                   F.count(F.when(col.rlike(NUMBER_RE), col.try_cast("double"))).alias(f"{c}__d"),
                   F.count(F.when(col.isin(list(BOOL_VALUES)), 1)).alias(f"{c}__b"),
                   (F.count(F.lit(1)) - F.count(col)).alias(f"{c}__null")]
    r = df.agg(*checks).first()
    out = []
    for c in df.columns:
        n, i, d, b, nul = (r[f"{c}__n"], r[f"{c}__i"], r[f"{c}__d"], r[f"{c}__b"], r[f"{c}__null"])
        col = F.col(f"`{c}`")
        if n > 0 and i == n:
            out.append((F.trim(col).cast("bigint") if nul == 0 else F.trim(col).cast("double")).alias(c))
        elif n > 0 and d == n:
            out.append(col.cast("double").alias(c))
        elif n > 0 and b == n:
            out.append(F.lower(col).cast("boolean").alias(c))
        else:
            out.append(col.alias(c))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None,
             na_values=NA_VALUES, multi_line: bool = True) -> DataFrame:
    """One CSV file (or folder) as a typed DataFrame."""
    nulled = _nulled(_raw(spark, path, multi_line), na_values)
    if schema is not None:
        return nulled.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
    return infer_types(nulled)


def _nulled(raw: DataFrame, na_values=NA_VALUES) -> DataFrame:
    return raw.select(*[F.when(F.col(f"`{c}`").isin(list(na_values)), F.lit(None))
                        .otherwise(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def read_pair(spark: SparkSession, train: str, valid: str, schema: StructType | None = None,
              key: str = "key") -> DataFrame:
    """SRC-1: train and validation files as one DataFrame tagged by ``split``, with
    a ``key`` (``2 * number in file order + split``: unique over both files and
    a position, the same at every split size).  Types are
    inferred over both files together so the two sides agree."""
    def tagged(path, tag, bit):
        from .csv_split import read_numbered
        raw = read_numbered(spark, path, "__number")
        return raw.select((F.col("__number") * 2 + bit).alias(key), F.lit(tag).alias("split"),
                          *[F.col(f"`{c}`") for c in raw.columns if c != "__number"])
    both = tagged(train, "train", 0).unionByName(tagged(valid, "valid", 1), allowMissingColumns=True)
    cols = [c for c in both.columns if c not in (key, "split")]
    nulled = both.select(key, "split", *[F.when(F.col(f"`{c}`").isin(list(NA_VALUES)), F.lit(None))
                                         .otherwise(F.col(f"`{c}`")).alias(c) for c in cols])
    if schema is not None:
        return nulled.select(key, "split", *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name)
                                            for f in schema.fields])
    typed = infer_types(nulled.select(*cols))
    types = {f.name: f.dataType for f in typed.schema.fields}
    out = nulled.select(key, "split", *[(F.trim(F.col(f"`{c}`")) if types[c].typeName() in ("long", "double")
                                         else F.col(f"`{c}`")).alias(c) for c in cols])
    return out.select(key, "split", *[(F.lower(F.col(f"`{c}`")) if types[c].typeName() == "boolean"
                                       else F.col(f"`{c}`")).cast(types[c]).alias(c) for c in cols])


def read_confusion(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2: a saved square matrix (first column = true label, header = predicted
    labels) as the long ``(label, predicted_label, n)``; labels stay strings."""
    raw = _raw(spark, path, multi_line=False)
    first, rest = raw.columns[0], raw.columns[1:]
    long = raw.unpivot([F.col(f"`{first}`").alias("label")], [F.col(f"`{c}`").alias(c) for c in rest],
                       "predicted_label", "n")
    return long.select("label", "predicted_label", F.col("n").cast("bigint").alias("n"))


def expand_confusion(cells: DataFrame) -> DataFrame:
    """Golden matrices back to prediction rows (FX-GOLDEN): each cell repeated
    ``n`` times, distributed by ``explode(sequence)`` (no driver loop)."""
    pos = cells.filter(F.col("n") > 0)
    return pos.select("label", "predicted_label", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_i")).drop("_i")


def read_predictions(spark: SparkSession, path: str, schema: StructType | None = None,
                     multi_line: bool = True) -> DataFrame:
    """SRC-3.  Predictions over numbers need no ``multi_line``; those that carry a sentence may."""
    return read_csv(spark, path, schema, multi_line=multi_line)


ATTRIBUTION_SCHEMA = "sample bigint, token string, class string, shap_value double"


def read_attributions(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """SRC-4: a long attribution table.  ``fmt`` is ``parquet`` or ``csv``; without it the name decides
    (``.csv``, else parquet), and a damaged file is an error."""
    if (fmt or ("csv" if path.endswith(".csv") else "parquet")) == "parquet":
        return spark.read.parquet(path)
    df = _nulled(_raw(spark, path, multi_line=False))
    # Only the class has a type of the file's own: the pass that infers it reads no other column.
    kind = infer_types(df.select("class")).schema["class"].dataType
    value = F.trim("class") if kind.typeName() in ("long", "double") else F.lower("class") if kind.typeName() == "boolean" else F.col("class")
    whole = F.coalesce(F.trim("sample").try_cast("bigint"), F.col("sample").cast("double").cast("bigint"))
    return df.select(whole.alias("sample"), "token", value.cast(kind).alias("class"), F.col("shap_value").cast("double").alias("shap_value"))


def check_source(spark: SparkSession, path: str, column: str | None = None) -> tuple[bool, str]:
    """SRC-5: a missing or unreadable file is reported, not raised: reads the
    header and one row (``FAILFAST``), then checks ``column`` if given."""
    try:
        df = _plain(spark, path)
        df.limit(1).collect()
    except Exception as e:  # noqa: BLE001 - the point is to report any failure
        msg = str(e).split("\n")[0]
        kind = "missing" if ("PATH_NOT_FOUND" in msg or "does not exist" in msg) else "unreadable"
        return False, f"{kind}: {msg[:300]}"
    if column is not None and column not in df.columns:
        return False, f"no column {column!r}"
    return True, "ok"
