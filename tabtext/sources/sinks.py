"""Sinks (SNK-1..4).  All writes are Spark writes (parallel, one file per partition)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.evaluate import confusion_wide, metric_report


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> str:
    w = df.write.mode("overwrite")
    if fmt == "csv":
        # Whitespace is data: the CSV writer trims values unless told not to.
        (w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        w.format(fmt).save(path)
    return path


def write_predictions(pred: DataFrame, path: str, fmt: str = "csv",
                      rename: dict[str, str] | None = None, drop: Sequence[str] = ()) -> str:
    """SNK-1: predictions without an index column; ``rename`` maps the canonical
    names to a script's names (e.g. ``label -> actual_target``)."""
    out = pred.drop(*drop)
    for a, b in (rename or {}).items():
        out = out.withColumnRenamed(a, b)
    return write_table(out, path, fmt)


def write_confusion(pred: DataFrame, path: str) -> str:
    """SNK-2: the square matrix with the true label as first column (k rows)."""
    return write_table(confusion_wide(pred), path, "csv")


def write_report(pred: DataFrame, path: str, method: str = "proposed", fmt: str = "csv") -> str:
    """SNK-4: the long metric report."""
    return write_table(metric_report(pred, method), path, fmt)
