"""Sources and sinks: parquet tables, the CSV train/validation pair, saved
matrices, predictions and attributions; writers for the same."""

from .csv import (check_source, expand_confusion, read_attributions, read_confusion, read_csv,  # noqa: F401
                  read_pair, read_predictions)
from .sinks import write_confusion, write_predictions, write_report, write_table  # noqa: F401
from .tables import TABLES, table  # noqa: F401
