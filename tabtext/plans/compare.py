"""Run a registered query and its oracle SQL side by side (test and dev helper).

Compares row count, column names and the multiset of rows (columns sorted by
name, values normalised: ints as ints, floats as floats, arrays as tuples).
"""

from __future__ import annotations

import math
import re

from ..sources.tables import TABLES


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return float(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, int):
        return int(v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


SPARK_TYPES = {"int": "int32", "bigint": "int64", "double": "float64", "string": "string", "boolean": "bool",
               "smallint": "int16", "tinyint": "int8", "float": "float32", "date": "date"}
DUCK_TYPES = {"INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "float64", "VARCHAR": "string",
              "BOOLEAN": "bool", "SMALLINT": "int16", "TINYINT": "int8", "FLOAT": "float32", "DATE": "date"}


def _spark_type(t: str) -> str:
    if t.startswith("array<"):
        return "list<" + _spark_type(t[6:-1]) + ">"
    return SPARK_TYPES.get(t, t)


def _duck_type(t: str) -> str:
    t = str(t)
    if t.endswith("[]"):
        return "list<" + _duck_type(t[:-2]) + ">"
    return DUCK_TYPES.get(t, t)


# Join operators a plan of this package must not contain (a cross product).
NESTED_LOOP = re.compile(r"NestedLoopJoin|CartesianProduct")


def compare(spark, sf_dir: str, name: str, con=None) -> dict:
    from .oracle import SQL
    from .queries import QUERIES
    df = QUERIES[name](spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    plan = df._jdf.queryExecution().executedPlan().toString()
    con = con or duck(sf_dir)
    # A view first, as some engines' checks store each oracle: what cannot be a view is no oracle.
    con.execute(f"CREATE OR REPLACE TEMP VIEW __oracle AS {SQL[name]}")
    res = con.execute("SELECT * FROM __oracle")
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    s_types = {c: _spark_type(t) for c, t in df.dtypes}
    d_types = {c[0]: _duck_type(c[1]) for c in res.description}
    out = {"name": name, "rows_spark": len(a), "rows_oracle": len(b),
           "cols_match": sorted(s_cols) == sorted(d_cols), "values_match": a == b,
           "types_match": s_types == d_types,
           "nested_loop_join": bool(NESTED_LOOP.search(plan))}
    if not out["types_match"]:
        out["types"] = {c: (s_types.get(c), d_types.get(c)) for c in set(s_types) | set(d_types)
                        if s_types.get(c) != d_types.get(c)}
    if not out["values_match"]:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        out["first_diffs"] = diff
        out["cols"] = (sorted(s_cols), sorted(d_cols))
    return out
