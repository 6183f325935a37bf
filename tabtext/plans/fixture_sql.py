"""Fixtures over the driver's tables, in SQL (the oracle side).

Each name maps to a SELECT over the pre-registered views; ``with_fixtures``
prepends the ones a query needs as CTEs.  The Spark builders of the same
fixtures are in ``fixtures.py``; both follow ``FIXTURES.md``.
"""

from __future__ import annotations

from ..functions.text import WORD_PATTERN

SPLIT = "CASE WHEN {k} % 5 = 0 THEN 'valid' ELSE 'train' END"

FX = {
    "fx_text_class": f"""
        SELECT d.doc_id AS key, {SPLIT.format(k='d.doc_id')} AS split, d.text AS sentence,
               CAST(l.quality AS INTEGER) AS label, d.n_chars
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "fx_text_reg": f"""
        SELECT doc_id AS key, {SPLIT.format(k='doc_id')} AS split, text AS sentence,
               CAST(n_chars AS DOUBLE) AS label, lang
        FROM documents""",
    "fx_num_class": f"""
        SELECT p_partkey AS key, {SPLIT.format(k='p_partkey')} AS split,
               CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS target,
               p_size, p_retailprice, p_type
        FROM part""",
    "fx_cat": f"""
        SELECT o_orderkey AS key, {SPLIT.format(k='o_orderkey')} AS split,
               CAST(o_totalprice >= 100000 AS INTEGER) AS target,
               o_orderstatus, o_orderpriority, CAST(month(o_orderdate) AS INTEGER) AS o_month
        FROM orders""",
    "fx_num_reg": f"""
        SELECT o.o_orderkey AS key, {SPLIT.format(k='o.o_orderkey')} AS split,
               o.o_totalprice AS target, c.c_acctbal,
               CAST(date_diff('day', DATE '1995-01-01', CAST(o.o_orderdate AS DATE)) AS DOUBLE) AS days
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "fx_logits": """
        SELECT vec_id AS key, list_transform(range(10), lambda c: list_reduce(
                 list_filter(CAST(embedding AS DOUBLE[]), lambda x, i: (i - 1) % 10 = c), lambda a, x: a + x)) AS logits,
               CAST(label AS INTEGER) AS label
        FROM embeddings""",
    "fx_pred_bin": """
        SELECT key, label, CAST(n_chars >= 1000 AS INTEGER) AS predicted_label FROM fx_text_class""",
    "fx_pred_multi": """
        SELECT key, label, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS predicted_label
        FROM fx_logits""",
    "fx_pred_zero": """
        SELECT key, label,
               CAST((list_position(logits, list_max(logits)) - 1) % 3 AS INTEGER) AS predicted_label
        FROM fx_logits""",
    "fx_pred_reg": f"""
        SELECT o.o_orderkey AS key, o.o_totalprice AS label, m.predicted_label
        FROM orders o JOIN (
            SELECT o_orderpriority, avg(o_totalprice) AS predicted_label FROM orders
            WHERE {SPLIT.format(k='o_orderkey')} = 'train' GROUP BY o_orderpriority) m
          ON o.o_orderpriority = m.o_orderpriority
        WHERE {SPLIT.format(k='o.o_orderkey')} = 'valid'""",
    "fx_doc_tokens": f"""
        SELECT key, split, label, unnest(regexp_extract_all(lower(sentence), '{WORD_PATTERN}')) AS token
        FROM fx_text_class""",
    "fx_token_weights": """
        SELECT token, ln((sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) + 1.0)
                       / (sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) + 1.0)) AS w
        FROM fx_doc_tokens WHERE split = 'train' GROUP BY token""",
    "fx_attr": """
        SELECT t.key AS sample, t.token, c.class,
               CASE WHEN c.class = 1 THEN 1 ELSE -1 END * COALESCE(w.w, 0.0) * t.tf AS shap_value
        FROM (SELECT key, token, count(*) AS tf FROM fx_doc_tokens GROUP BY key, token) t
        LEFT JOIN fx_token_weights w ON t.token = w.token
        CROSS JOIN (SELECT 0 AS class UNION ALL SELECT 1) c""",
}

# Which fixtures each fixture depends on (for CTE ordering).
DEPS = {
    "fx_pred_bin": ["fx_text_class"],
    "fx_pred_multi": ["fx_logits"],
    "fx_pred_zero": ["fx_logits"],
    "fx_doc_tokens": ["fx_text_class"],
    "fx_token_weights": ["fx_doc_tokens"],
    "fx_attr": ["fx_doc_tokens", "fx_token_weights"],
}


def _closure(names):
    out = []
    def visit(n):
        for d in DEPS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)
    for n in names:
        visit(n)
    return out


def with_fixtures(sql: str, *names: str) -> str:
    """``WITH fx AS (...), ... <sql>`` for the named fixtures and their inputs."""
    order = _closure(names)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({FX[n]})" for n in order)
    return f"WITH {ctes}\n{sql}"
