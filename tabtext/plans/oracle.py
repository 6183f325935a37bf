"""DuckDB oracle SQL for the registered queries (same names as ``queries.py``).

Written independently of the Spark code: plain SQL over the pre-registered
views, with the fixtures of ``fixture_sql.py`` as CTEs.  Doubles are rounded
with the same places as the Spark side.
"""

from __future__ import annotations

from ..functions.text import WORD_PATTERN, stop_words_sql
from ..sources.csv import NA_VALUES
from .fixture_sql import with_fixtures as W

SQL: dict[str, str] = {}

TOK = "regexp_extract_all(lower(@X@), '" + WORD_PATTERN + "')"
STOP = stop_words_sql()


def tok(x: str) -> str:
    return TOK.replace("@X@", x)


def kept(x: str) -> str:
    return f"list_filter({tok(x)}, lambda t: NOT list_contains({STOP}, t) AND length(t) >= 2)"


def per_label(src: str, by: str = "") -> str:
    """CTE body: per-label tp/support/n_pred/precision/recall/f1 over the union of labels."""
    b = f"{by}, " if by else ""
    on = f"t.{by} = p.{by} AND " if by else ""
    cb = f"COALESCE(t.{by}, p.{by}) AS {by}, " if by else ""
    return f"""
      SELECT {b}label, tp, support, n_pred, precision, recall,
             CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
      FROM (
        SELECT {b}label, tp, support, n_pred,
               CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
               CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall
        FROM (
          SELECT {cb}COALESCE(t.label, p.label) AS label, CAST(COALESCE(t.tp, 0) AS BIGINT) AS tp,
                 CAST(COALESCE(t.support, 0) AS BIGINT) AS support, CAST(COALESCE(p.n_pred, 0) AS BIGINT) AS n_pred
          FROM (SELECT {b}label, count(*) AS support,
                       sum(CASE WHEN label = predicted_label THEN 1 ELSE 0 END) AS tp
                FROM {src} WHERE label IS NOT NULL AND predicted_label IS NOT NULL GROUP BY ALL) t
          FULL OUTER JOIN (SELECT {b}predicted_label AS label, count(*) AS n_pred
                FROM {src} WHERE label IS NOT NULL AND predicted_label IS NOT NULL GROUP BY ALL) p
            ON {on}t.label = p.label))"""


def summary_cols(by: str = "") -> str:
    b = f"{by}, " if by else ""
    return f"""{b}round(sum(tp) / sum(support), 9) AS accuracy, round(avg(precision), 9) AS macro_precision,
        round(avg(recall), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1,
        round(sum(precision * support) / sum(support), 9) AS weighted_precision,
        round(sum(recall * support) / sum(support), 9) AS weighted_recall,
        round(sum(f1 * support) / sum(support), 9) AS weighted_f1,
        count(*) AS n_labels, CAST(sum(support) AS BIGINT) AS n_rows"""


def confusion(src: str) -> str:
    return f"""
      WITH src AS (SELECT label, predicted_label FROM {src} WHERE label IS NOT NULL AND predicted_label IS NOT NULL),
           u AS (SELECT label FROM src UNION SELECT predicted_label FROM src),
           c AS (SELECT label, predicted_label, count(*) AS n FROM src GROUP BY ALL)
      SELECT a.label, b.label AS predicted_label, CAST(COALESCE(c.n, 0) AS BIGINT) AS n
      FROM u a CROSS JOIN u b LEFT JOIN c ON c.label = a.label AND c.predicted_label = b.label"""


def share(src: str) -> str:
    return f"""SELECT label, n, n / sum(n) OVER () AS share FROM (
        SELECT label, count(*) AS n FROM {src} WHERE label IS NOT NULL GROUP BY label)"""


def report(src: str, method: str) -> str:
    return f"""
      WITH pl AS ({per_label(src)}), sh AS ({share(src)})
      SELECT '{method}' AS method, 'all' AS class, round(sum(tp) / sum(support), 9) AS accuracy,
             round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall FROM pl
      UNION ALL
      SELECT '{method}', CAST(label AS VARCHAR), CAST(NULL AS DOUBLE), round(precision, 9), round(recall, 9)
      FROM pl WHERE support > 0
      UNION ALL
      SELECT 'baseline', 'all', round(sum(share * share), 9), round(avg(share), 9), round(avg(share), 9) FROM sh
      UNION ALL
      SELECT 'baseline', CAST(label AS VARCHAR), CAST(NULL AS DOUBLE), round(share, 9), round(share, 9) FROM sh"""


# ------------------------------------------------------------------ projections

SQL["prj_1_split_xy"] = W("SELECT key, split, target, p_size, p_retailprice FROM fx_num_class", "fx_num_class")

SQL["prj_2_predictions_class_num"] = W("""
    , votes AS (SELECT p_size, target, count(*) AS n FROM fx_num_class WHERE split = 'train' GROUP BY ALL),
    best AS (SELECT p_size, target AS predicted_code FROM (
        SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY n DESC, target ASC) AS rn FROM votes) WHERE rn = 1),
    m AS (SELECT DISTINCT p_type, target FROM fx_num_class)
    SELECT f.key, f.p_type AS label, m.p_type AS predicted_label, f.p_size, f.p_retailprice
    FROM fx_num_class f LEFT JOIN best b ON f.p_size = b.p_size LEFT JOIN m ON b.predicted_code = m.target
    WHERE f.split = 'valid'""", "fx_num_class").replace("\n    , votes", ", votes", 1)

SQL["prj_3_predictions_class_text"] = W(
    "SELECT key, label, CAST(n_chars >= 1000 AS INTEGER) AS predicted_label, sentence FROM fx_text_class",
    "fx_text_class")

SQL["prj_4_predictions_reg_num"] = W("""
    SELECT p.key, p.label AS actual_target, round(p.predicted_label, 6) AS predicted_target, o.o_orderpriority
    FROM fx_pred_reg p JOIN orders o ON p.key = o.o_orderkey""", "fx_pred_reg")

TEXT_REG_PRED = """
    SELECT v.key, v.label, m.predicted_label, v.sentence
    FROM (SELECT * FROM fx_text_reg WHERE split = 'valid') v
    LEFT JOIN (SELECT lang, avg(label) AS predicted_label FROM fx_text_reg WHERE split = 'train' GROUP BY lang) m
      ON v.lang = m.lang"""

SQL["prj_5_predictions_reg_text"] = W(f"""
    SELECT key, label AS actual_label, round(predicted_label, 6) AS predicted_label, sentence
    FROM ({TEXT_REG_PRED})""", "fx_text_reg")

SQL["prj_6_resplit"] = W("SELECT key, label FROM fx_text_class WHERE split = 'train'", "fx_text_class")

SQL["prj_7_encode"] = W(f"""
    SELECT key, CAST(len({tok('sentence')}) AS INTEGER) AS n_tokens, CAST(label AS DOUBLE) AS label_value
    FROM fx_text_class""", "fx_text_class")

SQL["prj_8_head"] = W("""
    SELECT key, label, sentence FROM fx_text_class WHERE split = 'valid' ORDER BY key LIMIT 20""",
                      "fx_text_class")

# ------------------------------------------------------------------ filters

SQL["fil_1_exclude_tokens"] = W("""
    SELECT sample, token, class, round(shap_value, 6) + 0.0 AS shap_value
    FROM (SELECT sample, replace(token, ' ', '') AS token, class, shap_value FROM fx_attr)
    WHERE token IS NOT NULL AND token NOT IN ('the', 'a')""", "fx_attr")

SQL["fil_2_class_groups"] = W("""
    SELECT class, count(*) AS n, count(DISTINCT token) AS n_tokens, round(sum(shap_value), 3) AS total
    FROM fx_attr GROUP BY class""", "fx_attr")

STATS = """SELECT class, token, avg(shap_value) AS mean, stddev_samp(shap_value) AS std, count(shap_value) AS count
    FROM (SELECT sample, replace(token, ' ', '') AS token, class, shap_value FROM fx_attr
          WHERE replace(token, ' ', '') IS NOT NULL {excl}) GROUP BY class, token"""

SQL["fil_3_having_min"] = W(f"""
    SELECT class, token, round(mean, 6) AS mean, round(std, 6) AS std, count
    FROM ({STATS.format(excl='')}) WHERE count >= 3""", "fx_attr")

SQL["fil_6_is_integer"] = """
    SELECT 'p_size' AS "case", count(*) = count(p_size) AS is_integer FROM part
    UNION ALL SELECT 'p_retailprice', false
    UNION ALL SELECT 'label', count(*) = count(label) FROM embeddings
    UNION ALL SELECT 'label_with_null', count(*) = count(CASE WHEN label <> 3 THEN label END) FROM embeddings"""

# ------------------------------------------------------------------ sets

SQL["set_1_union_splits"] = W("""
    SELECT key, label, 'train' AS split FROM fx_text_class WHERE split = 'train'
    UNION ALL SELECT key, label, 'valid' FROM fx_text_class WHERE split = 'valid'""", "fx_text_class")

DOC_SPLIT = "CASE WHEN doc_id % 5 = 0 THEN 'valid' ELSE 'train' END"


def class_diff(col: str) -> str:
    return f"""
      SELECT COALESCE(t.v, v.v) AS value,
             CASE WHEN v.v IS NULL AND NOT v.present THEN 'train_only'
                  WHEN t.v IS NULL AND NOT t.present THEN 'valid_only' END AS side
      FROM (SELECT DISTINCT {col} AS v, false AS present FROM documents WHERE {DOC_SPLIT} = 'train') t
      FULL OUTER JOIN (SELECT DISTINCT {col} AS v, false AS present FROM documents WHERE {DOC_SPLIT} = 'valid') v
        ON t.v IS NOT DISTINCT FROM v.v"""


SQL["set_2_class_difference"] = f"""
    SELECT value, side FROM (
      SELECT COALESCE(t.v, v.v) AS value,
             CASE WHEN v.tag IS NULL THEN 'train_only' WHEN t.tag IS NULL THEN 'valid_only' END AS side
      FROM (SELECT DISTINCT source AS v, 1 AS tag FROM documents WHERE {DOC_SPLIT} = 'train') t
      FULL OUTER JOIN (SELECT DISTINCT source AS v, 1 AS tag FROM documents WHERE {DOC_SPLIT} = 'valid') v
        ON t.v IS NOT DISTINCT FROM v.v) WHERE side IS NOT NULL"""

SQL["set_3_label_universe"] = W("""
    SELECT label FROM fx_pred_zero WHERE label IS NOT NULL AND predicted_label IS NOT NULL
    UNION SELECT predicted_label FROM fx_pred_zero WHERE label IS NOT NULL AND predicted_label IS NOT NULL""",
                                "fx_pred_zero")

SQL["set_4_missing_codes"] = """
    SELECT code FROM (SELECT unnest(generate_series(CAST(min(label) AS BIGINT), CAST(max(label) AS BIGINT))) AS code
                      FROM embeddings WHERE label <> 3)
    WHERE code NOT IN (SELECT label FROM embeddings WHERE label <> 3)"""

SQL["set_5_missing_labels"] = W("""
    SELECT 'promo' AS variant, target FROM (
      SELECT DISTINCT target FROM fx_num_class
      EXCEPT SELECT target FROM fx_num_class WHERE split = 'train' AND p_type NOT IN ('PROMO'))
    UNION ALL
    SELECT 'promo_small', target FROM (
      SELECT DISTINCT target FROM fx_num_class
      EXCEPT SELECT target FROM fx_num_class WHERE split = 'train' AND p_type NOT IN ('PROMO', 'SMALL'))""",
                                "fx_num_class")

SQL["set_6_unique_labels"] = W("SELECT DISTINCT target AS label FROM fx_num_class", "fx_num_class")

# ------------------------------------------------------------------ joins

TOP = """SELECT class, token, mean, std, count, CAST(token_rank AS INTEGER) AS token_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY class ORDER BY abs(round(mean, 9)) DESC, token ASC) AS token_rank
      FROM ({stats}) WHERE count >= 3) WHERE token_rank <= 10"""
EXCL = "AND replace(token, ' ', '') NOT IN ('the', 'a')"
CLEAN = f"""SELECT sample, replace(token, ' ', '') AS token, class, shap_value FROM fx_attr
    WHERE replace(token, ' ', '') IS NOT NULL {EXCL}"""

SQL["jon_1_semi"] = W(f"""
    SELECT sample, token, class, round(shap_value, 6) + 0.0 AS shap_value FROM ({CLEAN}) c
    WHERE (class, token) IN (SELECT (class, token) FROM ({TOP.format(stats=STATS.format(excl=EXCL))}))""",
                      "fx_attr").replace("WHERE (class, token) IN (SELECT (class, token) FROM",
                                         "WHERE EXISTS (SELECT 1 FROM").replace(
    "WHERE token_rank <= 10))", "WHERE token_rank <= 10) tt WHERE tt.class = c.class AND tt.token = c.token)")

SQL["jon_2_anti"] = W(f"""
    SELECT key, count(*) AS n_kept FROM (SELECT key, unnest({tok('sentence')}) AS token FROM fx_text_class)
    WHERE token NOT IN (SELECT unnest({STOP})) GROUP BY key""", "fx_text_class")

SQL["jon_3_lookup"] = """
    SELECT p_partkey AS key, p_type, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS code FROM part"""

MISSING_TRAIN = "SELECT * FROM fx_num_class WHERE NOT (split = 'train' AND p_type IN ('PROMO', 'SMALL'))"

SQL["jon_5_cross_mean_rows"] = W(f"""
    , fm AS ({MISSING_TRAIN})
    SELECT m.target, round(a.p_size, 9) AS p_size, round(a.p_retailprice, 6) AS p_retailprice
    FROM (SELECT DISTINCT target FROM fm EXCEPT SELECT target FROM fm WHERE split = 'train') m
    CROSS JOIN (SELECT avg(p_size) AS p_size, avg(p_retailprice) AS p_retailprice FROM fm WHERE split = 'train') a""",
                                 "fx_num_class").replace("\n    , fm", ", fm", 1)

SQL["jon_6_label_grid"] = W(confusion("fx_pred_zero").replace("WITH src", ", src", 1), "fx_pred_zero")

# ------------------------------------------------------------------ aggregates

SQL["agg_1_label_distribution"] = """
    SELECT label, 'ラベル' || CAST(label AS VARCHAR) AS label_name, count(*) AS n FROM embeddings GROUP BY label"""

SQL["agg_2_token_length_histogram"] = f"""
    SELECT CAST(len({tok('text')}) AS INTEGER) AS n_tokens, count(*) AS n_docs FROM documents GROUP BY 1"""

SQL["agg_3_label_share"] = W(f"SELECT label, n, round(share, 9) AS share FROM ({share('fx_pred_multi')})",
                             "fx_pred_multi")

SQL["agg_4_min_max"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value FROM part"""
    for c in ("p_size", "p_retailprice"))

SQL["agg_5_column_means"] = W("""
    SELECT round(avg(p_size), 9) AS p_size, round(avg(p_retailprice), 6) AS p_retailprice
    FROM fx_num_class WHERE split = 'train'""", "fx_num_class")

SQL["agg_6_token_stats"] = W("""
    SELECT class, token, round(avg(shap_value), 6) AS mean, round(stddev_samp(shap_value), 6) AS std,
           count(shap_value) AS count FROM fx_attr GROUP BY class, token""", "fx_attr")

SQL["agg_7_cross_count"] = W("""
    SELECT label, predicted_label, count(*) AS n FROM fx_pred_multi
    WHERE label IS NOT NULL AND predicted_label IS NOT NULL GROUP BY ALL""", "fx_pred_multi")

SQL["agg_8_num_labels"] = "SELECT CAST(max(label) + 1 AS INTEGER) AS num_labels FROM embeddings"

SQL["agg_9_random_accuracy"] = W(f"""
    SELECT round(sum(share * share), 9) AS accuracy, round(avg(share), 9) AS macro_precision,
           round(avg(share), 9) AS macro_recall FROM ({share('fx_pred_multi')})""", "fx_pred_multi")

# ------------------------------------------------------------------ top-k

SQL["top_1_top_tokens"] = W(f"""
    SELECT class, token, round(mean, 6) AS mean, round(std, 6) AS std, count, token_rank
    FROM ({TOP.format(stats=STATS.format(excl=EXCL))})""", "fx_attr")

SQL["top_2_token_rank"] = W(f"""
    SELECT class, token, token_rank FROM ({TOP.format(stats=STATS.format(excl=EXCL))})""", "fx_attr")

DOC_TERMS = f"""SELECT key, term, count(*) AS tf FROM (
      SELECT key, unnest({kept('sentence')}) AS term FROM fx_text_class) GROUP BY key, term"""
VOCAB = """SELECT term, CAST(row_number() OVER (ORDER BY total DESC, term ASC) - 1 AS INTEGER) AS term_id, total, df
    FROM (SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df FROM dt GROUP BY term)
    ORDER BY total DESC, term ASC LIMIT {n}"""

SQL["top_3_vocabulary"] = W(f", dt AS ({DOC_TERMS}) {VOCAB.format(n=10000)}", "fx_text_class")

SQL["top_4_argmax"] = W("""
    SELECT key, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS predicted_label FROM fx_logits""",
                        "fx_logits")

IMPORTANCE = """SELECT class, token, round(mean_abs, 6) AS mean_abs, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY class ORDER BY round(mean_abs, 9) DESC, token ASC) AS rank FROM (
        SELECT class, token, sum(abs(shap_value)) / (SELECT count(DISTINCT sample) FROM fx_attr) AS mean_abs
        FROM ({src}) GROUP BY class, token)) WHERE rank <= 20"""

SQL["top_5_feature_importance"] = W(IMPORTANCE.format(src="SELECT * FROM fx_attr"), "fx_attr")

SQL["top_6_sorted_labels"] = "SELECT DISTINCT lang AS label FROM documents WHERE lang IS NOT NULL"

RUNS = f"""
    , cand AS (SELECT label, n_chars, unnest([500, 1000, 2000]) AS t FROM fx_text_class),
    pred AS (SELECT 'checkpoint-' || CAST(t AS VARCHAR) AS run, label,
                    CAST(n_chars >= t AS INTEGER) AS predicted_label FROM cand),
    pl AS ({per_label('pred', by='run')}),
    runs AS (SELECT run, round(avg(f1), 9) AS f1 FROM pl GROUP BY run)"""

SQL["top_7_select_best"] = W(RUNS + """
    SELECT 'best' AS kind, run, f1 FROM (SELECT * FROM runs ORDER BY f1 DESC, run ASC LIMIT 1)
    UNION ALL
    SELECT 'latest', run, f1 FROM runs WHERE CAST(split_part(run, '-', 2) AS INTEGER) =
        (SELECT max(CAST(split_part(run, '-', 2) AS INTEGER)) FROM runs)""", "fx_text_class")

# ------------------------------------------------------------------ features

SQL["fea_1_tokens"] = f"""
    SELECT doc_id AS key, CAST(len({tok('text')}) AS INTEGER) AS n_tokens,
           array_to_string({tok('text')}, ' ') AS tokens FROM documents"""

BIGRAM_S = r"regexp_replace(lower(text), '[ \t\n\r\f\x0B]+', '', 'g')"
SQL["fea_1_char_ngrams"] = f"""
    SELECT conv_id, turn, CAST(len(g) AS INTEGER) AS n_bigrams, CAST(len(list_distinct(g)) AS INTEGER) AS n_distinct
    FROM (SELECT conv_id, turn, CASE WHEN length(s) < 2 THEN []::VARCHAR[]
                 ELSE list_transform(range(1, length(s)), lambda i: substring(s, i, 2)) END AS g
          FROM (SELECT conv_id, turn, {BIGRAM_S} AS s FROM conversations))"""

SQL["fea_2_remove_stop"] = f"""
    SELECT doc_id AS key, CAST(len({kept('text')}) AS INTEGER) AS n_kept,
           array_to_string({kept('text')}, ' ') AS tokens FROM documents"""

SQL["fea_3_tfidf"] = W(f"""
    , dt AS ({DOC_TERMS}),
    voc AS ({VOCAB.format(n=10000)}),
    n AS (SELECT count(*) AS n FROM fx_text_class),
    idf AS (SELECT term, term_id, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM voc, n),
    raw AS (SELECT dt.key, dt.term, idf.term_id, dt.tf, dt.tf * idf.idf AS raw FROM dt JOIN idf ON dt.term = idf.term)
    SELECT key, term, term_id, tf, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY key)), 9) AS weight
    FROM raw""", "fx_text_class")

_PRIOS = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SQL["fea_4_dummies"] = W("SELECT key, split, target, " + ", ".join(
    [f"""CAST(COALESCE(o_orderstatus = '{v}', false) AS INTEGER) AS "o_orderstatus_{v}" """ for v in ("O", "P")]
    + [f"""CAST(COALESCE(o_orderpriority = '{v}', false) AS INTEGER) AS "o_orderpriority_{v}" """ for v in _PRIOS]
    + [f"""CAST(COALESCE(o_month = {m}, false) AS INTEGER) AS "o_month_{m}" """ for m in range(2, 13)])
    + " FROM fx_cat", "fx_cat")

SQL["fea_4_sparse_dummies"] = """
    WITH s AS (SELECT source, row_number() OVER (ORDER BY source) - 2 AS i FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
    l AS (SELECT lang, row_number() OVER (ORDER BY lang) - 2 AS i FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
    n AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 2 AS i FROM (SELECT DISTINCT n_chars FROM documents WHERE n_chars IS NOT NULL)),
    w AS (SELECT (SELECT greatest(count(*) - 1, 0) FROM s) AS ws, (SELECT greatest(count(*) - 1, 0) FROM l) AS wl,
                 (SELECT greatest(count(*) - 1, 0) FROM n) AS wn)
    SELECT d.doc_id AS key, CAST(list_filter([CASE WHEN s.i >= 0 THEN s.i END, CASE WHEN l.i >= 0 THEN l.i + ws END,
             CASE WHEN n.i >= 0 THEN n.i + ws + wl END], lambda x: x IS NOT NULL) AS INTEGER[]) AS active, ws + wl + wn AS n_features
    FROM documents d LEFT JOIN s USING (source) LEFT JOIN l USING (lang) LEFT JOIN n USING (n_chars), w"""

SQL["fea_5_label_encoder"] = W("SELECT key, p_type, target FROM fx_num_class", "fx_num_class")

SQL["fea_6_decode"] = W("""
    SELECT f.key, f.target, m.p_type AS decoded FROM fx_num_class f
    LEFT JOIN (SELECT DISTINCT target, p_type FROM fx_num_class) m ON f.target = m.target""", "fx_num_class")

SQL["fea_7_impute_missing_classes"] = W(f"""
    , fm AS ({MISSING_TRAIN}),
    tr AS (SELECT key, split, target, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM fm WHERE split = 'train')
    SELECT key, split, target, round(p_size, 9) AS p_size, round(p_retailprice, 6) AS p_retailprice FROM tr
    UNION ALL
    SELECT CAST(NULL AS BIGINT), 'train', m.target, round(a.p_size, 9), round(a.p_retailprice, 6)
    FROM (SELECT DISTINCT target FROM fm EXCEPT SELECT target FROM tr) m
    CROSS JOIN (SELECT avg(p_size) AS p_size, avg(p_retailprice) AS p_retailprice FROM tr) a""",
                                        "fx_num_class")

MINMAX = "(SELECT CAST(min(label) AS DOUBLE) AS lo, CAST(max(label) AS DOUBLE) AS hi FROM fx_text_reg WHERE split = 'train')"
RANGE = "CASE WHEN hi - lo = 0 THEN 1.0 ELSE hi - lo END"

SQL["fea_8_minmax"] = W(f"""
    SELECT key, label, round(scaled, 9) AS scaled, round(scaled * {RANGE} + lo, 6) AS restored
    FROM (SELECT key, label, (label - lo) / {RANGE} AS scaled, lo, hi
          FROM fx_text_reg, {MINMAX} s WHERE split = 'valid')""", "fx_text_reg")

ENCODED = W(f"""
    , dt AS (SELECT key, term, count(*) AS tf FROM (
        SELECT key, unnest({tok('sentence')}) AS term FROM fx_text_class) GROUP BY key, term),
    voc AS ({VOCAB.format(n=10000)}),
    pos AS (SELECT key, unnest(t[1:128]) AS term, generate_subscripts(t[1:128], 1) AS pos
            FROM (SELECT key, {tok('sentence')} AS t FROM fx_text_class)),
    ids AS (SELECT p.key, p.pos, COALESCE(v.term_id + 1, 0) AS id FROM pos p LEFT JOIN voc v ON p.term = v.term),
    agg AS (SELECT key, list(id ORDER BY pos) AS l FROM ids GROUP BY key)
    SELECT f.key, array_to_string(list_resize(COALESCE(a.l, []::INTEGER[]), 128, 0), ',') AS ids,
           CAST(COALESCE(len(list_filter(a.l, lambda x: x <> 0)), 0) AS INTEGER) AS n_known
    FROM fx_text_class f LEFT JOIN agg a ON f.key = a.key""", "fx_text_class")
SQL["fea_10_encode_ids"] = ENCODED
SQL["fea_10_encode_ids_fit"] = ENCODED.replace("128", "512")

# ------------------------------------------------------------------ scalar functions

PROBS = """
    , pr AS (SELECT key, pos, x FROM (SELECT key, unnest(logits) AS x, generate_subscripts(logits, 1) - 1 AS pos
                                      FROM fx_logits)),
    mx AS (SELECT key, max(x) AS m FROM pr GROUP BY key),
    probs AS (SELECT pr.key, CAST(pr.pos AS INTEGER) AS pos,
                     exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY pr.key) AS p FROM pr JOIN mx ON pr.key = mx.key)"""

SQL["fun_1_softmax"] = W(PROBS + " SELECT key, pos, round(p, 12) AS p FROM probs", "fx_logits")

SQL["fun_2_logit"] = W(PROBS + """ SELECT key, pos,
    round(CASE WHEN p > 0 AND p < 1 THEN ln(p / (1.0 - p)) END, 9) AS logit FROM probs""", "fx_logits")

SQL["fun_3_sign"] = W("SELECT key, target, CAST(sign(target) AS INTEGER) AS sign FROM fx_num_class", "fx_num_class")

SQL["fun_4_abs"] = "SELECT c_custkey, abs(c_acctbal) AS abs_acctbal FROM customer"

SQL["fun_5_sqrt"] = "SELECT c_custkey, round(sqrt(abs(c_acctbal)), 9) AS sqrt_abs_acctbal FROM customer"

SQL["fun_6_reciprocal"] = """
    SELECT p_partkey, round(CASE WHEN p_size - 1 = 0 THEN NULL ELSE 1.0 / CAST(p_size - 1 AS DOUBLE) END, 12) AS inv
    FROM part"""

SQL["fun_7_strip_blanks"] = "SELECT conv_id, turn, replace(text, ' ', '') AS stripped FROM conversations"

SQL["fun_8_join_tokens"] = f"SELECT item_id, array_to_string({tok('text')}, ' ') AS joined FROM benchmark"

SQL["fun_9_int_range"] = """
    SELECT CAST(unnest(generate_series(min(label), max(label))) AS INTEGER) AS code FROM embeddings"""

SQL["fun_10_squared_error"] = W("""
    SELECT key, round((predicted_label - label) * (predicted_label - label), 2) AS squared_error FROM fx_pred_reg""",
                                "fx_pred_reg")

SQL["fun_11_float_cast"] = "SELECT doc_id AS key, CAST(n_chars AS DOUBLE) AS label FROM documents"

SQL["fun_12_run_step"] = W(RUNS + " SELECT run, CAST(split_part(run, '-', 2) AS INTEGER) AS step FROM runs",
                           "fx_text_class")

SQL["fun_13_array_length"] = f"""
    SELECT conv_id, turn, CAST(len({tok('text')}) AS INTEGER) AS n_tokens FROM conversations"""

# ------------------------------------------------------------------ evaluation

SQL["eva_1_confusion"] = W(confusion("fx_pred_bin").replace("WITH src", ", src", 1), "fx_pred_bin")

SQL["eva_2_accuracy"] = W("""
    SELECT round(avg(CAST(label = predicted_label AS INTEGER)), 9) AS accuracy FROM fx_pred_bin""", "fx_pred_bin")

SQL["eva_3_macro"] = W(f"""
    , pl AS ({per_label('fx_pred_zero')})
    SELECT accuracy, macro_precision, macro_recall, macro_f1, n_labels FROM (SELECT {summary_cols()} FROM pl)""",
                       "fx_pred_zero")

SQL["eva_4_weighted"] = W(f"""
    , pl AS ({per_label('fx_pred_multi')})
    SELECT weighted_precision, weighted_recall, weighted_f1, n_rows FROM (SELECT {summary_cols()} FROM pl)""",
                          "fx_pred_multi")

SQL["eva_5_per_class"] = W(f"""
    , pl AS ({per_label('fx_pred_zero')})
    SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, support FROM pl WHERE support > 0""",
                           "fx_pred_zero")

SQL["eva_6_baseline"] = W(f"""
    SELECT round(sum(share * share), 9) AS accuracy, round(avg(share), 9) AS macro_precision,
           round(avg(share), 9) AS macro_recall FROM ({share('fx_pred_bin')})""", "fx_pred_bin")

SQL["eva_7_collapsed"] = W(f"""
    , col AS (SELECT label, CAST(sign(predicted_label) AS INTEGER) AS predicted_label FROM fx_pred_multi),
    pl AS ({per_label('col')})
    SELECT accuracy, macro_precision, macro_recall, macro_f1 FROM (SELECT {summary_cols()} FROM pl)""",
                           "fx_pred_multi")

REG = """
    SELECT count(*) AS n, sum((p - y) * (p - y)) / count(*) AS mse, sum(abs(p - y)) / count(*) AS mae,
           sum((y - (SELECT avg(y) FROM {src})) * (y - (SELECT avg(y) FROM {src}))) AS ss_tot,
           sum((p - y) * (p - y)) AS ss_res
    FROM {src}"""


def reg(src: str) -> str:
    return REG.format(src=src)


SQL["eva_8_regression"] = W(f"""
    , s AS (SELECT CAST(label AS DOUBLE) AS y, CAST(predicted_label AS DOUBLE) AS p FROM fx_pred_reg
            WHERE label IS NOT NULL AND predicted_label IS NOT NULL)
    SELECT n, round(mse, 2) AS mse, round(mae, 6) AS mae, round(sqrt(mse), 6) AS rmse FROM ({reg('s')})""",
                            "fx_pred_reg")

SQL["eva_9_r2"] = W(f"""
    , s AS (SELECT CAST(label AS DOUBLE) AS y, CAST(predicted_label AS DOUBLE) AS p FROM fx_pred_reg
            WHERE label IS NOT NULL AND predicted_label IS NOT NULL)
    SELECT round(CASE WHEN ss_tot > 0 THEN 1.0 - ss_res / ss_tot WHEN ss_res = 0 THEN 1.0 ELSE 0.0 END, 9) AS r2,
           round(CASE WHEN mse = 0 THEN NULL ELSE 1.0 / mse END * 1e12, 6) AS inv_mse_e12 FROM ({reg('s')})""",
                    "fx_pred_reg")

SQL["eva_10_inverse_scaled"] = W(f"""
    , mm AS {MINMAX},
    sc AS (SELECT key, split, lang, (label - lo) / {RANGE} AS label FROM fx_text_reg, mm),
    means AS (SELECT lang, avg(label) AS pl FROM sc WHERE split = 'train' GROUP BY lang),
    pred AS (SELECT v.label AS ls, m.pl FROM sc v LEFT JOIN means m ON v.lang = m.lang WHERE v.split = 'valid'),
    s AS (SELECT ls * {RANGE} + lo AS y, pl * {RANGE} + lo AS p FROM pred, mm WHERE ls IS NOT NULL AND pl IS NOT NULL)
    SELECT n, round(mse, 3) AS mse, round(mae, 6) AS mae, round(sqrt(mse), 6) AS rmse,
           round(CASE WHEN ss_tot > 0 THEN 1.0 - ss_res / ss_tot WHEN ss_res = 0 THEN 1.0 ELSE 0.0 END, 9) AS r2
    FROM ({reg('s')})""", "fx_text_reg")

SQL["eva_11_heatmap_cells"] = W(confusion("fx_pred_multi").replace("WITH src", ", src", 1), "fx_pred_multi")

SQL["eva_12_metric_report"] = W(report("fx_pred_bin", "proposed").replace("WITH pl", ", pl", 1), "fx_pred_bin")

SQL["snk_4_metric_report_multi"] = W(report("fx_pred_zero", "argmax3").replace("WITH pl", ", pl", 1),
                                     "fx_pred_zero")

# ------------------------------------------------------------------ attributions

SQL["xpl_3_token_attributions"] = W(
    "SELECT sample, token, class, round(shap_value, 6) + 0.0 AS shap_value FROM fx_attr", "fx_attr")

SQL["xpl_4_attributions_long"] = SQL["xpl_3_token_attributions"]

SQL["xpl_5_token_summary"] = W(f"""
    SELECT c.sample, c.token, c.class, round(c.shap_value, 6) + 0.0 AS shap_value, tt.token_rank
    FROM ({CLEAN}) c JOIN ({TOP.format(stats=STATS.format(excl=EXCL))}) tt
      ON tt.class = c.class AND tt.token = c.token""", "fx_attr")

SQL["xpl_6_global_importance"] = W(IMPORTANCE.format(
    src="SELECT sample, token, 0 AS class, shap_value FROM fx_attr"), "fx_attr")

SQL["xpl_7_error_bars"] = W(f"""
    SELECT class, token, round(mean, 6) AS mean, round(std, 6) AS std, token_rank
    FROM ({TOP.format(stats=STATS.format(excl=''))})""", "fx_attr")

# ------------------------------------------------------------------ validation / UDF surface


def consistent(col: str) -> str:
    return f"""
      SELECT '{col}' AS "column", count(*) = 0 AS consistent,
             count(CASE WHEN side = 'train_only' THEN 1 END) AS n_train_only,
             count(CASE WHEN side = 'valid_only' THEN 1 END) AS n_valid_only
      FROM (SELECT CASE WHEN v.tag IS NULL THEN 'train_only' WHEN t.tag IS NULL THEN 'valid_only' END AS side
            FROM (SELECT DISTINCT {col} AS v, 1 AS tag FROM documents WHERE {DOC_SPLIT} = 'train') t
            FULL OUTER JOIN (SELECT DISTINCT {col} AS v, 1 AS tag FROM documents WHERE {DOC_SPLIT} = 'valid') v
              ON t.v IS NOT DISTINCT FROM v.v) WHERE side IS NOT NULL"""


SQL["val_1_classes_consistent"] = consistent("lang") + " UNION ALL " + consistent("source")


def validate(case: str, src: str, col: str, integral: bool) -> str:
    nm = "CAST(max_value - min_value + 1 - n_distinct AS BIGINT)"
    integer_rule = "n_null > 0" if integral else "true"
    return f"""
      SELECT '{case}' AS "case", rule = 'ok' AS ok, rule, CAST(min_value AS VARCHAR) AS min_value,
             CAST(max_value AS VARCHAR) AS max_value,
             {'n_missing' if integral else 'CAST(NULL AS BIGINT)'} AS n_missing FROM (
        SELECT CASE WHEN {integer_rule} THEN 'integer' WHEN min_value <> 0 THEN 'min'
                    WHEN {nm} > 0 THEN 'gap' ELSE 'ok' END AS rule, min_value, max_value, {nm} AS n_missing
        FROM (SELECT count(*) - count(v) AS n_null, min(v) AS min_value,
                     max(v) AS max_value, count(DISTINCT v) AS n_distinct
              FROM (SELECT {col} AS v FROM {src})))"""


SQL["val_2_validate_target"] = " UNION ALL ".join([
    validate("labels_ok", "embeddings", "label", True),
    validate("p_size", "part", "p_size", True),
    validate("p_retailprice", "part", "p_retailprice", False),
    validate("label_gap", "(SELECT * FROM embeddings WHERE label <> 3)", "label", True),
    validate("label_null", "embeddings", "CASE WHEN label <> 3 THEN label END", True),
    """SELECT 'no_column', false, 'exists', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT)"""])

SQL["val_3_label_table"] = """
    SELECT quality AS label, 'ラベル' || CAST(quality AS VARCHAR) AS label_name, count(*) AS n
    FROM labels GROUP BY quality"""

SQL["udf_1_map_columns"] = f"""
    SELECT doc_id AS key, upper(lang) AS lang_upper, CAST(len({tok('text')}) AS INTEGER) AS words,
           round(CASE WHEN len({tok('text')}) = 0 THEN NULL
                      ELSE CAST(n_chars AS DOUBLE) / len({tok('text')}) END, 9) AS chars_per_word
    FROM documents"""

SQL["udf_2_metric_callbacks"] = W("""
    SELECT round(max(abs(predicted_label - label)), 6) AS max_abs_error,
           count(CASE WHEN predicted_label - label > 0 THEN 1 END) AS n_over,
           round(avg(predicted_label - label), 6) AS mean_error FROM fx_pred_reg""", "fx_pred_reg")


# ------------------------------------------------------------------ end-to-end

LINEAR_SCORES = f"""
    , dt AS ({DOC_TERMS}),
    voc AS ({VOCAB.format(n=10000)}),
    n AS (SELECT count(*) AS n FROM fx_text_class),
    idf AS (SELECT term, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM voc, n),
    raw AS (SELECT dt.key, dt.term, dt.tf * idf.idf AS raw FROM dt JOIN idf ON dt.term = idf.term),
    cells AS (SELECT key, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY key)) AS weight FROM raw),
    trt AS (SELECT dt.term, dt.tf, f.label FROM dt JOIN fx_text_class f ON dt.key = f.key WHERE f.split = 'train'),
    w AS (SELECT term, ln((sum(CASE WHEN label = 1 THEN tf ELSE 0 END) + 1.0)
                        / (sum(CASE WHEN label = 0 THEN tf ELSE 0 END) + 1.0)) AS w FROM trt GROUP BY term),
    prior AS (SELECT ln((sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) + 1.0)
                      / (sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) + 1.0)) AS b
              FROM fx_text_class WHERE split = 'train'),
    contrib AS (SELECT c.key, sum(c.weight * w.w) AS s FROM cells c JOIN w ON c.term = w.term GROUP BY c.key),
    scores AS (SELECT v.key, v.label, round(COALESCE(c.s, 0.0) + prior.b, 9) AS score
               FROM (SELECT key, label FROM fx_text_class WHERE split = 'valid') v
               LEFT JOIN contrib c ON v.key = c.key CROSS JOIN prior),
    pred AS (SELECT key, label, score, CAST(score > 0 AS INTEGER) AS predicted_label FROM scores)"""

SQL["run_text_linear_scores"] = W(LINEAR_SCORES + " SELECT * FROM pred", "fx_text_class")

SQL["xpl_3_occlusion_attributions"] = W(LINEAR_SCORES + """
    , part AS (SELECT dt.key, dt.term, COALESCE(dt.tf * idf.idf, 0.0) AS raw, w.w FROM dt LEFT JOIN idf ON idf.term = dt.term
               JOIN w0 w ON dt.term = w.term
               JOIN (SELECT key FROM fx_text_class WHERE split = 'valid') v ON v.key = dt.key),
    tot AS (SELECT key, count(CASE WHEN raw <> 0 THEN 1 END) AS n, sum(raw * w) AS s, sum(raw * raw) AS n2 FROM part GROUP BY key)
    SELECT p.key AS sample, p.term AS token, 0 AS class,
           round(CASE WHEN p.raw = 0 THEN 0.0 ELSE t.s / sqrt(t.n2) - CASE WHEN t.n > 1 AND t.n2 - p.raw * p.raw > 0
                 THEN (t.s - p.raw * p.w) / sqrt(t.n2 - p.raw * p.raw) ELSE 0.0 END END, 9) + 0.0 AS shap_value
    FROM part p JOIN tot t ON p.key = t.key""".replace("w0 w", """(
        SELECT dt.term, ln((sum(CASE WHEN f.split = 'train' AND f.label = 1 THEN tf ELSE 0 END) + 1.0)
                         / (sum(CASE WHEN f.split = 'train' AND f.label = 0 THEN tf ELSE 0 END) + 1.0)) AS w
        FROM dt JOIN fx_text_class f ON dt.key = f.key GROUP BY dt.term) w"""), "fx_text_class")

SQL["run_text_linear_report"] = W(LINEAR_SCORES + report("pred", "tfidf_linear").replace("WITH pl", ", pl", 1),
                                  "fx_text_class")

SQL["jon_4_key_zip"] = W("""
    SELECT p.key, p.label, p.predicted_label, d.lang, d.source
    FROM fx_pred_bin p JOIN documents d ON p.key = d.doc_id""", "fx_pred_bin")


# ------------------------------------------------------------------ sources and sinks
# A CSV round trip reads the pandas missing-value tokens back as NULL.
NA_LIST = "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in NA_VALUES) + ")"


def na(x: str) -> str:
    return f"CASE WHEN {x} IN {NA_LIST} THEN NULL ELSE {x} END"


SQL["src_1_read_pair"] = W(f"""
    SELECT split, {na('sentence')} AS sentence, CAST(label AS BIGINT) AS label FROM fx_text_class""",
                           "fx_text_class")

SQL["jon_4_positional_zip"] = W(f"""
    SELECT row_number() OVER (ORDER BY key) - 1 AS number, {na('sentence')} AS sentence, label,
           CAST(n_chars >= 1000 AS INTEGER) AS predicted_label FROM fx_text_class""", "fx_text_class")

SQL["src_2_read_confusion"] = W(f"""
    SELECT CAST(label AS VARCHAR) AS label, CAST(predicted_label AS VARCHAR) AS predicted_label, n
    FROM ({confusion('fx_pred_multi')})""", "fx_pred_multi")

SQL["src_3_read_predictions"] = W(report("fx_pred_bin", "proposed").replace("WITH pl", ", pl", 1), "fx_pred_bin")

SQL["src_4_read_attributions"] = W(f"""
    SELECT sample, {na('token')} AS token, CAST(class AS BIGINT) AS class, round(shap_value, 6) + 0.0 AS shap_value
    FROM fx_attr""", "fx_attr")

SQL["src_5_visualize_labels"] = """
    SELECT CAST(quality AS BIGINT) AS label, 'ラベル' || CAST(quality AS VARCHAR) AS label_name, count(*) AS n
    FROM labels GROUP BY quality"""

SQL["snk_1_write_predictions"] = W("""
    SELECT key, label AS actual_target, round(predicted_label, 6) + 0.0 AS predicted_target FROM fx_pred_reg""",
                                   "fx_pred_reg")

SQL["snk_2_write_confusion"] = W(f"""
    , cells AS ({confusion('fx_pred_multi')})
    SELECT CAST(label AS BIGINT) AS label, {", ".join(
        f'CAST(sum(CASE WHEN predicted_label = {c} THEN n END) AS BIGINT) AS "{c}"' for c in range(10))}
    FROM cells GROUP BY label""", "fx_pred_multi")


from .facts import FACT_SQL  # noqa: E402

SQL.update(FACT_SQL)
