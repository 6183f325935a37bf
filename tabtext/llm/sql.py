"""DuckDB SQL of the queries that SQL can express, over the whole tables."""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def mixing_rows(documents: str = "documents", seed: int = 11) -> str:
    """CTEs up to ``mixed`` (doc_id, size, source_size, target, copies)."""
    return f"""
sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS BIGINT) AS size,
         md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS rank
  FROM {documents}),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 2 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM sums),
filled AS (
  SELECT *, least(CAST(sum(source_size) OVER () * 150 AS DOUBLE) / 100.0, CAST(sum(cap) OVER () AS DOUBLE)) AS wanted,
         CAST(coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS clamped,
         CAST(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS open_w
  FROM weighed),
levels AS (SELECT *, (wanted - clamped) / open_w AS level, (wanted - clamped) / open_w * w >= cap AS is_full FROM filled),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN CAST(cap AS DOUBLE)
              ELSE (SELECT arg_min(level, clamped) FROM levels WHERE NOT is_full) * w END AS target
  FROM levels),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
used AS (
  SELECT source, rank, size,
         coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY rank, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(size) AS step
  FROM sized GROUP BY source, rank, size),
mixed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target,
         p.whole + CASE WHEN u.used + u.step / 2.0 <= p.target - p.whole * p.source_size
                         AND p.target - p.whole * p.source_size > 0 THEN 1 ELSE 0 END AS copies, s.source
  FROM sized s
  JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
  JOIN used u ON s.source IS NOT DISTINCT FROM u.source AND s.rank = u.rank AND s.size = u.size)"""


OP2 = f"""WITH {mixing_rows()}
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM mixed"""

OP8 = f"""
WITH h AS (SELECT doc_id, sha256({LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM h WINDOW g AS (PARTITION BY text_sha256)"""


def _op5() -> str:
    """Lines first: notices are emptied, the rest is lower-cased; then the canonical lines and the canonical text."""
    from . import licenses as L
    q = lambda s: "'" + s.replace("'", "''") + "'"
    small = "translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    name = L.NAME_WORD[1:-1] + L.SMALL + L.NAME_WORD[L.NAME_WORD.index("[^"):-1]  # a capital, then a small letter anywhere
    between = "|".join(L.BETWEEN_NAMES)
    names = (rf"{L.NAME_HEAD}((by|the|The)[ \t,]+)*{name}([ \t,]+({name}|[A-Z]\.?|{between}|<[^<>]*>))*[ \t\r.]*$")
    no_name = rf"{L.NAME_HEAD}((by|the|The)[ \t,]+)*({L.NOT_A_NAME[1:]}|(by|the|The)?[ \t\r.]*$)"
    notice = (f"regexp_matches({small}, {q(L.COPYRIGHT_LINE)}) OR "
              f"(regexp_matches(x, {q(names)}) AND NOT regexp_matches(x, {q(no_name)}))")

    def unified(c: str) -> str:
        for old, new in L.SPELLINGS:
            c = f"replace({c}, {q(old)}, {q(new)})"
        return f"regexp_replace({c}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"

    folded = ("regexp_replace(regexp_replace(array_to_string(body, chr(10)), '-[ \\t\\r]*\\n[ \\t/*#;>-]*', '-', 'g'), "
              "'[ \\t\\r]*\\n[ \\t/*#;>-]*', ' ', 'g')")
    whole = unified(f"regexp_replace({folded}, '[ \\t\\r]+', ' ', 'g')")
    lines = unified("regexp_replace(array_to_string(body, chr(10)), '[ \\t]+', ' ', 'g')")
    known = ", ".join(f"('{v}', '{k}')" for k, v in L.digests().items())
    return f"""
WITH known(text_digest, license_id) AS (VALUES {known}),
c AS (SELECT doc_id, row_number() OVER () AS r,
             [CASE WHEN {notice} THEN '' ELSE {small} END FOR x IN string_split(coalesce(text, ''), chr(10))] AS body FROM documents),
hit AS (
  SELECT r, k.license_id AS notice
  FROM (SELECT r, sha256(trim(unnest(string_split({lines}, chr(10))))) AS d FROM c) l JOIN known k ON k.text_digest = l.d),
found AS (SELECT r, count(*) AS n, string_agg(DISTINCT notice, ',' ORDER BY notice) AS ids FROM hit GROUP BY r),
whole AS (SELECT doc_id, r, sha256(trim({whole})) AS text_digest FROM c)
SELECT doc_id, whole.text_digest, license_id, coalesce(n, 0) AS n_notices, coalesce(ids, '') AS notice_ids
FROM whole LEFT JOIN known USING (text_digest) LEFT JOIN found ON whole.r = found.r"""


OP5 = _op5()


def _op11(fan: int = 3) -> str:
    """Levels by a recursive query, proofs and folded roots by a second one along each leaf's way up."""
    spell = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(spell, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    bit = "CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"
    byte = "list_reduce(list_prepend(xor(c, CAST(ord(x) AS BIGINT)), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda b, i: " + bit.format(c="b") + ")"
    crc = ("xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
           "lambda x: CAST(ord(x) AS BIGINT))), lambda c, x: " + byte.replace("CAST(ord(x) AS BIGINT)", "x") + "), 4294967295)")
    up = lambda name: (f"SELECT grp, level + 1 AS level, idx // {fan} AS idx, sha256(string_agg(h, '' ORDER BY idx)) AS h, "  # noqa: E731
                       f"CAST(ceil(any_value(n) / {float(fan)}) AS BIGINT) AS n FROM {name} WHERE n > 1 GROUP BY grp, level, idx // {fan}")
    steps = lambda name: (
        f"SELECT a.grp, a.level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, "
        f"coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r "
        f"FROM {name} a JOIN {name} b ON a.grp = b.grp AND a.level = b.level AND a.idx // {fan} = b.idx // {fan} "
        f"WHERE a.n > 1 GROUP BY a.grp, a.level, a.idx")
    return f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || source, '-') AS grp, {leaf('text')} AS leaf,
         CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS checked
  FROM documents),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n
  FROM leaves),
lower_levels(grp, level, idx, h, n) AS (SELECT grp, 0, idx, leaf, n FROM placed UNION ALL {up('lower_levels')}),
subroots AS MATERIALIZED (SELECT grp, h, row_number() OVER (ORDER BY encode(grp)) - 1 AS idx, count(*) OVER () AS n FROM lower_levels WHERE n = 1),
upper_levels(grp, level, idx, h, n) AS (SELECT 0, 0, idx, h, n FROM subroots UNION ALL {up('upper_levels')}),
lower_steps AS MATERIALIZED ({steps('lower_levels')}),
upper_steps AS MATERIALIZED ({steps('upper_levels')}),
lower_way(doc_id, grp, leaf, level, idx, acc, siblings) AS (
  SELECT doc_id, grp, leaf, 0, idx, checked, '' FROM placed
  UNION ALL
  SELECT w.doc_id, w.grp, w.leaf, w.level + 1, w.idx // {fan}, sha256(s.l || w.acc || s.r), w.siblings || s.l || s.r
  FROM lower_way w JOIN lower_steps s ON s.grp = w.grp AND s.level = w.level AND s.idx = w.idx),
halfway AS MATERIALIZED (
  SELECT w.doc_id, w.grp, w.leaf, w.acc, w.siblings, r.h AS subroot, r.idx
  FROM lower_way w JOIN subroots r ON r.grp = w.grp
  WHERE w.level = (SELECT max(level) FROM lower_levels t WHERE t.grp = w.grp)),
upper_way(doc_id, leaf, subroot, level, idx, acc, siblings) AS (
  SELECT doc_id, leaf, subroot, 0, idx, acc, siblings FROM halfway
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot, w.level + 1, w.idx // {fan}, sha256(s.l || w.acc || s.r), w.siblings || s.l || s.r
  FROM upper_way w JOIN upper_steps s ON s.level = w.level AND s.idx = w.idx),
top AS (SELECT h AS root, level FROM upper_levels WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM upper_way JOIN top USING (level)"""


OP11 = _op11()
