"""DuckDB SQL of the queries that SQL can express, written from the rules.

The others (trained model, encoders, connected components, look-behind
patterns, reply paths) are tested against plain Python in tests/llm.
"""

from __future__ import annotations

from .licenses import LEAST_COSINE, TEMPLATES

WORD = r"[^\x20\x09-\x0D]+"
AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _quality() -> str:
    measures = {"avg_word": ("word_chars", 100, "n_words"), "symbols": ("n_symbols", 10000, "word_chars"),
                "dup_lines": ("n_dup_lines", 1000, "n_lines"), "repeats": ("n_repeat_words", 1000, "n_words")}
    ratio = ", ".join(f"CASE WHEN {d} > 0 THEN {k} * {n} // {d} ELSE 0 END AS m_{m}" for m, (n, k, d) in measures.items())
    bucket = "(({0} >> greatest(length(bin({0})) - 7, 0)) << greatest(length(bin({0})) - 7, 0))"
    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {bucket.format('m_' + m)} AS b FROM cnt WHERE n_words > 0"
                              for m in measures)

    def level(keys):
        by = "".join(f"{k}, " for k in keys)
        return f"""SELECT {by}measure,
    CASE WHEN total < 100 THEN NULL WHEN q90 > q50 THEN q90 + 3 * (q90 - q50)
         WHEN q90 = 0 AND nonzero >= 5 THEN half - 1 END AS hi,
    CASE WHEN total >= 100 AND q10 < q50 AND measure = 'avg_word' THEN q10 - 3 * (q50 - q10) END AS lo
  FROM (
    SELECT {by}measure, count(*) AS total, count(*) FILTER (WHERE b > 0) AS nonzero,
           list(b ORDER BY b)[(count(*) + 9) // 10] AS q10, list(b ORDER BY b)[(count(*) + 1) // 2] AS q50,
           list(b ORDER BY b)[(9 * count(*) + 9) // 10] AS q90,
           (list(b ORDER BY b) FILTER (WHERE b > 0))[(count(*) FILTER (WHERE b > 0) + 1) // 2] AS half
    FROM buckets GROUP BY {by}measure)"""

    inside = " AND ".join(f"coalesce({bucket.format('m_' + m)} <= hi['{m}'], true) AND coalesce({bucket.format('m_' + m)} >= lo['{m}'], true)"
                          for m in measures)
    return f"""WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
         row_number() OVER () AS rid
  FROM documents),
win AS (
  SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w WHERE len(ws) > 4)),
often AS (SELECT rid, g FROM win GROUP BY rid, g HAVING count(*) > 1),
rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT rid, unnest(generate_series(i, i + 4)) AS p FROM win JOIN often USING (rid, g)) GROUP BY rid),
cnt0 AS (
  SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines
  FROM w LEFT JOIN rep USING (rid)),
cnt AS (SELECT *, {ratio} FROM cnt0),
buckets AS ({long}),
own AS ({level(["lang", "source"])}),
lng AS ({level(["lang"])}),
crp AS ({level([])}),
fence AS (
  SELECT o.lang, o.source, map_from_entries(list((o.measure, coalesce(o.lo, l.lo, c.lo)))) AS lo,
         map_from_entries(list((o.measure, coalesce(o.hi, l.hi, c.hi)))) AS hi
  FROM own o JOIN lng l ON l.lang IS NOT DISTINCT FROM o.lang AND l.measure = o.measure
  JOIN crp c ON c.measure = o.measure
  GROUP BY o.lang, o.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {inside} AS kept
FROM cnt LEFT JOIN fence ON fence.lang IS NOT DISTINCT FROM cnt.lang AND fence.source IS NOT DISTINCT FROM cnt.source"""


def _decontamination() -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{AZ}', '{AZ.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH it AS (SELECT item_id, {words} AS ws FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (
    SELECT item_id, ws, least(len(ws), 13) AS n, unnest(generate_series(1, len(ws) - least(len(ws), 13) + 1)) AS i
    FROM it WHERE len(ws) > 0)),
dw AS (SELECT doc_id, row_number() OVER () AS rid, {words} AS ws FROM documents),
pl AS (
  SELECT rid, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (
    SELECT rid, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i
    FROM dw, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
hit AS (SELECT DISTINCT rid, n, i, item_id FROM pl JOIN iw USING (n, g)),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY rid),
its AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)"""


def _licenses() -> str:
    cues = ("(?i)\\b(licen[sc]e[ds]?|licensing|copyright|warrant(y|ies)|redistribut\\w*|sublicense|spdx|"
            "public domain|free software|permission is hereby|gnu|apache|mozilla|creative commons|as is)\\b")
    terms = "regexp_extract_all(lower({0}), '[.+-]*[a-z0-9]+(?:[.+-]+[a-z0-9]+)*')"
    values = ", ".join("({}, '{}', '{}')".format(i, lic, t.replace("'", "''")) for i, (lic, t) in enumerate(TEMPLATES))
    return f"""WITH d AS (
  SELECT doc_id, text, row_number() OVER () AS rid,
         concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), CAST(doc_id AS VARCHAR)) AS path,
         concat_ws('/', coalesce(source, '-'), coalesce(lang, '-')) AS dir FROM documents),
ln AS (
  SELECT rid, i, ls[i] AS line FROM (
    SELECT rid, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT rid, string_split(text, chr(10)) AS ls FROM d))
  WHERE regexp_matches(ls[i], '{cues}')),
blk AS (
  SELECT rid, string_agg(line, chr(10) ORDER BY i) AS block
  FROM (SELECT *, i - row_number() OVER (PARTITION BY rid ORDER BY i) AS run FROM ln) GROUP BY rid, run),
txt AS (SELECT block, count(*) AS copies FROM blk GROUP BY block),
tf AS (SELECT block, copies, term, count(*) AS tf FROM (
  SELECT block, copies, unnest({terms.format('block')}) AS term FROM txt) GROUP BY ALL),
df AS (SELECT term, sum(copies) AS df FROM tf GROUP BY term),
tot AS (SELECT coalesce(sum(copies), 0) AS total FROM txt),
tpl(t, license, body) AS (VALUES {values}),
tt AS (SELECT t, license, term, count(*) AS tf FROM (
  SELECT t, license, unnest({terms.format('body')}) AS term FROM tpl) GROUP BY ALL),
bv AS (SELECT block, tf.term, tf * (ln((total + 1) / (df + 1.0)) + 1) AS w FROM tf JOIN df USING (term), tot),
tv AS (SELECT t, license, tt.term, tf * (ln((total + 1) / (coalesce(df, 0) + 1.0)) + 1) AS w FROM tt LEFT JOIN df USING (term), tot),
bn AS (SELECT block, sqrt(sum(w * w)) AS n FROM bv GROUP BY block),
tn AS (SELECT t, sqrt(sum(w * w)) AS n FROM tv GROUP BY t),
cs AS (
  SELECT bv.block, tv.license, round(sum(bv.w * tv.w) / max(bn.n) / max(tn.n), 6) AS score
  FROM bv JOIN tv USING (term) JOIN bn ON bn.block = bv.block JOIN tn ON tn.t = tv.t GROUP BY bv.block, tv.t, tv.license),
best AS (
  SELECT block, arg_min(license, (-score, license)) AS license, max(score) AS score
  FROM cs GROUP BY block HAVING max(score) >= {LEAST_COSINE}),
own AS (
  SELECT rid, arg_min(license, (-score, license)) AS license, max(score) AS score, count(*) AS n_notices,
         10 * sum(len({terms.format('blk.block')})) >= 8 * max(len({terms.format('d.text')})) AS is_file
  FROM blk JOIN best USING (block) JOIN d USING (rid) GROUP BY rid),
fl AS (
  SELECT dir, arg_min(license, (-n, license)) AS license
  FROM (SELECT dir, license, count(*) AS n FROM own JOIN d USING (rid) WHERE is_file GROUP BY ALL) GROUP BY dir)
SELECT doc_id, path, coalesce(own.license, fl.license) AS license,
  CASE WHEN own.license IS NULL AND fl.license IS NOT NULL THEN 'inherited' WHEN own.license IS NULL THEN 'none'
       WHEN own.is_file THEN 'file' ELSE 'notice' END AS origin,
  CASE WHEN own.license IS NULL AND fl.license IS NOT NULL THEN fl.dir END AS from_dir,
  round(coalesce(own.score, 0.0), 4) AS score, CAST(coalesce(own.n_notices, 0) AS BIGINT) AS n_notices
FROM d LEFT JOIN own USING (rid) LEFT JOIN fl USING (dir)"""


def _vector_codes() -> str:
    """Four rounds over the pairs of parts and entries, all of them compared."""
    def nearest(book):
        return (f"SELECT rid, p, min(struct_pack(dist := dist, e := e)) AS m FROM (SELECT rid, x.p, e, "
                f"list_sum(list_transform(list_zip(x.x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist "
                f"FROM part x JOIN {book} b ON b.p = x.p) GROUP BY rid, p")

    rounds = "".join(f"""near{r} AS MATERIALIZED ({nearest(f'book{r}')}),
mean{r} AS (
  SELECT p, e, list(CAST(floor(total / n) AS BIGINT) ORDER BY pos) AS c FROM (
    SELECT p, m.e AS e, pos, CAST(sum(v) AS BIGINT) AS total, count(*) AS n FROM (
      SELECT n.p, n.m, unnest(x.x) AS v, generate_subscripts(x.x, 1) AS pos
      FROM near{r} n JOIN part x ON x.rid = n.rid AND x.p = n.p) GROUP BY ALL) GROUP BY p, e),
book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m ON m.p = b.p AND m.e = b.e),
""" for r in range(4))
    return f"""WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid,
         list_transform(embedding, lambda y: CAST(floor(1024 * CAST(y AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
part AS MATERIALIZED (
  SELECT rid, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM kept, (SELECT unnest(range(4)) AS p)),
book0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x AS c FROM part WHERE rid <= 256),
{rounds}last AS MATERIALIZED ({nearest('book4')}),
coded AS (
  SELECT rid, string_agg(format('{{:02x}}', m.e), '' ORDER BY p) AS code, CAST(sum(m.dist) AS BIGINT) AS error
  FROM last GROUP BY rid),
digest AS (
  SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, pos)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS pos FROM book4))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (rid), digest"""


def llm_oracles() -> dict[str, str]:
    return {"op4_license_scans": _licenses(), "op5_decontamination": _decontamination(),
            "op8_quality_rules": _quality(), "op12_vector_codes": _vector_codes()}
