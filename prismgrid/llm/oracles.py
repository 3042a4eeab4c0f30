"""DuckDB SQL for the operators that SQL can express. Each restates the contract, not the Spark plan."""

from __future__ import annotations

from prismgrid.llm.secrets import RULES
from prismgrid.llm.urlfilter import DEFAULT, PATTERN_RULES, SITE_RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def url_filters() -> str:
    sites = ", ".join(f"({_quoted(r.host)}, {_quoted(r.path)}, '{r.action}')" for r in SITE_RULES)
    patterns = ", ".join(f"({_quoted(r.pattern)}, {_quoted(r.regex)}, '{r.action}')" for r in PATTERN_RULES)
    return f"""
WITH sites(h, p, action) AS (VALUES {sites}), patterns(name, regex, action) AS (VALUES {patterns}),
split AS (
  SELECT row_number() OVER () AS row, page_id, lower(coalesce(url, '')) AS low,
    {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
fit AS (
  SELECT row, h || p AS rule, action, row_number() OVER (PARTITION BY row ORDER BY length(h || p) DESC, h || p DESC) AS k
  FROM split JOIN sites ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) WHERE host <> ''),
other AS (
  SELECT row, name, action, row_number() OVER (PARTITION BY row ORDER BY length(name) DESC, name DESC) AS k
  FROM split JOIN patterns ON regexp_matches(low, regex) WHERE host <> '')
SELECT page_id, host, path, fit.rule AS rule,
  coalesce(fit.action, other.action, CASE WHEN host = '' THEN 'block' ELSE '{DEFAULT}' END) AS verdict,
  CASE WHEN fit.rule IS NULL THEN other.name END AS pattern
FROM split LEFT JOIN fit ON split.row = fit.row AND fit.k = 1 LEFT JOIN other ON split.row = other.row AND other.k = 1"""


def secret_scans() -> str:
    def cased(pattern: str) -> str:
        """Letters outside character classes in either case, ASCII only."""
        out, depth = "", 0
        k = 0
        while k < len(pattern):
            c = pattern[k]
            if c == "\\":
                size = 4 if pattern[k + 1] == "x" else 2
                out += pattern[k : k + size]
                k += size
                continue
            depth += (c == "[") - (c == "]")
            out += f"[{c.upper()}{c.lower()}]" if c.isalpha() and not depth else c
            k += 1
        return out

    kinds = []
    for i, r in enumerate(RULES):
        pattern = _quoted(cased(r.pattern) if r.any_case else r.pattern)
        kinds.append(f"""
  SELECT row, {i} AS kind_order, '{r.kind}' AS kind, k, g[k] AS tested, m[k] AS found,
    list_sum(list_transform(b[:k], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[:k - 1], lambda x: length(x))), 0)::BIGINT AS s
  FROM (SELECT row, regexp_extract_all(t, {pattern}) AS m, regexp_extract_all(t, {pattern}, {r.group}) AS g, string_split_regex(t, {pattern}) AS b FROM docs), unnest(range(1, len(m) + 1)) AS u(k)
  WHERE length(g[k]) >= {r.least}""")
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(kinds)}),
named AS (SELECT *, kind || ':' || s || ':' || (s + length(found)) AS name FROM spans),
each AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
    string_agg(name, ',' ORDER BY s, kind_order) FILTER (kind_order < 3) AS base, string_agg(name, ',' ORDER BY s, kind_order) AS whole
  FROM named GROUP BY row)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(whole, '') AS spans
FROM docs LEFT JOIN each USING (row)"""


def decontamination() -> str:
    words = "[w FOR w IN regexp_split_to_array(" + _LOWER.format("coalesce(text, '')") + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF w <> '']"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS string
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT row, size, i, array_to_string(w[i : i + size - 1], ' ') AS string
  FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS u(i) WHERE len(w) >= size),
hits AS (SELECT row, item_id, i, size FROM places JOIN windows USING (size, string)),
covered AS (SELECT row, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, size)) AS u(k) GROUP BY row),
items AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (row) LEFT JOIN items USING (row)"""


def quality_rules() -> str:
    """Sketch buckets grow by 1.01 / 0.99; fences reach 4 distances; 2 occurrences pass."""
    counts = {"symbols_per_word": ("n_symbols", "n_words", 2), "dup_line_share": ("n_dup_lines", "greatest(n_lines, 1)", 2), "repeat_share": ("n_repeat_words", "n_words", 2), "word_length": ("word_chars", "n_words", 0)}
    values = " UNION ALL ".join(f"SELECT row, lang, source, '{k}' AS measure, {n} AS x, {of} AS size, {events} AS events, {n} / {of} AS v FROM counts WHERE n_words > 0" for k, (n, of, events) in counts.items())
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS t,
    [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM documents),
grams AS (SELECT row, i, array_to_string(w[i : i + 4], chr(10)) AS g FROM d, unnest(range(1, len(w) - 3)) AS u(i)),
twice AS (SELECT row, count(DISTINCT i + k) AS n FROM (SELECT row, i FROM grams QUALIFY count(*) OVER (PARTITION BY row, g) > 1), unnest(range(0, 5)) AS u(k) GROUP BY row),
counts AS (
  SELECT row, doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines
  FROM d LEFT JOIN twice USING (row)),
shares AS ({values}),
buckets AS (SELECT lang, source, measure, CASE WHEN v > 1e-6 THEN ceil(ln(v) / ln(1.01::DOUBLE / 0.99::DOUBLE))::INT END AS bucket, count(*) AS n FROM shares GROUP BY ALL),
ranked AS (
  SELECT *, CASE WHEN bucket IS NULL THEN 0 ELSE 2 * pow(1.01::DOUBLE / 0.99::DOUBLE, bucket) / (1.01::DOUBLE / 0.99::DOUBLE + 1) END AS value,
    sum(n) OVER (PARTITION BY lang, source, measure ORDER BY bucket NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY lang, source, measure) AS total FROM buckets),
levels AS (
  SELECT lang, source, measure, min(value) FILTER (upto >= ceil(total * 0.1)) AS d1, min(value) FILTER (upto >= ceil(total * 0.25)) AS q1,
    min(value) FILTER (upto >= ceil(total * 0.75)) AS q3, min(value) FILTER (upto >= ceil(total * 0.9)) AS d9 FROM ranked GROUP BY ALL),
fences AS (
  SELECT lang, source, measure, CASE WHEN q3 > q1 THEN q1 - 4 * (q3 - q1) ELSE 0.98::DOUBLE * (d1 - 4 * (q1 - d1)) END AS low,
    CASE WHEN q3 > q1 THEN q3 + 4 * (q3 - q1) ELSE 1.02::DOUBLE * (d9 + 4 * (d9 - q3)) END AS high FROM levels),
outside AS (
  SELECT DISTINCT row FROM shares s JOIN fences f ON s.measure = f.measure AND s.lang IS NOT DISTINCT FROM f.lang AND s.source IS NOT DISTINCT FROM f.source
  WHERE x < low * size - events OR x > high * size + events),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND row NOT IN (SELECT row FROM outside) AS kept FROM based"""


ORACLES = {"op1_url_filters": url_filters(), "op4_secret_scans": secret_scans(), "op9_quality_rules": quality_rules(), "op10_decontamination": decontamination()}
