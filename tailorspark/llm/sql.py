"""DuckDB statements of the ``opN_*`` queries that SQL can express."""

from __future__ import annotations

from tailorspark.llm import license_scan, quality_rules, url_filter

#: [\x20\x09-\x0D] and the words between.
_WORD = r"[^\x20\x09-\x0D]+"


def _op6() -> str:
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << r} ELSE 0 END" for r, (_, rule) in enumerate(quality_rules.RULES))
    base, kept = (quality_rules.policy_mask(quality_rules.POLICIES[p]) for p in ("v1", quality_rules.CURRENT))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
p AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c
      FROM (SELECT r, i, w FROM p)),
c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) AS s(k) WHERE c > 1 GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(list_distinct(w))::BIGINT AS n_distinct_words,
             len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_upper, len(regexp_extract_all(t, '[A-Za-z]'))::BIGINT AS n_letters,
             len(regexp_extract_all(t, '[0-9]'))::BIGINT AS n_digits, len(regexp_extract_all(t, '[!?]'))::BIGINT AS n_marks
      FROM w LEFT JOIN c USING (r)),
f AS (SELECT *, ({bits})::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & {base}) <> 0 AS base_failed, (failed & {kept}) = 0 AS kept, failed FROM f"""


def _op7() -> str:
    n = len(license_scan.TEMPLATES)
    rows = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(license_scan.TEMPLATES))
    terms = (r"list_filter(list_transform(regexp_split_to_array(lower({0}), '[^0-9a-z.+]+'), "
             r"lambda x: regexp_replace(x, '^[.]+|[.]+$', '', 'g')), lambda x: x <> '')").format
    cue = license_scan.CUE
    return rf"""
WITH t(template, license, text) AS (VALUES {rows}),
tt AS (SELECT template, license, unnest({terms("text")}) AS term FROM t),
tf AS (SELECT template, license, term, count(*) AS tf FROM tt GROUP BY ALL),
idf AS (SELECT term, ln({n + 1}.0 / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY term),
tw AS (SELECT template, license, term, tf * idf AS w FROM tf JOIN idf USING (term)),
tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tw GROUP BY template),
v AS (SELECT template, license, term, w / norm AS weight FROM tw JOIN tn USING (template)),
f AS (SELECT doc_id, text, source AS repo, coalesce(lang, 'any') || '/' || CAST(doc_id // 100 AS VARCHAR) AS dir,
             regexp_matches(string_split(text, chr(10))[1], '{cue}') AS whole FROM documents),
u AS (SELECT DISTINCT doc_id, unnest(list_concat(
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{cue}')),
             CASE WHEN whole THEN [text] ELSE [] END)) AS notice FROM f),
us AS (SELECT doc_id, notice FROM u WHERE contains(notice, chr(10)) OR NOT regexp_matches(notice, '{license_scan.NEGATED}')),
nt AS (SELECT notice, unnest({terms("notice")}) AS term FROM (SELECT DISTINCT notice FROM us)),
nw AS (SELECT notice, term, count(*) * coalesce(any_value(idf), ln({n + 1}.0) + 1) AS w
       FROM nt LEFT JOIN idf USING (term) GROUP BY notice, term),
nn AS (SELECT notice, sqrt(sum(w * w)) AS norm FROM nw GROUP BY notice),
dot AS (SELECT notice, template, license, sum(w * weight) AS dot FROM nw JOIN v USING (term) GROUP BY ALL),
cs AS (SELECT notice, license, round(dot / norm, 6) AS cosine FROM dot JOIN nn USING (notice)),
cl AS (SELECT notice, license, cosine FROM cs
       QUALIFY row_number() OVER (PARTITION BY notice ORDER BY cosine DESC, license) = 1),
own AS (SELECT doc_id, license AS own_license, cosine AS own_cosine FROM us JOIN cl USING (notice)
        WHERE cosine >= {license_scan.MIN_COSINE}
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license) = 1),
held AS (SELECT repo, dir AS up, list_sort(list(DISTINCT own_license)) AS held
         FROM f JOIN own USING (doc_id) WHERE whole GROUP BY repo, dir),
up AS (SELECT DISTINCT repo, dir, a.k AS k, CASE a.k WHEN 0 THEN dir WHEN 1 THEN string_split(dir, '/')[1] ELSE '' END AS up
       FROM f, (VALUES (0), (1), (2)) AS a(k)),
near AS (SELECT repo, dir, array_to_string(held, ' AND ') AS inherited_license, up AS inherited_from
         FROM up JOIN held USING (repo, up) QUALIFY row_number() OVER (PARTITION BY repo, dir ORDER BY k) = 1)
SELECT doc_id, dir || '/' || CASE WHEN whole THEN 'LICENSE-' || CAST(doc_id AS VARCHAR)
                                  ELSE 'doc-' || CAST(doc_id AS VARCHAR) || '.txt' END AS path,
       own_license, own_cosine, inherited_license, inherited_from, coalesce(own_license, inherited_license) AS license
FROM f LEFT JOIN own USING (doc_id) LEFT JOIN near USING (repo, dir)"""


def _op10() -> str:
    words = (r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')").format
    return rf"""
WITH i AS (SELECT item_id, {words("text")} AS w FROM benchmark),
x AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, w[k:k + least(len(w), 13) - 1] AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS w FROM documents),
z AS (SELECT DISTINCT n FROM x),
o AS (SELECT r, n, k, w[k:k + n - 1] AS g
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, z WHERE len(w) >= n)),
h AS (SELECT r, k, n, item_id FROM o JOIN x USING (n, g)),
c AS (SELECT r, count(DISTINCT p) AS n_hit
      FROM (SELECT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, k, n FROM h)) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN s USING (r)"""


def _op11() -> str:
    return r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  coalesce(text, '') AS t FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS MATERIALIZED (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(regexp_extract_all(
        translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term FROM w GROUP BY lang, term HAVING count(*) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, sum(n) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, k.term, coalesce(c.n, 0)::HUGEINT AS n
      FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v)::HUGEINT AS p
      FROM n JOIN v USING (lang)),
t AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM n GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v)::HUGEINT AS q
      FROM t JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
y AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
      FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM x UNION ALL SELECT * FROM y) QUALIFY part = 'pair' OR rank <= 10"""


def _op12() -> str:
    patterns = ", ".join(f"('{r.name}', '{r.regex}')" for r in url_filter.GENERAL)
    return rf"""
WITH a AS (SELECT row_number() OVER () AS r, page_id,
                  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*[^?#]*(.*)$', 1) AS rest FROM pages),
l(action, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                           ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
b AS (SELECT r, h || p AS rule, action FROM a JOIN l
      ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
      QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC) = 1),
t(pattern, regex) AS (VALUES {patterns}),
m AS (SELECT r, min(pattern) AS pattern FROM a JOIN t ON regexp_matches(host || path || rest, regex) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN rule IS NULL THEN pattern END AS pattern
FROM a LEFT JOIN b USING (r) LEFT JOIN m USING (r)"""


ORACLES: dict[str, str] = {
    "op6_quality_rules": _op6(),
    "op7_license_scan": _op7(),
    "op10_benchmark_decontamination": _op10(),
    "op11_source_divergence": _op11(),
    "op12_url_filter": _op12(),
}
