"""Registered catalog-bootstrap queries."""

from __future__ import annotations

from tailorspark import constants as K
from tailorspark.functions.columns import file_extension, slug_id
from tailorspark.operators.bootstrap import bootstrap_catalog, image_listing, unique_ids
from tailorspark.plans.registry import register
from tailorspark.sources.tables import image_files

FILES_SQL = """
SELECT DISTINCT path FROM (
  SELECT unnest([p_name || '.png', p_name || '.jpg', p_name || '_' || CAST(p_size % 3 AS VARCHAR) || '.webp',
                 p_name || '.TXT']) AS path FROM part)"""

STEM_SQL = r"CASE WHEN regexp_matches(f, '^(\.*[^.].*)\.[^.]*$') THEN regexp_extract(f, '^(\.*[^.].*)\.[^.]*$', 1) ELSE f END"
EXT_SQL = r"lower(regexp_extract(f, '^\.*[^.].*(\.[^.]*)$', 1))"
SLUG_SQL = (f"coalesce(nullif(upper(regexp_replace(regexp_replace({STEM_SQL}, '[^a-zA-Z0-9]+', '-', 'g'), "
            "'^-+|-+$', '', 'g')), ''), 'ITEM')")
EXTS = ", ".join(f"'{e}'" for e in K.IMAGE_EXTENSIONS)


def _listing_ctes():
    return [("files", FILES_SQL), ("lst", f"""
SELECT f, {SLUG_SQL} AS base_id FROM (SELECT regexp_extract(path, '([^/]*)$', 1) AS f FROM files)
WHERE {EXT_SQL} IN ({EXTS})"""), ("fam", """
SELECT f, base_id, regexp_replace(base_id, '(-[0-9]+)+$', '') AS family,
       row_number() OVER (PARTITION BY regexp_replace(base_id, '(-[0-9]+)+$', '') ORDER BY f) AS rn FROM lst""")]


def _ids_sql(select: str) -> str:
    ctes = _listing_ctes()
    body = ",\n".join(f"{n} AS (\n{s}\n)" for n, s in ctes)
    return f"""WITH RECURSIVE {body},
seqid(family, rn, f, id, used) AS (
  SELECT family, rn, f, base_id, [base_id] FROM fam WHERE rn = 1
  UNION ALL
  SELECT b.family, b.rn, b.f, x.nid, list_append(r.used, x.nid)
  FROM seqid r JOIN fam b ON b.family = r.family AND b.rn = r.rn + 1,
  LATERAL (SELECT CASE WHEN NOT list_contains(r.used, b.base_id) THEN b.base_id
                       ELSE list_filter(list_transform(range(2, len(r.used) + 3), lambda s: b.base_id || '-' || CAST(s AS VARCHAR)),
                                        lambda x: NOT list_contains(r.used, x))[1] END AS nid) x
)
{select}"""


@register("slug_ids", lambda: "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in _listing_ctes()[:1]) + f"""
SELECT path, {SLUG_SQL.replace('f,', 'path,').replace('(f)', '(path)')} AS slug,
       {EXT_SQL.replace('(f,', '(path,')} AS extension FROM (SELECT path, path AS f FROM files)""")
def q_slug_ids(spark, sf_dir):
    f = image_files(spark, sf_dir)
    return f.select("path", slug_id("path").alias("slug"), file_extension("path").alias("extension"))


@register("unique_ids", lambda: _ids_sql("SELECT f AS filename, id FROM seqid"))
def q_unique_ids(spark, sf_dir):
    return unique_ids(image_listing(image_files(spark, sf_dir)))


@register("catalog_bootstrap", lambda: _ids_sql(f"""
SELECT id, '{K.BOOTSTRAP_PLACEHOLDERS['name']}' AS name, '{K.BOOTSTRAP_PLACEHOLDERS['category']}' AS category,
       CAST({K.BOOTSTRAP_PLACEHOLDERS['price']} AS DOUBLE) AS price, '{K.BOOTSTRAP_PLACEHOLDERS['rating']}' AS rating,
       '{K.IMAGE_URL_PREFIX}' || f AS image_url FROM seqid"""))
def q_catalog_bootstrap(spark, sf_dir):
    c = bootstrap_catalog(image_files(spark, sf_dir))
    return c.select("id", "name", "category", "price", "rating", "image_url")
