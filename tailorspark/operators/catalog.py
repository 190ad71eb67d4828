"""Catalog operators: lookup, categories, seeded product picks, hydration.

(J2, J3, J8, X17, X18, W2, W3, W4, W6.)

Product choice never joins a request to every item of its category: items
are numbered 0..m-1 inside each category in md5(seed|id) order once per
catalog; a request draws a seeded start and reads only the next few
positions, so each module costs at most ``n + |excludes|`` rows per request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailorspark import constants as K
from tailorspark.functions.columns import display_category, recency_category
from tailorspark.operators.partitioning import dense_index
from tailorspark.sources.tables import seed_col

ALL_POOL = "\u0001all"


def seeded_int(*parts, seed: int = K.SEED) -> Column:
    """Non-negative 32-bit integer from md5(seed|parts...) (first 8 hex digits)."""
    return F.conv(F.substring(seed_col(*parts, seed=seed), 1, 8), 16, 10).cast("long")


def dedupe_catalog(catalog: DataFrame) -> DataFrame:
    """Duplicate ids: the last row wins, listed at its first position."""
    cols = [c for c in catalog.columns if c not in ("id", "catalog_pos")]
    return catalog.groupBy("id").agg(
        F.max_by(F.struct(*cols), "catalog_pos").alias("_r"), F.min("catalog_pos").alias("catalog_pos")
    ).select("id", "_r.*", "catalog_pos").withColumn(
        "category", F.coalesce(F.col("category"), F.lit(K.UNKNOWN_CATEGORY)))


def lookup_items(refs: DataFrame, catalog: DataFrame, ref_col: str) -> DataFrame:
    """J2 + X17: resolve a product reference by id, else by the first item with
    that name, else null.  Adds item_id, item_category, item_display_category.

    Both lookup sides are derived from the catalog and grow with it, so no
    broadcast is forced; AQE broadcasts them at run time when they are small.
    """
    items = dedupe_catalog(catalog)
    hit = F.struct(F.col("id").alias("item_id"), F.col("category").alias("item_category"),
                   display_category("display_category", "category").alias("item_display_category"))
    by_id = items.select(F.col("id").alias("_lid"), hit.alias("_hid"))
    by_name = items.groupBy(F.col("name").alias("_lname")).agg(F.min_by(hit, "catalog_pos").alias("_hname"))
    out = refs.join(by_id, refs[ref_col] == by_id["_lid"], "left").drop("_lid")
    out = out.join(by_name, out[ref_col] == by_name["_lname"], "left").drop("_lname")
    return out.withColumn("_hit", F.coalesce("_hid", "_hname")).select(
        *refs.columns, "_hit.item_id", "_hit.item_category", "_hit.item_display_category")


def category_counts(catalog: DataFrame) -> DataFrame:
    """One row per category with its item count ``m``."""
    return dedupe_catalog(catalog).groupBy("category").agg(F.count(F.lit(1)).alias("m"))


def category_dim(catalog_or_counts: DataFrame) -> DataFrame:
    """Categories with cat_index (0-based, by name), m (items), k (categories).

    The index is computed without a single-partition window.
    """
    cats = catalog_or_counts if "m" in catalog_or_counts.columns and "id" not in catalog_or_counts.columns \
        else category_counts(catalog_or_counts)
    if "cat_index" in cats.columns:
        return cats
    cats = dense_index(cats, ["category"], index_col="cat_index")
    return cats.withColumn("k", cats.agg(F.count(F.lit(1))).scalar())


def rank_catalog(catalog: DataFrame, seed: int = K.SEED) -> DataFrame:
    """Items numbered 0..m-1 within their category by md5(seed|id), plus the
    same numbering over the whole catalog under the pool ``ALL_POOL``.

    ``dense_index`` spreads a category holding a third of the catalog over
    many tasks.  Output: pool, pos, m, id.
    """
    items = dedupe_catalog(catalog).select("id", "category", seed_col("id", seed=seed).alias("_h"))
    # every item once in its category pool and once in the whole-catalog pool,
    # numbered in one pass
    both = items.select(F.explode(F.array(F.col("category"), F.lit(ALL_POOL))).alias("pool"), "_h", "id")
    return dense_index(both, ["_h", "id"], ["pool"], index_col="pos", size_col="m").select("pool", "pos", "m", "id")


def pool_sizes(ranked: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(pool, m) for every category pool and the whole-catalog pool."""
    if counts is not None:
        total = counts.agg(F.lit(ALL_POOL).alias("pool"), F.sum("m").alias("m"))
        return counts.select(F.col("category").alias("pool"), F.col("m").cast("long")).unionByName(
            total.select("pool", F.col("m").cast("long")))
    return ranked.groupBy("pool").agg(F.max("m").alias("m"))


def _positions(start: Column, m: Column, count: Column) -> Column:
    """[(start + i) % m for i in 0..count-1], empty when count <= 0."""
    return F.when(count <= 0, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), (count - 1).cast("long")), lambda i: (start + i) % m))


def attach_pool(df: DataFrame, cat_col: str, sizes: DataFrame, prefix: str) -> DataFrame:
    """Pool (the category if the catalog has it, else the whole catalog) and its size."""
    s = sizes.select(F.col("pool").alias(f"{prefix}_p"), F.col("m").alias(f"{prefix}_pm"))
    out = df.join(s, df[cat_col] == F.col(f"{prefix}_p"), "left")
    out = out.withColumn(f"{prefix}_am", sizes.where(F.col("pool") == ALL_POOL).select("m").scalar())
    return out.withColumn(f"{prefix}_pool", F.coalesce(F.col(f"{prefix}_p"), F.lit(ALL_POOL))).withColumn(
        f"{prefix}_m", F.coalesce(F.col(f"{prefix}_pm"), F.col(f"{prefix}_am"))).drop(
        f"{prefix}_p", f"{prefix}_pm", f"{prefix}_am")


def product_picks(df: DataFrame, ranked: DataFrame, cat_col: str, n: int = K.PRODUCTS_PER_MODULE,
                  salt: str = "picks", exclude_col: str | None = None, key: str = "request_id",
                  out_col: str = "products", seed: int = K.SEED,
                  counts: DataFrame | None = None) -> DataFrame:
    """W3 (+ J8): up to ``n`` seeded distinct ids from the category, minus
    excludes; a category absent from the catalog draws from the whole catalog.

    Each request expands only min(m, n + |excludes|) positions, joins them on
    (pool, pos), drops excluded ids and keeps the first ``n`` in draw order.
    """
    sizes = pool_sizes(ranked, counts)
    base = attach_pool(df.select(key, cat_col, *([exclude_col] if exclude_col else [])), cat_col, sizes, "_q")
    excl = F.coalesce(F.col(exclude_col), F.array().cast("array<string>")) if exclude_col else \
        F.array().cast("array<string>")
    m = F.coalesce(F.col("_q_m"), F.lit(0)).cast("long")
    start = F.when(m > 0, seeded_int(F.lit(salt), F.col(key), seed=seed) % m).otherwise(F.lit(0))
    count = F.least(m, F.lit(n) + F.size(excl))
    probes = base.select(key, "_q_pool", excl.alias("_ex"), F.posexplode(_positions(start, m, count)).alias("_i", "pos"))
    hits = probes.join(ranked.select(F.col("pool").alias("_q_pool"), "pos", "id"), ["_q_pool", "pos"])
    hits = hits.where(~F.array_contains("_ex", F.col("id")))
    picked = hits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_i", "id"))).alias("_s"))
    picked = picked.select(key, F.slice(F.transform("_s", lambda s: s["id"]), 1, n).alias(out_col))
    return df.join(picked, key, "left").withColumn(
        out_col, F.coalesce(F.col(out_col), F.array().cast("array<string>")))


def _score_of(recent, best, base: float):
    return F.aggregate(F.transform(recent, lambda x, j: F.when(x == best, F.pow(F.lit(float(base)), j))
                                   .otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)


def recency_winner(df: DataFrame, cats: DataFrame, display_col: str = "recent_display_categories",
                   key: str = "request_id", window: int = K.RECENCY_WINDOW, base: float = K.RECENCY_BASE,
                   out_col: str = "recency") -> DataFrame:
    """W2 core: struct(category, score) of the recency-weighted winner among
    the catalog's categories, or null when no entry is valid.

    The request arrays are exploded, semi-joined to the categories and
    regrouped per request (bounded by the array length).
    """
    ex = df.select(key, F.posexplode(F.coalesce(F.col(display_col), F.array().cast("array<string>")))
                   .alias("_p", "_c")).where(F.col("_c").isNotNull() & (F.col("_c") != ""))
    ex = ex.join(cats.select(F.col("category").alias("_c")), "_c", "left_semi")
    w = ex.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_p", "_c"))).alias("_v"))
    w = w.select(key, F.transform("_v", lambda s: s["_c"]).alias("_valid"))
    w = w.select(key, F.slice("_valid", F.greatest(F.size("_valid") - window + 1, F.lit(1)), window).alias("_rv"))
    out = df.join(w, key, "left")
    best = recency_category("_rv", None, window, base)
    return out.withColumn(out_col, F.when(best.isNotNull(), F.struct(
        best.alias("category"), _score_of(F.col("_rv"), best, base).alias("score")))).drop("_rv")


def target_category(df: DataFrame, cats: DataFrame, display_col: str = "recent_display_categories",
                    key: str = "request_id", out_col: str = "target_category",
                    window: int = K.RECENCY_WINDOW, base: float = K.RECENCY_BASE, seed: int = K.SEED) -> DataFrame:
    """Recency-weighted catalog category, else a seeded random category,
    else 'Unknown' for an empty catalog."""
    out = recency_winner(df, cats, display_col, key, window, base, "_win")
    rnd = seeded_int(F.lit("target"), F.col(key), seed=seed)
    dim = category_dim(cats)
    out = out.withColumn("_k", dim.agg(F.count(F.lit(1))).scalar())
    out = out.withColumn("_ri", F.when(F.col("_k") > 0, rnd % F.col("_k")))
    out = out.join(dim.select(F.col("cat_index").alias("_ri"), F.col("category").alias("_rc")), "_ri", "left")
    return out.withColumn(out_col, F.coalesce(F.col("_win")["category"], F.col("_rc"),
                                              F.lit(K.UNKNOWN_CATEGORY))).drop("_win", "_k", "_ri", "_rc")


def secondary_category(df: DataFrame, cats: DataFrame, target_col: str = "target_category",
                       key: str = "request_id", out_col: str = "secondary_category",
                       seed: int = K.SEED) -> DataFrame:
    """A seeded different category; the target itself when it is the only one.

    With categories sorted by name, target index i and k categories the pick
    is (i + 1 + h mod (k-1)) mod k; a target outside the catalog picks h mod k.
    """
    h = seeded_int(F.lit("secondary"), F.col(key), seed=seed)

    def pick(k, i):
        return (F.when(k == 0, F.lit(None))
                .when(i.isNull(), h % k)
                .when(k == 1, F.lit(None))
                .otherwise((i + 1 + h % (k - 1)) % k)).cast("long")

    cats = category_dim(cats)
    out = df.withColumn("_k", cats.agg(F.count(F.lit(1))).scalar())
    ti = cats.select(F.col("category").alias("_tc"), F.col("cat_index").alias("_ti"))
    out = out.join(ti, out[target_col] == ti["_tc"], "left").drop("_tc")
    out = out.withColumn("_si", pick(F.col("_k"), F.col("_ti")))
    si = cats.select(F.col("cat_index").alias("_si"), F.col("category").alias("_sc"))
    out = out.join(si, "_si", "left")
    return out.withColumn(out_col, F.coalesce("_sc", F.col(target_col))).drop("_k", "_ti", "_si", "_sc")


def module_picks(df: DataFrame, ranked: DataFrame, key: str = "request_id", n: int = K.PRODUCTS_PER_MODULE,
                 seed: int = K.SEED, counts: DataFrame | None = None) -> DataFrame:
    """Hero, primary and secondary picks with one join and one regroup.

    Hero and primary are independent draws of ``n`` from the target pool; the
    secondary draw comes from the secondary pool and must avoid the primary
    picks.  Items of different categories never coincide, so exclusion only
    applies when both pools are the same, and then it is done on positions
    (a position is one item within a pool) before the join.
    """
    sizes = pool_sizes(ranked, counts)
    b = attach_pool(df.select(key, "target_category", "secondary_category"), "target_category", sizes, "_t")
    b = attach_pool(b, "secondary_category", sizes, "_s")
    mt = F.coalesce(F.col("_t_m"), F.lit(0)).cast("long")
    ms = F.coalesce(F.col("_s_m"), F.lit(0)).cast("long")

    def start(salt, m):
        return F.when(m > 0, seeded_int(F.lit(salt), F.col(key), seed=seed) % m).otherwise(F.lit(0))

    hero = _positions(start("hero", mt), mt, F.least(mt, F.lit(n)))
    primary = _positions(start("primary", mt), mt, F.least(mt, F.lit(n)))
    same = F.col("_t_pool") == F.col("_s_pool")
    sec_all = _positions(start("secondary", ms), ms, F.least(ms, F.lit(2 * n)))
    sec = F.slice(F.when(same, F.filter(sec_all, lambda p: ~F.array_contains(primary, p))).otherwise(sec_all), 1, n)

    def tagged(arr, module, pool):
        return F.transform(arr, lambda p, i: F.struct(F.lit(module).alias("module"), i.alias("i"),
                                                      F.col(pool).alias("pool"), p.alias("pos")))

    probes = b.select(key, F.explode(F.concat(tagged(hero, "hero", "_t_pool"), tagged(primary, "primary", "_t_pool"),
                                              tagged(sec, "secondary", "_s_pool"))).alias("_x"))
    probes = probes.select(key, "_x.*")
    hits = probes.join(ranked.select("pool", "pos", "id"), ["pool", "pos"])
    grouped = hits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("module", "i", "id"))).alias("_all"))

    def module(name):
        return F.transform(F.filter("_all", lambda s: s["module"] == name), lambda s: s["id"])

    picked = grouped.select(key, module("hero").alias("hero_products"), module("primary").alias("primary_products"),
                            module("secondary").alias("secondary_products"))
    empty = F.array().cast("array<string>")
    out = df.join(picked, key, "left")
    for c in ("hero_products", "primary_products", "secondary_products"):
        out = out.withColumn(c, F.coalesce(F.col(c), empty))
    return out


def hydrate_products(df: DataFrame, catalog: DataFrame, ids_col: str, key: str = "request_id",
                     limit: int | None = None, out_col: str = "hydrated") -> DataFrame:
    """Ids -> product rows in list order; unknown ids dropped; optional cap
    (the hero shows at most four)."""
    items = dedupe_catalog(catalog).select(F.col("id").alias("_id"), "name", "price", "category", "image_url")
    ex = df.select(key, F.posexplode(ids_col).alias("_pos", "_id"))
    j = ex.join(items, "_id", "inner")
    g = j.groupBy(key).agg(F.sort_array(F.collect_list(
        F.struct("_pos", F.col("_id").alias("id"), "name", "price", "category", "image_url"))).alias("_h"))
    arr = F.transform("_h", lambda s: s.dropFields("_pos"))
    if limit is not None:
        arr = F.slice(arr, 1, limit)
    g = g.select(key, arr.alias(out_col))
    return df.join(g, key, "left")


def products_by_category(catalog: DataFrame, categories: DataFrame, cat_col: str = "category") -> DataFrame:
    """Catalog items whose category is one of ``categories``: every listed row, repeated ids included."""
    wanted = categories.select(F.col(cat_col).alias("category")).distinct()
    listed = catalog.withColumn("category", F.coalesce("category", F.lit(K.UNKNOWN_CATEGORY)))
    return listed.join(wanted, "category", "left_semi")
