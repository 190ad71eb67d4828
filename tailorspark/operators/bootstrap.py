"""Catalog rows from an image listing.

Ids follow the rule "the slug; if taken, the first free slug-2, slug-3, ...",
in filename order.  Only two kinds of names meet:

* items of one slug, which after the first take suffixes in turn;
* a literal slug ``X-j`` and the j-th suffix of a slug ``X`` that gives out suffixes.

Suffixes of X are given out in ascending order, so its m-th suffixed item gets
``m + 1`` plus the number of literals passed on the way.  A literal j is passed
(keeps its name) if it comes before the item that would take j, else it is
displaced and takes suffixes of its own name.  With c items of X before the literal
in filename order and p smaller literals passed, that is ``p < j - 1 - c``.

Everything that can be counted is counted by sorting (``dense_index``): places of items
and literals, c from the merged sequence of both, numbers skipped from the merged
sequence of items and passed literals.  What is left is the chain of p over the literals of
a stem, one comparison each.  Pieces of ``CHAIN`` literals are first reduced to the function
from p before the piece to p after it, the functions are applied one after another, and then
all pieces are settled at once from their starts.  Whether X itself is displaced (a literal of
a shorter stem) moves its items by one; both cases are settled, and every literal looks up its
own line of stems, so nested names take no further rounds.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailorspark import constants as K
from tailorspark.functions.columns import file_extension, slug_id
from tailorspark.operators.partitioning import dense_index
from tailorspark.session import stored

#: Literals of a stem that one task settles.
CHAIN = 20_000


def image_listing(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Keep image files (extension check is case-insensitive); add filename and slug."""
    name = F.regexp_extract(F.col(path_col), r"([^/]*)$", 1)
    out = files.select(name.alias("filename"))
    out = out.where(file_extension("filename").isin(*K.IMAGE_EXTENSIONS))
    return out.withColumn("base_id", slug_id("filename"))


#: A slug that could be the j-th suffix of another: its stem and j (2 or more, as generated, at most 18 digits).
_SUFFIXED = r"^(.*)-([2-9]|[1-9][0-9]{1,17})$"


# -- the chain of passed literals ------------------------------------------------
def _merged_starts(limits: list[int]) -> list[int]:
    """How a piece of the chain ends for every start: with ``F(p) = p + (numbers b of the result with b >= p)``.

    Each literal lets p grow by one below its limit, so the two starts that stand at
    ``limit - 1`` and ``limit`` meet; b is the lower of two neighbours that met.
    """
    met: list[int] = []
    for limit in limits:
        free = limit - 1 - len(met)  # the place among neighbours that have not met
        if free >= 0:
            i = bisect_right(range(len(met)), free, key=lambda k: met[k] - k)
            met.insert(i, free + i)
    return met


def _reduced(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("below")
    limits = [(rows["j"] - 1 - rows[c]).tolist() for c in ("c_free", "c_displaced")]
    return pd.DataFrame({"stem": rows["stem"].iloc[:1], "piece": rows["piece"].iloc[:1],
                         "free": [_merged_starts(limits[0])], "displaced": [_merged_starts(limits[1])]})


def _starts(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("piece")
    out = {"stem": rows["stem"], "piece": rows["piece"]}
    for case in ("free", "displaced"):
        p, start = 0, []
        for met in rows[case]:
            start.append(p)
            p += len(met) - int(np.searchsorted(met, p))
        out[f"p_{case}"] = start
    return pd.DataFrame(out)


def _settled(rows: pd.DataFrame) -> pd.DataFrame:
    """Which literals of a piece keep their names, if their stem is not displaced and if it is."""
    rows = rows.sort_values("below")
    out = rows[["stem", "j", "slug"]].copy()
    for case in ("free", "displaced"):
        p, keeps = int(rows[f"p_{case}"].iloc[0]), []
        for limit in (rows["j"] - 1 - rows[f"c_{case}"]).tolist():
            keeps.append(p < limit)
            p += keeps[-1]
        out[f"keeps_{case}"] = keeps
    return out


def _chains(literals: DataFrame) -> DataFrame:
    """(stem, j, slug, keeps_free, keeps_displaced) of every literal.

    ``literals``: stem, j, slug, ``below`` (its place among the stem's), ``c_free`` and ``c_displaced``.
    """
    pieces = stored(literals.withColumn("piece", F.floor(F.col("below") / CHAIN)), "pieces")
    longer = pieces.where("piece > 0").select("stem").distinct()
    reduced = pieces.join(longer, "stem", "left_semi").groupBy("stem", "piece").applyInPandas(
        _reduced, "stem string, piece long, free array<long>, displaced array<long>")
    # 8 bytes for each literal of a stem with several pieces
    starts = reduced.groupBy("stem").applyInPandas(_starts, "stem string, piece long, p_free long, p_displaced long")
    begun = pieces.join(starts, ["stem", "piece"], "left").fillna(0, ["p_free", "p_displaced"])
    return begun.groupBy("stem", "piece").applyInPandas(
        _settled, "stem string, j long, slug string, keeps_free boolean, keeps_displaced boolean")


def _keeps(chains: DataFrame) -> DataFrame:
    """(slug, stem, j, keeps): every literal by the line of literals that its name is made of."""
    words = F.split("slug", "-")
    lines = chains.select("slug", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.size(words) - 1),
        lambda i: F.array_join(F.slice(words, 1, F.size(words) - i), "-"))).alias("up", "above"))
    lines = lines.where(F.col("above").rlike(_SUFFIXED))
    found = lines.join(chains.select(F.col("slug").alias("above"), "keeps_free", "keeps_displaced"), "above")
    line = found.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct(
        "up", "keeps_free", "keeps_displaced"))).alias("line"))
    # literals without a gap from the slug itself up; the one above them is not displaced
    unbroken = F.reverse(F.filter("line", lambda x, i: x["up"] == i))
    displaced = F.aggregate(unbroken, F.lit(False), lambda d, x: ~F.when(d, x["keeps_displaced"]).otherwise(x["keeps_free"]))
    return chains.select("slug", "stem", "j").join(line.select("slug", (~displaced).alias("keeps")), "slug")


def unique_ids(listing: DataFrame) -> DataFrame:
    """Filename -> unique id (see module docstring)."""
    items = stored(dense_index(listing.select("filename", "base_id"), ["filename"], ["base_id"]), "items")
    slugs = items.groupBy("base_id").agg(F.count(F.lit(1)).alias("n"), F.min("filename").alias("first"))
    slugs = stored(slugs.withColumns({"stem": F.regexp_extract("base_id", _SUFFIXED, 1),
                                      "j": F.nullif(F.regexp_extract("base_id", _SUFFIXED, 2), F.lit("")).cast("long")}), "slugs")
    stems = slugs.select(F.col("base_id").alias("stem"), F.col("n").alias("stem_n"))
    literals = slugs.where("j is not null").join(stems, "stem").select(
        "stem", "j", F.col("base_id").alias("slug"), "first", "stem_n")
    # of a stem's literals only those that its suffixes come to if all before are passed (all its items, if it is displaced)
    reached = dense_index(literals, ["j"], ["stem"], index_col="below").where("j - 1 - below <= stem_n").drop("stem_n")
    reached = stored(reached, "reached")
    # items of the stem before a literal: its place among both kinds less its place among literals
    named = items.select(F.col("base_id").alias("stem"), F.col("filename").alias("name"), F.lit(0).alias("kind"),
                         F.lit(None).cast("long").alias("j")).join(reached.select("stem").distinct(), "stem", "left_semi")
    firsts = reached.select("stem", F.col("first").alias("name"), F.lit(1).alias("kind"), "j")
    merged = dense_index(named.union(firsts), ["name", "kind"], ["stem"], index_col="place").where("kind = 1")
    alone = dense_index(firsts, ["name"], ["stem"], index_col="among")
    before = merged.select("stem", "j", "place").join(alone.select("stem", "j", "among"), ["stem", "j"]).select(
        "stem", "j", (F.col("place") - F.col("among")).alias("c_displaced"))
    counted = reached.join(before, ["stem", "j"]).withColumn("c_free", F.greatest(F.lit(0), F.col("c_displaced") - 1))
    settled = stored(_keeps(stored(_chains(counted), "chains")), "settled")
    displaced = settled.where("not keeps").select(F.col("slug").alias("base_id"), F.lit(0).alias("p"))
    suffixed = items.join(displaced, "base_id", "left").withColumn(
        "m", F.col("pos") + 1 - F.coalesce("p", F.lit(1))).drop("p", "pos")
    # the i-th passed literal is behind every suffixed item from number j - 1 - i on
    passed = dense_index(settled.where("keeps").select(F.col("stem").alias("base_id"), "j"), ["j"], ["base_id"], index_col="i")
    passed = passed.select("base_id", (F.col("j") - 1 - F.col("i")).alias("m"), F.lit(0).alias("kind"),
                           F.lit(None).cast("string").alias("filename"))
    asked = suffixed.where("m >= 1").join(passed.select("base_id").distinct(), "base_id", "left_semi").select(
        "base_id", "m", F.lit(1).alias("kind"), "filename")
    skips = dense_index(passed.union(asked), ["m", "kind"], ["base_id"], index_col="place").where("kind = 1").select(
        "base_id", "m", (F.col("place") - (F.col("m") - 1)).alias("skipped"))
    out = suffixed.join(skips, ["base_id", "m"], "left")
    return out.select("filename", F.when(F.col("m") < 1, F.col("base_id")).otherwise(F.concat(
        "base_id", F.lit("-"), (F.col("m") + 1 + F.coalesce("skipped", F.lit(0))).cast("string"))).alias("id"))


def bootstrap_catalog(files: DataFrame, path_col: str = "path") -> DataFrame:
    """S3: one placeholder catalog row per image, ids made unique."""
    ids = unique_ids(image_listing(files, path_col))
    p = K.BOOTSTRAP_PLACEHOLDERS
    return ids.select(
        "id",
        F.lit(p["name"]).alias("name"), F.lit(p["brand"]).alias("brand"), F.lit(p["category"]).alias("category"),
        F.lit(p["display_category"]).alias("display_category"), F.lit(p["price"]).alias("price"),
        F.lit(p["original_price"]).alias("original_price"), F.lit(p["discount"]).alias("discount"),
        F.lit(p["rating"]).alias("rating"),
        F.concat(F.lit(K.IMAGE_URL_PREFIX), F.col("filename")).alias("image_url"),
        F.lit(p["description"]).alias("description"),
        "filename",
    )
