"""Dense numbers and unique ids at sizes where sampled ranges would differ between readers."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tailorspark.operators import bootstrap
from tailorspark.operators.bootstrap import unique_ids
from tailorspark.operators.partitioning import dense_index, range_buckets


@pytest.mark.parametrize("reuse", ["true", "false"])
@pytest.mark.parametrize("parts,buckets", [(4, None), (4, 10), (64, 100)])
def test_dense_index_with_payload_and_hot_group(spark, parts, buckets, reuse):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.exchange.reuse")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        df = spark.range(400_000).select(
            F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None)
            .otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"),
            F.md5(F.col("id").cast("string")).alias("k"), F.concat(F.lit("payload"), "id").alias("p"))
        got = dense_index(df, ["k"], ["g"], size_col="m", buckets=buckets)
        w = Window.partitionBy("g")
        want = F.row_number().over(w.orderBy("k")) - 1
        bad = got.withColumn("want", want).withColumn("size", F.count(F.lit(1)).over(w)) \
            .agg(F.count(F.lit(1)), F.sum(F.when((F.col("pos") != F.col("want")) | (F.col("m") != F.col("size")), 1))).first()
        assert tuple(bad) == (400_000, None)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("buckets", [10, 1000])
def test_buckets_are_even(spark, buckets):
    """One hot group, numbers of very uneven density: no bucket above twice the mean."""
    df = spark.range(300_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("g"),
                                     F.pow(F.col("id"), 4.0).alias("k"))
    sizes = range_buckets(df, ["g", "k"], buckets).groupBy("_bucket").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 2 * 300_000 / buckets and sizes[1] >= 0.9 * buckets


def test_dense_index_without_groups_equal_rows_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(x,) for x in [3, None, 1, 3, None, 2]], "x int")
    for buckets in (None, 3):
        got = sorted(tuple(r) for r in dense_index(df, ["x"], size_col="n", buckets=buckets).select("pos", F.coalesce(
            "x", F.lit(-1)), "n").collect())
        assert got == [(0, -1, 6), (1, -1, 6), (2, 1, 6), (3, 2, 6), (4, 3, 6), (5, 3, 6)]
        assert dense_index(df.where("x > 9"), ["x"], buckets=buckets).count() == 0


def one_by_one(names):
    """{filename: id}, taking ids in filename order."""
    taken, out = set(), {}
    for f, base in sorted(names):
        tries = [base] + [f"{base}-{k}" for k in range(2, len(names) + 3)]
        out[f] = next(t for t in tries if t not in taken)
        taken.add(out[f])
    return out


@pytest.mark.parametrize("seed", range(5))
def test_unique_ids_against_one_by_one(spark, seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(bootstrap, "CHAIN", 3)  # chains of several pieces
    rng = random.Random(seed)
    names = []
    for k in range(400):
        base = rng.choice("AB") + "".join(f"-{rng.choice([1, 2, 2, 3, 4, 5, 7, 10, 12])}" for _ in range(rng.randint(0, 3)))
        names.append((f"{rng.random():.6f}-{k}.png", base))
    got = unique_ids(spark.createDataFrame(names, "filename string, base_id string"))
    assert {r["filename"]: r["id"] for r in got.collect()} == one_by_one(names)


def test_unique_ids_of_camera_names(spark):
    """Paired names and a numbered series: only real conflicts are settled by name."""
    pairs = spark.range(60_000).select(F.concat(F.lit("n"), "id", F.lit(".jpg")).alias("filename"),
                                       F.concat(F.lit("N"), "id").alias("base_id"))
    df = pairs.union(pairs.select(F.regexp_replace("filename", "jpg", "png"), "base_id"))
    series = spark.range(60_000).select(F.format_string("IMG_%05d.jpg", "id"), F.format_string("IMG-%05d", "id"))
    df = df.union(series).union(spark.createDataFrame([("IMG.jpg", "IMG"), ("IMG.png", "IMG")], df.schema))
    got = unique_ids(df)
    assert got.count() == got.select("id").distinct().count() == 180_002
    suffix = got.where("filename like 'n%'").select(F.regexp_extract("id", r"(-\d+)?$", 0).alias("s")).groupBy("s").count()
    assert {r["s"]: r["count"] for r in suffix.collect()} == {"": 60_000, "-2": 60_000}
    assert {r["filename"]: r["id"] for r in got.where("filename like 'IMG.%'").collect()} == {"IMG.jpg": "IMG", "IMG.png": "IMG-2"}


def test_pieces_of_a_chain_equal_one_by_one():
    rng = random.Random(7)
    for _ in range(500):
        limits = [rng.randint(-2, 14) for _ in range(rng.randint(0, 12))]
        met = bootstrap._merged_starts(limits)
        for start in range(18):
            p = start
            for limit in limits:
                p += p < limit
            assert p == start + sum(b >= start for b in met)


def test_unique_ids_of_one_stem(spark):
    """Half of the names repeat a slug, half are its own numbered names; pieces of the chain hold a bounded part."""
    n = 20_000
    repeats = spark.range(n).select(F.format_string("a%06d.png", "id").alias("filename"), F.lit("X").alias("base_id"))
    numbered = spark.range(n).select(F.format_string("%s%06d.jpg", F.when(F.col("id") % 2 == 0, "a").otherwise("b"), "id"),
                                     F.concat(F.lit("X-"), (F.col("id") * 3 % n + 2).cast("string")))
    rows = [(r[0], r[1]) for r in repeats.union(numbered).collect()]
    got = {r["filename"]: r["id"] for r in unique_ids(repeats.union(numbered)).collect()}
    taken, want, last = set(), {}, {}
    for f, base in sorted(rows):  # one by one, the counter of a slug never goes back
        name, k = base, last.get(base, 2)
        while name in taken:
            name, k = f"{base}-{k}", k + 1
        last[base] = k if name != base else 2
        taken.add(name)
        want[f] = name
    assert got == want
