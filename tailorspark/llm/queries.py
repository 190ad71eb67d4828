"""The registered queries: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailorspark.llm import (
    bpe, decontaminate, divergence, html_extract, jaccard_join, langid, license_scan, periodic_runs, quality_rank,
    quality_rules, secret_scan, token_files, url_filter)
from tailorspark.llm.sql import ORACLES  # noqa: F401  (read by the entry module)
from tailorspark.llm.store import id_bucket
from tailorspark.session import scratch_dir

#: Id that ends a document in the token files.
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizers():
    import public_tokenizers
    return public_tokenizers


def op1_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "tokens")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, _tokenizers().path("byte_bpe_50k.json"), END_ID,
                             added_tokens=True)
    place = token_files.read_metadata(spark, path).select("part", "row", "doc_id", "start")
    sums = token_files.checksums(token_files.read_tokens(spark, path))
    return place.join(sums, ["part", "row"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def bpe_digests(coded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
                        F.sha2("data", 256).alias("decoded_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokenizers()
    return bpe_digests(bpe.round_trip(_table(spark, sf_dir, "documents"), t.path("byte_bpe_50k.tiktoken"), t.PATTERN))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = id_bucket(F.col("doc_id"), 3) == 1
    found = langid.identify(docs.select("doc_id", "text"), langid.fit_dictionaries(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       quality_rules.rejects(F.col("failed"), "v1").alias("base_failed"),
                       (~quality_rules.rejects(F.col("failed"), quality_rules.CURRENT)).alias("kept"), "failed")


def files_view(docs: DataFrame) -> DataFrame:
    """Documents as files of repositories: a source is a repository, its directories are
    ``<lang>/<hundreds of doc_id>``, and a document that begins with a licence cue in its
    first line stands for a licence file of its directory.
    """
    name = F.when(F.split("text", "\n")[0].rlike(license_scan.CUE), F.concat(F.lit("LICENSE-"), F.col("doc_id"))) \
        .otherwise(F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("lang", F.lit("any")), F.floor(F.col("doc_id") / 100).cast("string"), name)
    return docs.select("doc_id", F.col("source").alias("repo"), path.alias("path"), "text")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(files_view(_table(spark, sf_dir, "documents")))
    return found.select("doc_id", "path", "own_license", "own_cosine", "inherited_license", "inherited_from", "license")


def op8_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = id_bucket(F.col("doc_id"), 4) == 2
    found = quality_rank.score(docs, quality_rank.fit(docs, labels, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score",
                        (F.col("score") >= quality_rank.CUT).cast("int").alias("predicted"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = of(*secret_scan.BASE)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


#: Host rules of ``op12``: action, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [*(url_filter.host_rule(*r) for r in URL_RULES), *url_filter.GENERAL]
    found = url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return found.select("page_id", "host", "path", "rule", "verdict", "pattern")


def repeating_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in every tenth document (by crc32 of doc_id) the words from a place on repeat a few of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all(
        F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("words"))
    g = F.floor(F.col("h") / 10)
    sized = chosen.withColumn("n", F.greatest(F.size("words"), F.lit(0)).cast("long"))
    at = sized.withColumn("a", g % F.nullif("n", F.lit(0)))
    at = at.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    place = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.when(
        i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    words = F.transform(place, lambda i: F.get("words", i.cast("int")))
    return at.select("doc_id", F.when(F.col("n") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(repeating_tails(_table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(
        "", r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"),
        F.lit("\n")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = found.withColumn("longest", longest)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), "longest.length",
        (-F.col("longest.period")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_html_wrappers": op1_html_wrappers,
    "op2_token_files": op2_token_files,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_language_id": op4_language_id,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_quality_rules": op6_quality_rules,
    "op7_license_scan": op7_license_scan,
    "op8_quality_rank": op8_quality_rank,
    "op9_secret_scan": op9_secret_scan,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_source_divergence": op11_source_divergence,
    "op12_url_filter": op12_url_filter,
    "op13_periodic_runs": op13_periodic_runs,
}

