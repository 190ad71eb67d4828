import collections
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tailorspark.llm import quality_rank, quality_rules
from tailorspark.llm.queries import op8_quality_rank
from tailorspark.llm.textstats import COUNTS, measure
from util import docs, rows


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    repeat = {k + s for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for s in range(3)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(repeat),
            len(set(w)), len(re.findall("[A-Z]", t)), len(re.findall("[A-Za-z]", t)), len(re.findall("[0-9]", t)),
            len(re.findall("[!?]", t))]


def texts():
    rng = random.Random(2)
    parts = ["a", "b", "é😀", "X", " ", " ", "\n", "\n", "\r\n", "\t", "#", "<", "9", "!", "\x0b", "\xa0", "foo bar baz "]
    return [None, "", "\n\n", "a a a a", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(400))]


def test_counts_against_brute_force():
    assert measure(texts()).tolist() == [brute(t) for t in texts()]


def test_ledger_policies_and_edge_cases(spark):
    good = " ".join(f"word{k}" for k in range(80))
    table = docs(spark, [good, None, "", "*** " + good + " ###" * 30, good.upper(), good, "bla " * 100],
                 ids=[0, 1, 2, 3, 4, 0, 6]).withColumn("failed", F.lit("x"))
    out = quality_rules.ledger(table)
    kept = out.select("doc_id", (~quality_rules.rejects(F.col("failed"), "v1")).alias("v1"),
                      (~quality_rules.rejects(F.col("failed"), "v2")).alias("v2"))
    assert rows(kept) == [(0, True, True), (0, True, True), (1, False, False), (2, False, False), (3, True, False),
                          (4, True, False), (6, False, False)]
    assert quality_rules.ledger(docs(spark, [])).count() == 0


def test_ablation_counts(spark):
    few, rep, sym = (quality_rules.policy_mask([r]) for r in ("few_words", "repeated_words", "symbols"))
    ledger = spark.createDataFrame([(x,) for x in [0, 0, few, few | rep, sym, sym, few | sym]], "failed long")
    got = {r["rule"]: (r["failing"], r["only"], r["kept_without"]) for r in quality_rules.ablation(ledger).collect()}
    assert (got["few_words"], got["repeated_words"], got["symbols"]) == ((3, 1, 3), (1, 0, 2), (3, 2, 4))
    got = {r["rule"]: r["only"] for r in quality_rules.ablation(ledger, "v1").collect()}
    assert got == {"few_words": 2, "repeated_words": 0}


def test_rank_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    found = op8_quality_rank(spark, sf).where("held_out").join(labels, "doc_id")
    assert found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.95


def test_rank_edge_cases(spark):
    table = docs(spark, ["fine words here"] * 3 + ["### ***"] * 3 + [None, ""])
    labels = spark.createDataFrame([(0, 1), (1, 1), (3, 0), (4, 0), (3, 0), (None, 1), (99, 1), (5, None)],
                                   "doc_id long, quality int")
    ranker = quality_rank.fit(table, labels, F.lit(True))
    got = dict(rows(quality_rank.score(table, ranker)))
    assert got[2] >= quality_rank.CUT > got[5] and all(0 <= s <= 1 for s in got.values()) and len(got) == 8
    assert quality_rank.fit(table, labels.where("quality = 1"), F.lit(True)) is None
    assert rows(quality_rank.score(table, None), "score") == [(0.5,)] * 8
    assert quality_rank.score(docs(spark, []), ranker).count() == 0


def test_cut_follows_all_labels_not_the_sample(spark):
    """One label in ten is 1; the sample holds as many rows of both."""
    rng = np.random.default_rng(4)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "do"]

    def text(good):
        w = [words[k] for k in rng.integers(0, 8, int(rng.integers(60, 120)))]
        return " ".join(w) if good else " ".join(x if k % int(rng.integers(2, 9)) else "#$%" for k, x in enumerate(w))

    kinds = [i % 10 == 0 for i in range(3000)]
    frame = docs(spark, [text(k) for k in kinds])
    labels = spark.createDataFrame([(i, int(k), 0) for i, k in enumerate(kinds)], "doc_id long, quality int, toxic int")
    ranker = quality_rank.fit(frame, labels, F.lit(True), rows=200)
    share = quality_rank.score(frame, ranker).where(F.col("score") >= quality_rank.CUT).count() / 3000
    assert 0.07 <= share <= 0.13


def test_a_repeated_document_is_learned_from_once(spark):
    texts = ["a b c d e f " * 12, "# $ % # $ %"] + ["a b c d e f " * 12] * 30
    frame = docs(spark, texts, ids=[1, 2] + [1] * 30)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    ranker = quality_rank.fit(frame, labels, F.lit(True))
    got = {r["doc_id"]: r["score"] for r in quality_rank.score(frame, ranker).collect()}
    assert got[1] > quality_rank.CUT > got[2]


def test_every_labelled_document_is_learned_from(spark):
    texts = ["plain words of some length " * (i + 1) for i in range(30)] + ["# $ % " * (i + 1) for i in range(30)]
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    few, many = (quality_rank.fit(docs(spark, texts), labels, F.lit(True), rows=n) for n in (7, 1000))
    assert np.allclose(few.mean, quality_rank.features(texts).mean(0))
    assert np.allclose(few.weights, many.weights) and np.isclose(few.cut, many.cut)
    strengths = np.sort(((quality_rank.features(texts) - few.mean) / few.scale) @ few.weights)
    assert strengths[29] < few.cut < strengths[30]
