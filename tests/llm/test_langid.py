import pytest
from pyspark.sql import functions as F

from tailorspark.llm import langid
from tailorspark.llm.queries import op4_language_id
from util import docs, rows

EN = "the quick brown fox jumps over the lazy dog while the other dogs were watching from their houses "
DE = "der schnelle braune Fuchs springt über den faulen Hund während die anderen Hunde zuschauen und schlafen "


@pytest.fixture(scope="module")
def fitted(spark):
    table = docs(spark, [EN] * 3 + [DE] * 3 + [None, "no label"], langs=["en"] * 3 + ["de"] * 3 + ["en", None])
    return langid.fit_dictionaries(table, F.lit(True))


def test_fit_needs_label_and_text(fitted):
    assert sorted(fitted) == ["de", "en"]


def test_prediction_and_edge_cases(spark, fitted):
    table = docs(spark, ["the other dogs were lazy", "die anderen Hunde schlafen", None, "", "12 34 ***", EN * 400])
    got = {r["doc_id"]: r for r in langid.identify(table, fitted).collect()}
    assert [got[i]["lang_pred"] for i in range(6)] == ["en", "de", "und", "und", "und", "en"]
    assert all(got[i]["rejected"] and got[i]["score"] == 0 for i in (2, 3, 4))
    assert not got[0]["rejected"] and 0 < got[0]["score"] <= 1


def test_tie_is_rejected(spark, fitted):
    r = langid.identify(docs(spark, ["zzz"]), {"b": b"xyxy" * 30, "a": b"xyxy" * 30}).first()
    assert (r["lang_pred"], r["margin"], r["rejected"]) == ("a", 0.0, True)


def test_repeated_rows_clashing_columns_empty_table(spark, fitted):
    table = docs(spark, [EN, EN], ids=[1, 1]).withColumn("score", F.lit("mine"))
    out = langid.identify(table, fitted)
    assert out.count() == 2 and dict(out.dtypes)["score"] == "double"
    assert langid.identify(docs(spark, []), fitted).count() == 0
    assert langid.fit_dictionaries(docs(spark, []), F.lit(True)) == {}
    assert langid.identify(docs(spark, [EN]), {}).first()["lang_pred"] == "und"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = op4_language_id(spark, sf).where("held_out").join(truth, "doc_id")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


def test_a_repeated_document_is_learned_from_once(spark):
    table = docs(spark, [EN] * 40 + [DE], ids=[7] * 40 + [None], langs=["en"] * 40 + ["de"])
    content = langid.fit_dictionaries(table, F.lit(True))
    assert list(content) == ["en"] and len(content["en"]) < len(EN)


def test_every_sampled_row_is_in_the_dictionary(spark):
    long = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(400))
            for i in range(400)]
    content = langid.fit_dictionaries(docs(spark, long), F.lit(True))["en"]
    assert langid.SAMPLE_ROWS * langid.SAMPLE_BYTES <= len(content) <= 1 << 18
