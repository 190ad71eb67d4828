"""The pipeline's decisions on a small corpus."""

import hashlib

import pytest

import corpus_pipeline
from util import docs, rows

EN = "the quick brown fox jumps over the lazy dog while other dogs were watching from their houses number"
DE = "der schnelle braune Fuchs springt über den faulen Hund während die anderen Hunde zuschauen und schlafen Nummer"


def long(base, k, n=60):
    return base + " " + " ".join(f"{base.split()[(k * 7 + j * j) % 15]}{chr(97 + (k + j) % 26)}" for j in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    item = " ".join(f"bench{chr(97 + k)}mark" for k in range(20))
    texts = [long(EN, 1), long(DE, 2), long(EN, 1), long(EN, 3) + " " + item, "123 456 +++", long(EN, 4) + " password=hunter22x",
             None, long(DE, 5), long(DE, 6)]
    ids = [0, 1, 2, 3, 4, 5, 6, None, None]
    langs = ["en", "de", "en", "en", "en", "en", "en", "de", "de"]
    docs(spark, texts, ids, langs).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_stages(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        table = corpus_pipeline.stored(stage(spark, table, folder), "stage")
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append([r[0] for r in rows(table, "doc_id")])
    assert kept == [[None, None, 0, 1, 2, 3, 5], [None, None, 0, 1, 3, 5], [None, None, 0, 1, 5], [None, None, 0, 1, 5]]
    clean = table.where("doc_id = 5").first()
    assert "hunter22x" not in clean["text"] and "[SECRET]" in clean["text"] and clean["n_chars"] == len(clean["text"])


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert out.count() == 5


def test_empty_corpus(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_by_five_words_and_four_fifths(spark, tmp_path):
    words = [f"w{k}" for k in range(50)]
    one = [*words[:25], "other", *words[26:]]  # Jaccard 41/51 by five words, 43/51 by four
    both = [*one[:10], "more", *one[11:]]
    table = docs(spark, [" ".join(w) for w in (words, one, both)], [1, 2, 3])
    assert rows(corpus_pipeline.near_duplicates(spark, table.where("doc_id <> 3"), str(tmp_path)), "doc_id") == [(1,)]
    far = docs(spark, [" ".join(words), " ".join(both)], [1, 3])
    assert rows(corpus_pipeline.near_duplicates(spark, far, str(tmp_path)), "doc_id") == [(1,), (3,)]
    assert rows(corpus_pipeline.jaccard_join.jaccard_classes(table), "doc_id", "component_id") == [(1, 1), (2, 2), (3, 3)]


def test_one_doc_id_with_several_texts_is_chosen_by_rule(spark, tmp_path):
    texts = [long(EN, k) for k in range(4)]
    table = docs(spark, [*texts, None, None], [1, 1, 1, 1, 1, 2])
    want = min(texts, key=lambda t: hashlib.md5(t.encode()).hexdigest())
    for parts in (1, 5):
        got = corpus_pipeline.near_duplicates(spark, table.repartition(parts, "text"), str(tmp_path))
        assert got.columns == table.columns and rows(got, "doc_id", "text") == [(1, want), (2, None)]
