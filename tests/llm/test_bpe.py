import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tailorspark.llm import bpe, token_files
from tailorspark.llm.pretoken import Vocabulary
from util import docs, rows

PIECES = ["a", "b", "'s", "'t", "'", "'re", "'ll", "'d", "'ve", "'m", "l", "r", "e", " ", "  ", "\n", " \n", "\t", "1", "22", "½",
          "é", "ß", "!", "...", "\x1c", "\x85", "中", "́", "😀", "S", "'S", "\x00", "_", "﻿", "<|endoftext|>", "the"]


def some_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def coder():
    return tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")),
                             special_tokens={})


def test_pretokens_are_the_patterns():
    import regex
    texts = some_texts(1, 4000)
    v, at = Vocabulary(texts), 0
    for t, n in zip(texts, v.counts):
        assert [v.words[k] for k in v.codes[at:at + n]] == regex.findall(P.PATTERN, t)
        at += n
    assert len(set(v.words)) == len(v.words)


TEXTS = [None, "", "the the the", "x" * 5000, *some_texts(2, 200)]


def test_round_trip(spark, coder, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 300)
    monkeypatch.setattr(bpe, "BUCKET_CHARS", 500)
    ids = [7, None, *range(len(TEXTS) - 2)]  # 7 twice
    table = docs(spark, TEXTS, ids=ids).withColumn("ids", F.lit("mine")).repartition(3)
    got = bpe.round_trip(table, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    want = sorted(((i is not None, i), coder.encode_ordinary(t or ""), (t or "").encode()) for i, t in zip(ids, TEXTS))
    assert sorted(((r["doc_id"] is not None, r["doc_id"]), list(r["ids"]), bytes(r["data"])) for r in got) == want


def test_encode_alone_and_empty_table(spark, coder):
    path = P.path("byte_bpe_50k.tiktoken")
    assert rows(bpe.encode(docs(spark, ["hello world"]), path, P.PATTERN)) == [(0, coder.encode_ordinary("hello world"))]
    assert bpe.round_trip(docs(spark, []), path, P.PATTERN).count() == 0


def test_token_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_CHARS", 1500)
    monkeypatch.setattr(token_files, "BLOCK_CHARS", 400)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = list(range(1000, 1000 + len(TEXTS)))
    random.Random(4).shuffle(ids)
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs(spark, TEXTS, ids=ids).repartition(5), path, P.path("byte_bpe_50k.json"), 2)
    place = token_files.read_metadata(spark, path)
    sums = token_files.checksums(token_files.read_tokens(spark, path))
    got = rows(place.drop("n_tokens").join(sums, ["part", "row"]), "doc_id", "start", "n_tokens", "ids_crc32")
    want, start = [], 0
    for i, text in sorted(zip(ids, TEXTS), key=lambda x: x[0]):
        tokens = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
        start += len(tokens)
    assert got == want
    # files ascend, and a reader of some documents gets just those
    by_file = place.groupBy("part").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("part").collect()
    assert len(by_file) > 2 and all(x["b"] < y["a"] for x, y in zip(by_file, by_file[1:]))
    assert rows(token_files.read_tokens(spark, path, 1003, 1005), "doc_id") == [(1003,), (1004,), (1005,)]


def test_token_file_format(spark, tmp_path):
    import pyarrow.parquet as pq
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs(spark, ["the cat and the dog " * 500] * 40), path, P.path("byte_bpe_50k.json"), 2)
    file = next(p for p in (tmp_path / "tokens").glob("*.parquet"))
    group = pq.ParquetFile(file).metadata.row_group(0)
    column = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
    token = column["ids.list.element"]
    assert token.has_offset_index and token.has_column_index
    assert any("DICTIONARY" in e for e in token.encodings)
    assert token.total_compressed_size < token.num_values


def test_token_files_of_nothing_and_of_null_and_repeated_ids(spark, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_tokens(docs(spark, []), path, P.path("byte_bpe_50k.json"), 2)
    assert token_files.read_metadata(spark, path).count() == 0
    path = str(tmp_path / "odd")
    token_files.write_tokens(docs(spark, ["a", "b", "a", "c"], ids=[5, None, 5, 5]), path, P.path("byte_bpe_50k.json"), 2)
    assert rows(token_files.read_metadata(spark, path), "doc_id", "start", "n_tokens") == [
        (None, 0, 2), (5, 2, 2), (5, 4, 2), (5, 6, 2)]


def test_token_files_query_has_the_librarys_ids_with_added_tokens(spark, tmp_path, monkeypatch):
    from tailorspark.llm import queries
    monkeypatch.setattr(token_files, "BLOCK_CHARS", 400)
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x \n<|endoftext|><|endoftext|>\n y's", "<|endoftext|", *TEXTS]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want, start = [], 0
    for i, text in enumerate(texts):
        tokens = t.encode(text or "", add_special_tokens=False).ids + [queries.END_ID]
        want.append((i, start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
        start += len(tokens)
    assert want[0][2] == 4
    assert rows(queries.op2_token_files(spark, str(tmp_path)), "doc_id", "start", "n_tokens", "ids_crc32") == want


@pytest.mark.parametrize("known", [0, 5, 10_000])
def test_token_encoder_keeps_words_over_blocks(monkeypatch, known):
    monkeypatch.setattr(token_files, "KNOWN_WORDS", known)
    monkeypatch.setattr(token_files, "STEP", 7)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    coder = token_files._Encoder(t.to_str(), 2, True)
    asked, model = [], coder.model

    class Counted:
        def tokenize(self, word):
            asked.append(word)
            return model.tokenize(word)

    coder.model = Counted()
    kept = len(coder.flat) + known
    for texts in (some_texts(5, 60), [], [""], some_texts(6, 60), some_texts(5, 60), ["~ \x7f!", "<|endoftext|>é <|endoftext|>"]):
        flat, at = coder.ids(texts)
        assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [
            t.encode(x, add_special_tokens=False).ids + [2] for x in texts]
        assert len(coder.known) <= known and len(coder.ends) <= kept + 1
    if known == 10_000:
        assert len(asked) == len(set(asked))  # none twice, whatever the block
