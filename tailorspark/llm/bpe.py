"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Merges never cross a pre-token, so a corpus is encoded by encoding its distinct
pre-tokens ("words") once each:

1. Texts are packed into blocks of about ``BLOCK_CHARS`` characters.  A block
   keeps, for every position, the number of its word among the block's distinct
   words - the positions never leave the block - and sends out each distinct
   word once.  This is the pre-aggregation that keeps a word which makes up a
   third of the corpus to one entry per block.
2. The words are shuffled by hash into buckets whose number follows the corpus
   size; a bucket encodes each of its distinct words once and answers every
   block that asked.
3. Back at the blocks, ids are put together by position.  Blocks are stored
   bucketed by block, so only the words and their ids are ever shuffled.

Decoding joins the ids in use with the vocabulary's token-byte table and puts
the bytes together by position in the same way.

Defined results: null text -> no ids, empty bytes.  Rows repeat as they come, a
null doc_id stays null; columns besides doc_id and text are not read.  A text
longer than a block is a block of its own.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailorspark.llm.pretoken import Vocabulary
from tailorspark.llm.store import stored, stored_by_key

BLOCK_CHARS = 8_000_000
#: Characters of corpus per word bucket.
BUCKET_CHARS = 32_000_000

_BLOCK = ("block long, ids binary, missing binary, counts binary, codes binary, bucket_of binary, "
          "asked array<struct<bucket:int,words:binary>>")


def read_ranks(path: str) -> dict[bytes, int]:
    """{token bytes: id} of a rank file (one base64 token and its id a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


#: Ids per row of the token-byte table.
PAGE = 256


def token_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """``(page, tokens)``: the vocabulary's tokens by id, ``PAGE`` ids a row (null where an id has none)."""
    pages: dict[int, list] = {}
    for token, i in ranks.items():
        pages.setdefault(i // PAGE, [None] * PAGE)[i % PAGE] = token
    return spark.createDataFrame(sorted(pages.items()), "page int, tokens array<binary>")


def _pack(codes: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, as few as they need; planes of high bytes are nearly constant."""
    width = max(1, (int(codes.max(initial=0)).bit_length() + 7) // 8)
    planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    return bytes([width]) + np.ascontiguousarray(planes.T).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8, offset=1).reshape(packed[0], -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, :packed[0]] = planes.T
    return out.view("<u4").reshape(-1).astype(np.int64)


def _pack_words(words: list[str]) -> bytes:
    raw = [w.encode() for w in words]
    return zlib.compress(np.array([len(words), *map(len, raw)], "<u4").tobytes() + b"".join(raw))


def _unpack_words(packed: bytes) -> list[bytes]:
    data = zlib.decompress(packed)
    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(np.frombuffer(data, "<u4", n, 4).astype(np.int64)) + 4 * (n + 1)
    return [data[a:b] for a, b in zip([4 * (n + 1), *ends[:-1].tolist()], ends.tolist())]


def _pack_numbers(numbers: np.ndarray) -> bytes:
    """Unsigned numbers in as many bytes as the largest needs, compressed."""
    top = int(numbers.max(initial=0))
    narrow = numbers.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4")
    return bytes([narrow.itemsize]) + zlib.compress(narrow.tobytes(), 1)


def _unpack_numbers(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed[1:]), f"<u{packed[0]}").astype(np.int64)


def take_runs(values: np.ndarray, begin: np.ndarray, lens: np.ndarray, which: np.ndarray) -> np.ndarray:
    """``values[begin[k]:begin[k] + lens[k]]`` for every k in ``which``, one after the other."""
    size = lens[which]
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return values[np.repeat(begin[which], size) + step]


def _make_block(block: int, ids: list, texts: list[str], buckets: int) -> pd.DataFrame:
    v = Vocabulary(texts)
    bucket = np.array([zlib.crc32(w.encode()) % buckets for w in v.words], np.int64)
    order = np.argsort(bucket, kind="stable")
    used, begin = np.unique(bucket[order], return_index=True)
    asked = [{"bucket": int(b), "words": _pack_words([v.words[i] for i in part])}
             for b, part in zip(used, np.split(order, begin[1:]))] if len(order) else []
    missing = np.array([pd.isna(i) for i in ids], np.uint8)
    numbers = np.array([0 if m else int(i) for i, m in zip(ids, missing)], "<i8")
    return pd.DataFrame({"block": [block], "ids": [numbers.tobytes()], "missing": [missing.tobytes()],
                         "counts": [v.counts.astype("<i8").tobytes()], "codes": [_pack(v.codes)],
                         "bucket_of": [_pack(bucket)], "asked": [asked]})


def _blocks(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # unique over the tasks whose output is kept: one committed attempt per partition
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b["doc_id"].tolist(), b["text"].tolist()):
                t = t if isinstance(t, str) else ""
                if texts and size + len(t) > BLOCK_CHARS:
                    yield _make_block(number, ids, texts, buckets)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if texts:
            yield _make_block(number, ids, texts, buckets)
    return run


def _encode_bucket(ranks, pattern: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import tiktoken
        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        known: dict[bytes, list[int]] = {}
        lens, ids = [], []
        for packed in rows["words"]:
            got = []
            for w in _unpack_words(packed):
                e = known.get(w)
                if e is None:
                    e = known[w] = coder.encode_ordinary(w.decode())
                got.append(e)
            lens.append(_pack_numbers(np.array([len(e) for e in got], np.int64)))
            ids.append(_pack_numbers(np.fromiter((i for e in got for i in e), np.int64)))
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "lens": lens, "tokens": ids})
    return run


class Encoded:
    """A corpus as stored blocks (positions) and stored word ids; see the module's text."""

    def __init__(self, docs: DataFrame, ranks: dict[bytes, int], pattern: str):
        spark = docs.sparkSession
        docs = docs.select("doc_id", "text")
        self._ranks = ranks
        chars = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
        buckets = max(1, -(-chars // BUCKET_CHARS))
        self.blocks = stored_by_key(docs.mapInPandas(_blocks(buckets), _BLOCK), "blocks", "block",
                                    max(1, -(-chars // BLOCK_CHARS)))
        asked = self.blocks.select("block", F.explode("asked").alias("a")).select("block", "a.bucket", "a.words")
        shared = spark.sparkContext.broadcast(ranks)  # the vocabulary: a fixed size
        self.words = stored(asked.groupBy("bucket").applyInPandas(
            _encode_bucket(shared, pattern), "block long, bucket int, lens binary, tokens binary"), "words")

    def _assembled(self, answers: DataFrame, decode: bool) -> DataFrame:
        schema = "doc_id long, ids array<int>" + ", data binary" * decode
        positions = self.blocks.select("block", "ids", "missing", "counts", "codes", "bucket_of")
        return positions.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_assemble(decode), schema)

    def token_ids(self) -> DataFrame:
        """``(doc_id, ids)`` for every document."""
        return self._assembled(self.words, False)

    def decoded(self) -> DataFrame:
        """``(doc_id, ids, data)``: the ids, and the bytes that they decode to."""
        table = token_table(self.blocks.sparkSession, self._ranks)
        used = self.words.mapInPandas(_used_pages, "block long, page int").distinct()
        pieces = used.join(table, "page").groupBy("block").agg(F.collect_list(F.struct("page", "tokens")).alias("pieces"))
        none = [F.lit(None).cast(k).alias(c) for c, k in self.words.dtypes[1:]]
        answers = self.words.select("*", F.lit(None).cast("array<struct<page:int,tokens:array<binary>>>").alias("pieces")) \
            .union(pieces.select("block", *none, "pieces"))
        return self._assembled(answers, True)


def _used_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for block, tokens in b.groupby("block")["tokens"]:
            pages = np.unique(np.concatenate([_unpack_numbers(t) for t in tokens]) // PAGE)
            yield pd.DataFrame({"block": block, "page": pages.astype(np.int32)})


def _assemble(decode: bool):
    def run(block: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        head = block.iloc[0]
        parts = rows[rows["lens"].notna()].sort_values("bucket")
        codes, bucket_of = _unpack(head["codes"]), _unpack(head["bucket_of"])
        counts = np.frombuffer(head["counts"], "<i8")
        place = np.empty(len(bucket_of), np.int64)  # of a word among the buckets' answers
        place[np.argsort(bucket_of, kind="stable")] = np.arange(len(bucket_of))
        none = [np.zeros(0, np.int64)]
        lens = np.concatenate([_unpack_numbers(x) for x in parts["lens"]] or none)
        tokens = np.concatenate([_unpack_numbers(x) for x in parts["tokens"]] or none).astype(np.int32)
        answer = place[codes] if len(codes) else codes
        doc_ids = pd.array(np.frombuffer(head["ids"], "<i8").copy(), "Int64")
        doc_ids[np.frombuffer(head["missing"], np.uint8).astype(bool)] = pd.NA

        begin = np.cumsum(lens) - lens
        table = None
        if decode:
            pieces = {}
            for listed in rows["pieces"]:
                if listed is not None:
                    pieces |= {p["page"] * PAGE + k: bytes(t) for p in listed for k, t in enumerate(p["tokens"]) if t is not None}
            ids = tokens.tolist()
            table = [b"".join([pieces[i] for i in ids[a:a + n]]) for a, n in zip(begin.tolist(), lens.tolist())]
        out, data, at = [], [], 0
        for n in counts.tolist():
            own = answer[at:at + n]
            at += n
            out.append(take_runs(tokens, begin, lens, own))
            if decode:
                data.append(b"".join([table[k] for k in own.tolist()]))
        frame = {"doc_id": doc_ids, "ids": out}
        return pd.DataFrame(frame | {"data": data} if decode else frame)
    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids)`` of every row of ``docs`` by the ranks in a file."""
    return Encoded(docs, read_ranks(ranks_path), pattern).token_ids()


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids, data)``: encoded, and decoded again from the ids."""
    return Encoded(docs, read_ranks(ranks_path), pattern).decoded()
