"""Token ids as Parquet: writing in document order, selective reading.

Layout, one row per document: ``doc_id``, ``part`` and ``row`` (its place: files
and rows ascend with doc_id), ``n_tokens``, ``ids`` (list of int).  Token ids take
16 bits or less by dictionary encoding; format version 2 gives the counters, and
ids beyond a full dictionary, delta encoding.  Row groups and pages have set
sizes and the files carry column and offset indexes, so a reader of some
documents opens the pages that hold them, and a reader of metadata none of the ids.

Documents are range-partitioned by (doc_id, hash of the text): a doc_id on a
third of all rows spreads over several files.  Each file's task encodes the
distinct pre-tokens of its own text, a block at a time, and keeps a bounded number of them for the blocks after.

The definition's added tokens (``<|endoftext|>``) are ordinary text, or with
``added_tokens`` found in the texts first, as the library does unless told otherwise.

Defined results: null text -> the end id alone.  A null doc_id sorts first; rows
with one doc_id follow each other by text hash.  An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tailorspark.llm.bpe import take_runs
from tailorspark.llm.pretoken import Vocabulary

#: Characters a file is meant to hold, and a block that is encoded at once.
FILE_CHARS = 32_000_000
BLOCK_CHARS = 4_000_000
#: Pre-tokens whose ids a task keeps, rows read and pre-tokens written out at a time.
KNOWN_WORDS, ROWS, STEP = 200_000, 256, 1 << 16
WRITE_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),  # holds a vocabulary of 2**18 ids
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
}
SCHEMA = "doc_id long, part int, row long, n_tokens int, ids array<int>"


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE files use for each byte: itself if printable, else 256 and up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Encoder:
    """Texts to ids: distinct pre-tokens once each, through the tokenizers library's model.

    The first ``KNOWN_WORDS`` pre-tokens of a task keep their ids for the blocks after; the others' last for their block.
    ``added_tokens``: texts are split at the definition's added tokens, which have ids of their own.
    """

    def __init__(self, definition: str, end_id: int, added_tokens: bool):
        from tokenizers import Tokenizer
        whole = Tokenizer.from_str(definition)
        self.model = whole.model
        self.letters = _byte_letters()
        added = whole.get_added_tokens_decoder() if added_tokens else {}
        for t in added.values():
            if t.single_word or t.lstrip or t.rstrip or t.normalized:
                raise ValueError(f"added token {t.content!r}: only tokens found as they stand are supported")
        added = {t.content: i for i, t in added.items() if t.content}
        # the leftmost, and of those that begin there the longest
        longest = sorted(added, key=len, reverse=True)
        self.split = re.compile("(" + ("|".join(map(re.escape, longest)) or "(?!)") + ")").split
        # entry k has the ids flat[ends[k]:ends[k + 1]]: the end of a document, the added tokens, then words
        self.added = {t: k for k, t in enumerate(added, 1)}
        self.flat = array("i", [end_id, *added.values()])
        self.ends = array("q", range(len(self.flat) + 1))
        self.known: dict[str, int] = {}
        self.keep = len(self.flat) + KNOWN_WORDS

    def _shown(self, word: str) -> str:
        """The letters of the word's bytes; of the printable ASCII signs only the blank has another one."""
        if word.isascii() and word.isprintable():
            return word.replace(" ", self.letters[0x20])
        return word.encode().decode("latin-1").translate(self.letters)

    def _entries(self, words: list[str]) -> np.ndarray:
        """The entry of each word; those that are new are encoded."""
        known, flat, ends, tokenize, out = self.known, self.flat, self.ends, self.model.tokenize, []
        for w in words:
            k = known.get(w)
            if k is None:
                k = len(ends) - 1
                flat.extend([t.id for t in tokenize(self._shown(w))])
                ends.append(len(flat))
                if k < self.keep:
                    known[w] = k
            out.append(k)
        return np.array(out, np.int32)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and where each text's begin (and the last one's end)."""
        parts = [self.split(t) for t in texts]  # text, added token, text, ...
        v = Vocabulary([t for p in parts for t in p[::2]])
        entries = self._entries(v.words)[v.codes]
        counts, at, place, special, last = iter(v.counts.tolist()), 0, [], [], []
        for p in parts:
            for k, piece in enumerate(p):
                if k % 2:
                    place.append(at)
                    special.append(self.added[piece])
                else:
                    at += next(counts)
            last.append(at + len(place))
            place.append(at)
            special.append(0)
        entries = np.insert(entries, place, special)
        flat, ends = np.array(self.flat, np.int32), np.array(self.ends, np.int64)
        del self.ends[self.keep + 1:]
        del self.flat[self.ends[-1]:]
        begin, lens = ends[:-1], np.diff(ends)
        total = np.cumsum(lens[entries])
        out = np.empty(int(total[-1]) if len(total) else 0, np.int32)
        for i in range(0, len(entries), STEP):
            got = take_runs(flat, begin, lens, entries[i:i + STEP])
            out[(lo := int(total[i - 1]) if i else 0):lo + len(got)] = got
        return out, np.append(0, total[last])


def _encode(definition, end_id: int, added_tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, row = _Encoder(definition.value, end_id, added_tokens), TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def block() -> pa.RecordBatch:
            tokens, at = coder.ids(texts)
            return pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(np.full(len(ids), part, np.int32)),
                pa.array(np.arange(row, row + len(ids))), pa.array(np.diff(at).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tokens))],
                ["doc_id", "part", "row", "n_tokens", "ids"])

        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                b = whole.slice(k, ROWS)
                for i, t in zip(b.column("doc_id").cast(pa.int64()).to_pylist(), b.column("text").to_pylist()):
                    t = t if isinstance(t, str) else ""
                    if texts and size + len(t) > BLOCK_CHARS:
                        yield block()
                        row, ids, texts, size = row + len(ids), [], [], 0
                    ids.append(i)
                    texts.append(t)
                    size += len(t)
        if texts:
            yield block()
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, added_tokens: bool = False) -> None:
    """Encode every text, append ``end_id``, and write files in ascending doc_id order to ``path``."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())  # the vocabulary: a fixed size
    docs = docs.select("doc_id", "text")
    chars = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    keyed = docs.withColumn("h", F.xxhash64("text"))
    # a count of its own keeps adaptive execution from merging ranges: a partition is a file
    ranged = keyed.repartitionByRange(max(1, -(-chars // FILE_CHARS)), "doc_id", "h").sortWithinPartitions("doc_id", "h")
    ranged.select("doc_id", "text").mapInArrow(_encode(definition, end_id, added_tokens), SCHEMA) \
        .write.options(**WRITE_OPTIONS).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, part, row, n_tokens, start)``; the ids' pages stay unread.

    ``start``: ids of all documents before.  Files are summed first, so the only
    order over everything is over one row per file.
    """
    rows = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "part", "row", "n_tokens")
    per_file = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = per_file.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row")) - F.col("n_tokens")
    return rows.withColumn("inside", inside).join(before, "part") \
        .select("doc_id", "part", "row", "n_tokens", (F.col("base") + F.col("inside")).alias("start"))


def read_tokens(spark: SparkSession, path: str, least: int | None = None, most: int | None = None) -> DataFrame:
    """Rows with ids, of documents ``least <= doc_id <= most``; the page indexes skip the rest."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if least is not None:
        rows = rows.where(F.col("doc_id") >= least)
    if most is not None:
        rows = rows.where(F.col("doc_id") <= most)
    return rows


def checksums(tokens: DataFrame) -> DataFrame:
    """``(part, row, n_tokens, ids_crc32)`` of rows read back: crc32 of the ids as little-endian 32-bit numbers."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["ids_crc32"] = [zlib.crc32(np.asarray(i, "<u4").tobytes()) for i in b["ids"]]
            b["n_tokens"] = [len(i) for i in b["ids"]]
            yield b[["part", "row", "n_tokens", "ids_crc32"]]

    return tokens.select("part", "row", "ids").mapInPandas(run, "part int, row long, n_tokens long, ids_crc32 long")
