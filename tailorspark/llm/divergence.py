"""Source divergence audit: how far the term shares of groups of documents lie apart.

Every (lang, source) group has a segment tree over the term ids of its language, with the
group's counts at the leaves.  Trees are hash-consed: leaves with one count and nodes with the
same two children are one node, within a tree and between trees.  Two trees are traversed
together from the root, level by level, and a pair of nodes met before is not entered again,
so each pair of equal count subtrees is priced once.

Spark does the counting, the term ids and the sums; the trees of a language are cut at their
upper nodes into blocks of ``BLOCK`` terms (by hash, numbered inside by text), and blocks are
priced by tasks of their own.  A task holds two chunks of about ``CHUNK`` groups, so its memory
is bounded however many sources a language has, and gives one sum for each pair of groups.

Shares are integers: p = 1 + floor(SCALE (count + 2) / (N + 2 V)), N the group's occurrences of
kept terms, V the language's kept terms; the price of a term is floor((p - q)^2 / (p + q)).

Defined results.  Null text, language or source count as ''.  A term is a stretch of
``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased.  A group without kept terms has shares like
any other (counts 0); a language without kept terms gives pairs of price 0.  Repeated rows are
rows of their own.  An empty table gives no rows, a language with one source no pairs.  Ties are
ranked by item, UTF-8 ascending.  Long texts are counted whole, in pieces.  Only the columns
``text``, ``lang`` and ``source`` are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailorspark.llm.store import discard, stored

#: Least number of a language's documents that hold a kept term.
MIN_DOCS = 10
SCALE = 1_000_000_000
#: Ranks of the terms by which a group exceeds its language.
TOP_TERMS = 10
#: Leaves of a block's trees, groups of a chunk, distinct terms that a task holds at once.
BLOCK, CHUNK, HELD = 1024, 256, 200_000
_PIECE = 1 << 20
_TERMS = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 0x20 for b in range(256))
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


# -- counting ------------------------------------------------------------------
def _words(text: str | None) -> Iterator[list[bytes]]:
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TERMS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + _PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (total, docs) in held.items():
            n = len(total)
            terms = pa.array(list(total), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), terms,
                 pa.array(total.values(), pa.int64()), pa.array([docs[t] for t in total], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*batch.columns):
            total, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            seen: set[bytes] = set()
            for words in _words(text.as_py()):
                total.update(words)
                seen.update(words)
            docs.update(seen)
        if sum(len(t) for t, _ in held.values()) > HELD:
            yield from flush()
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term): occurrences ``n`` and documents ``docs``."""
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], "text")
    return named.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# -- trees ---------------------------------------------------------------------
class Forest:
    """Segment trees of several rows of counts, equal nodes shared.

    ``rows``: [tree, leaf] numbers of at least 0; the leaves are padded to a power of two with a
    number of their own, ``counts[-1]`` = -1.
    """

    def __init__(self, rows: np.ndarray):
        self.counts, nodes = np.unique(rows, return_inverse=True)
        nodes = nodes.reshape(rows.shape)
        self.counts = np.append(self.counts, -1)
        self.leaves = nodes
        width = 1 << max(0, rows.shape[1] - 1).bit_length()
        nodes = np.pad(nodes, ((0, 0), (0, width - rows.shape[1])), constant_values=len(self.counts) - 1)
        self.children: list[tuple[np.ndarray, np.ndarray]] = []  # by level, from the leaves up: left and right of a node
        while nodes.shape[1] > 1:
            n = int(nodes.max()) + 1
            made, named = np.unique(nodes[:, 0::2] * n + nodes[:, 1::2], return_inverse=True)
            self.children.append((made // n, made % n))
            nodes = named.reshape(nodes.shape[0], -1)
        self.roots = nodes[:, 0]

    def traverse(self, one: int, other: int, price) -> tuple[int, np.ndarray, np.ndarray]:
        """Sum of ``price(leaf numbers of one, of other)`` over all leaves of two trees; the pairs of leaf numbers
        met, as keys, and their prices."""
        a, b = self.roots[[one]], self.roots[[other]]
        met = []
        for left, right in reversed(self.children):
            a, b = np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]])
            width = int(b.max()) + 1
            keys, back = np.unique(a * width + b, return_inverse=True)
            a, b = keys // width, keys % width
            met.append(back)
        keys, leaf = a * len(self.counts) + b, price(a, b)
        value = leaf
        for back in reversed(met):
            value = value[back]
            half = len(value) // 2
            value = value[:half] + value[half:]
        return int(value[0]), keys, leaf


def _shares(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """p for every count, in whole numbers of any size; equal and positive for the padding."""
    return np.array([1 if c < 0 else 1 + SCALE * (c + 2) // (n + 2 * v) for c in counts.tolist()], np.int64)


def _price(p: np.ndarray, q: np.ndarray):
    def price(a, b):
        d, s = p[a] - q[b], p[a] + q[b]
        return d * d // s
    return price


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    """Pair sums and first terms of one block and two chunks of groups (see ``_block_rows`` for the columns)."""
    groups = rows[rows["place"] < 0]  # one row for each group, and one for the language where its terms are asked for
    v = int(groups["v"].iloc[0])
    place = {g: i for i, g in enumerate(zip(groups["whole"].tolist(), groups["source"].tolist()))}
    leaves = rows[rows["place"] >= 0]
    size = int(leaves["place"].max()) + 1 if len(leaves) else 0
    counts = np.zeros((len(groups), size), np.int64)
    of = [place[g] for g in zip(leaves["whole"].tolist(), leaves["source"].tolist())]
    counts[of, leaves["place"].to_numpy(np.int64)] = leaves["n"].to_numpy(np.int64)
    if v:
        forest = Forest(counts)
        shares = [_shares(forest.counts, n, v) for n in groups["n"].tolist()]
    chunk, whole, names = groups["chunk"].to_numpy(), groups["whole"].to_numpy(bool), groups["source"].tolist()
    a, b = int(rows["a"].iloc[0]), int(rows["b"].iloc[0])
    out = []
    for i in np.flatnonzero(~whole & (chunk == a)).tolist():
        for j in np.flatnonzero(~whole & (chunk == b)).tolist():
            if a != b or names[i] < names[j]:
                out.append(("pair", names[i], names[j],
                            forest.traverse(i, j, _price(shares[i], shares[j]))[0] if size else 0))
    for lang in np.flatnonzero(whole).tolist() if size else ():
        terms = leaves[leaves["whole"]].sort_values("place")["term"].tolist()  # every kept term occurs in the language
        for i in np.flatnonzero(~whole).tolist():
            _, keys, value = forest.traverse(i, lang, _price(shares[i], shares[lang]))
            one, other = forest.leaves[i], forest.leaves[lang]
            value = value[np.searchsorted(keys, one * len(forest.counts) + other)]
            at = np.flatnonzero((counts[i] > 0) & (shares[i][one] > shares[lang][other]))
            at = at[np.lexsort((at, -value[at]))][:TOP_TERMS]
            out += [("term", names[i], terms[k], int(value[k])) for k in at.tolist()]
    lang = rows["lang"].iloc[0]
    return pd.DataFrame([(lang, *r) for r in out], columns=["lang", "part", "source", "item", "value"])


def _block_rows(counts: DataFrame, groups: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """What blocks are priced from, and the stored tables that it reads.

    ``groups``: every (lang, source).  Rows: lang, block, the two chunks a and b, ``whole`` (of the language's tree,
    else a group's), source, chunk, place of the term in the block, term, n (its count; N where place is -1), v.
    """
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(
        F.col("docs") >= MIN_DOCS)
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(
        kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("total")), "lang", "left")
    langs = langs.select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total"),
                         F.ceil(F.col("sources") / CHUNK).cast("int").alias("chunks"))
    # a row for each language, stored: its size is known to the planner, and a language's rows are not dealt to one task
    langs = stored(langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK)).cast("int")), "langs")
    numbered = kept.join(langs.drop("total"), "lang").withColumn(
        "block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    numbered = stored(numbered.select("lang", "term", "block", "n", "v", "chunks", (F.row_number().over(
        Window.partitionBy("lang", "block").orderBy("term")) - 1).alias("place")), "terms")
    leaves = counts.select("lang", "source", "term", F.col("n").alias("_n")).join(
        numbered.drop("n"), ["lang", "term"]).withColumnRenamed("_n", "n")
    sums = leaves.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    chunk = F.pmod(F.xxhash64("source"), F.col("chunks")).cast("int")

    def both(df: DataFrame) -> DataFrame:
        """To every pair of chunks that has the row's chunk."""
        pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(
            F.least(k, "chunk").alias("a"), F.greatest(k, "chunk").alias("b")))
        return df.withColumn("pair", F.explode(pair)).select("*", "pair.a", "pair.b")

    def each(df: DataFrame) -> DataFrame:
        """To every chunk, where it is paired with itself."""
        return df.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
            "*", F.col("chunk").alias("a"), F.col("chunk").alias("b"))

    none = F.lit(None).cast("string")
    columns = ["lang", "block", "a", "b", "whole", "source", "chunk", "place", "term", "n", "v"]
    members = groups.join(langs, "lang").join(sums.withColumnRenamed("total", "n"), ["lang", "source"], "left") \
        .withColumn("n", F.coalesce("n", F.lit(0)))
    spread = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    parts = [
        both(members.select("lang", "source", "n", "v", "chunks", chunk.alias("chunk"), spread)).select(
            "*", F.lit(False).alias("whole"), F.lit(-1).alias("place"), none.alias("term")),
        each(langs.select("lang", "v", "chunks", F.col("total").alias("n"), spread)).select(
            "*", F.lit(True).alias("whole"), F.lit("").alias("source"), F.lit(-1).alias("place"), none.alias("term")),
        both(leaves.withColumn("chunk", chunk)).select("*", F.lit(False).alias("whole")).withColumn(
            "term", none),
        each(numbered).select("*", F.lit(True).alias("whole"), F.lit("").alias("source")),
    ]
    rows = parts[0].select(columns)
    for p in parts[1:]:
        rows = rows.union(p.select(columns))
    return rows, [langs, numbered]


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair``, the divergence of a group from each other source of its
    language; part ``term``, the ``TOP_TERMS`` terms by which it exceeds its language most."""
    counts = stored(term_counts(docs), "term-counts")
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    rows, read = _block_rows(counts, groups)
    priced = rows.groupBy("lang", "block", "a", "b").applyInPandas(
        _block, "lang string, part string, source string, item string, value bigint")
    priced = stored(priced.groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value")), "prices")
    discard(counts, *read)
    pairs = priced.where("part = 'pair'")
    back = pairs.select("lang", "part", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = priced.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS)
    ranked = pairs.union(back).withColumn("rank", F.row_number().over(order))
    return ranked.union(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
