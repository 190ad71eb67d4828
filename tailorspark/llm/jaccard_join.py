"""Exact n-gram Jaccard join with a token-group matrix.

A document is the set of its distinct word n-grams.  Two documents link when
``100 * |x & y| >= percent * |x | y|``; the result is every document's class,
the smallest doc_id reachable over links.

1. *Classes.*  Documents with equal sets are one class from here on, whatever
   their number.
2. *Groups.*  Similar classes are put together: of the classes that agree on a
   band of minimum hashes, those whose hashes mostly agree with a leader's are
   compared with it, and the verified links' connected components are the groups.
   A hot band costs its size, not its square; classes that no leader has taken
   get another one in the next round.  Grouping only saves work - a link it
   misses is found by the next steps.
3. *Token-group matrix.*  One row per (token, group): the token unions of the
   groups, rarest tokens first.  If x links to y, their first common token in any
   order common to all stands early in both: at least ``t / (1 + t) * (|x| + |y|)``
   tokens must follow.  So each class looks up its first tokens only and finds
   the groups with such a token.  The order is by a sketch of the tokens'
   frequency in the whole corpus: a passage that many documents share comes last
   and does not draw them together.
4. *Bound.*  A found group's members, and the classes that found it, meet in one
   task (in chunks of ``CHUNK`` members, each a group of its own, so a hot group has
   many).  The overlap with the group's whole token union bounds the overlap with
   every member; below ``t n`` the group stays closed.
5. *Open.*  Members of qualifying groups are compared exactly, up to the first
   link: the members are linked among themselves already.

Sets hold 64-bit hashes of n-grams.  Words are ``[^\\x20\\x09-\\x0D]+`` of the whole
text with A-Z lowered; fewer than n words count as one gram.

Defined results: null or wordless text -> empty set, linked with nothing, its
own class.  Repeated rows repeat in the result; a doc_id that occurs with
several texts is one node with several sets.  A null doc_id takes part in no
link: its component is that of an equal set, else null.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailorspark.llm.components import connected_components
from tailorspark.llm.store import discard, stored
from tailorspark.llm.textvec import Words, mix64, pieces

_U = np.uint64
#: Frequency sketch: 2**SKETCH_BITS counters, sent in CELLS pieces.
SKETCH_BITS = 24
CELLS = 4096
#: Grouping: minimum hashes, bands of BAND of them, how many must agree with a leader's, leaders tried in a band.
HASHES = 16
BAND = 3
AGREE = 9
ROUNDS = 3
#: Members of a group that are bounded and opened together.
CHUNK = 256
#: Bits of the filter that holds back documents whose sets are not wanted.
FILTER_BITS = 1 << 23
_PIECE = 1 << 20


def _doc_sets(texts, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of every text."""
    w = Words(texts, lower=True)
    h = w.hashes()
    at = w.bounds
    grams = np.zeros(0, _U)
    if len(h) >= n:
        grams = h[:len(h) - n + 1].copy()
        for k in range(1, n):
            grams = mix64(grams * _U(0x9E3779B97F4A7C15) + h[k:len(h) - n + 1 + k])
    out = []
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        if b - a >= n:
            out.append(np.unique(grams[a:b - n + 1]))
        elif b > a:
            one = _U(b - a)
            for x in h[a:b]:
                one = mix64(np.array([one * _U(3) + x], _U))[0]
            out.append(np.array([one], _U))
        else:
            out.append(np.zeros(0, _U))
    return out


def _signed(x) -> np.ndarray:
    return np.asarray(x, _U).view(np.int64)


def _segments(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens in one array, which sets have any, and where those begin."""
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    return np.concatenate(sets) if len(full) else np.zeros(0, _U), full, (np.cumsum(sizes) - sizes)[full]


def _min_hashes(tokens: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """[set, hash]: the least token of every set under different orders, 32 bits of it."""
    out = np.empty((len(begin), HASHES), np.int32)
    for k in range(HASHES):
        least = np.minimum.reduceat(tokens * _U((2 * k + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1), begin)
        out[:, k] = (mix64(least) >> _U(32)).astype(np.uint32).view(np.int32)
    return out


_SETS = "doc_id long, n long, s1 long, s2 long, mins array<int>, cell int, counts binary"


def _pack(counts: np.ndarray) -> bytes:
    """Counters, one byte each if they fit, compressed."""
    narrow = counts.astype("u1" if counts.max() < 256 else "<u4")
    return bytes([narrow.itemsize]) + zlib.compress(narrow.tobytes(), 1)


def _summaries(n: int):
    """Per document: set size, two signatures of the set, minimum hashes; per task: its sketch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
            for b in batches:
                for lo, hi in pieces(b["text"].tolist(), _PIECE):
                    part = b.iloc[lo:hi]
                    sets = _doc_sets(part["text"].tolist(), n)
                    tokens, full, begin = _segments(sets)
                    sums, mins = np.zeros((2, len(sets)), np.int64), [[]] * len(sets)
                    if len(full):
                        np.add.at(sketch, (tokens >> _U(64 - SKETCH_BITS)).astype(np.int64), 1)
                        for k, x in enumerate((tokens, mix64(tokens ^ _U(0x5851F42D4C957F2D)))):
                            sums[k, full] = np.add.reduceat(x, begin).view(np.int64)
                        for i, own in zip(full, _min_hashes(tokens, begin)):
                            mins[i] = own
                    yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n": [len(s) for s in sets],
                                        "s1": sums[0], "s2": sums[1], "mins": mins, "cell": None, "counts": None})
            size = len(sketch) // CELLS
            cells = [c for c in range(CELLS) if sketch[c * size:(c + 1) * size].any()]
            packed = [_pack(sketch[c * size:(c + 1) * size]) for c in cells]
            if cells:
                yield pd.DataFrame({"doc_id": pd.array([None] * len(cells), "Int64"), "n": 0, "s1": 0, "s2": 0,
                                    "mins": [[]] * len(cells), "cell": cells, "counts": packed})
    return run


def _add_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sum the packed counters cell by cell; a partition holds all rows of its cells."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for cell, packed in zip(b["cell"], b["counts"]):
            c = np.frombuffer(zlib.decompress(packed[1:]), f"<u{packed[0]}").astype(np.int64)
            total[cell] = total[cell] + c if cell in total else c
    if total:
        # sixteen steps to a doubling: rare counts stay apart, large ones need no precision
        level = [np.minimum(255, np.rint(16 * np.log2(1 + c))).astype(np.uint8).tobytes() for c in total.values()]
        yield pd.DataFrame({"cell": list(total), "level": level})


def _frequency_levels(summaries: DataFrame) -> np.ndarray:
    """uint8 level of every sketch counter: 16 MB, a fixed size for any corpus."""
    cells = summaries.where("cell is not null").select("cell", "counts").repartition(16, "cell") \
        .mapInPandas(_add_cells, "cell int, level binary").toPandas()
    size = (1 << SKETCH_BITS) // CELLS
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for c, x in zip(cells["cell"], cells["level"]):
        out[c * size:(c + 1) * size] = np.frombuffer(x, np.uint8)
    return out


def _prefixes(n: int, percent: int, levels):
    """Every document's rarest tokens, enough to meet any document it links to."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level = levels.value
        with np.errstate(over="ignore"):
            for b in batches:
                for lo, hi in pieces(b["text"].tolist(), _PIECE):
                    part = b.iloc[lo:hi]
                    tokens, ids, sizes = [], [], []
                    for doc, s in zip(part["doc_id"], _doc_sets(part["text"].tolist(), n)):
                        if len(s) and not pd.isna(doc):
                            size = len(s) - -(-percent * len(s) // 100) + 1
                            order = np.argsort(level[(s >> _U(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                            tokens.append(_signed(s[order[:size]]))
                            ids.append(int(doc))
                            sizes.append(len(s))
                    if ids:
                        yield pd.DataFrame({"doc_id": ids, "n": sizes, "tokens": tokens})
    return run


def _crossing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of tokens that several groups have; input sorted by token and group.

    A token's rows may run over many batches.  As long as they are of one group,
    only their summary is held: the least position for every set size.
    """
    held, crossed = None, None  # rows of an unfinished token with one group so far; a token known to cross
    for b in batches:
        if held is not None:
            b = pd.concat([held, b], ignore_index=True)
            held = None
        token, grp = b["token"].to_numpy(), b["grp"].to_numpy()
        begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        end = np.append(begin[1:], len(token))
        cross = grp[begin] != grp[end - 1]
        cross[0] |= token[0] == crossed
        if cross[-1]:
            crossed = token[-1]
        else:
            held = b.iloc[begin[-1]:].groupby(["token", "grp", "n"], as_index=False).agg({"i": "min"})
            held["rep"] = pd.array([None] * len(held), "Int64")
        out = b[np.repeat(cross, end - begin)]
        if len(out):
            yield out[["token", "rep", "n", "i", "grp"]].astype({"rep": "Int64"})


def _packed_sets(n: int, wanted):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(np.frombuffer(wanted.value, np.uint8))
        with np.errstate(over="ignore"):
            for b in batches:
                b = b[bits[b["slot"].to_numpy()].astype(bool)]
                for lo, hi in pieces(b["text"].tolist(), _PIECE):
                    part = b.iloc[lo:hi]
                    yield pd.DataFrame({"doc_id": part["doc_id"], "tokens": [
                        s.tobytes() for s in _doc_sets(part["text"].tolist(), n)]})
    return run


def _shared(small: np.ndarray, large: np.ndarray) -> int:
    """Size of the intersection of two sorted sets, neither empty."""
    at = np.searchsorted(large, small)
    return int((large[np.minimum(at, len(large) - 1)] == small).sum())


def _meets(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    small, large = (p, q) if len(p) <= len(q) else (q, p)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    both = _shared(small, large)
    return 100 * both >= percent * (len(p) + len(q) - both)


def _linked(percent: int):
    """Pairs of packed sets that meet the threshold."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = [_meets(np.frombuffer(x, _U), np.frombuffer(y, _U), percent) for x, y in zip(b["x"], b["y"])]
            yield b.loc[keep, ["a", "b"]]
    return run


def _bound_and_open(percent: int):
    """Links of the classes that found a group (chunk) to one of its members each."""
    def run(asking: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        sets = [(b, np.frombuffer(y, _U)) for b, y in zip(members["b"], members["y"])]
        links = []
        if sets and len(asking):
            union = np.unique(np.concatenate([y for _, y in sets])) if len(sets) > 1 else sets[0][1]
            for a, x in zip(asking["a"], asking["x"]):
                x = np.frombuffer(x, _U)
                if len(x) and len(union) and 100 * _shared(x, union) >= percent * len(x):
                    links += next(([(a, b)] for b, y in sets if _meets(x, y, percent)), [])
        return pd.DataFrame(links, columns=["a", "b"])
    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b)`` of the given distinct pairs of class ids that link."""
    x = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y"))
    # many pairs share their second end: that side's rows are skew-split by adaptive execution
    return pairs.select("a", "b").join(x, "a").join(y, "b").mapInPandas(_linked(percent), "a long, b long")


def _sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """Stored ``(doc_id, tokens)`` of at least the classes in ``ids``.

    The ids go out as a bit filter of a fixed size: few sets that are not wanted
    pass it, and neither texts nor ids are shuffled.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    cells = ids.select(slot.alias("slot")).distinct().select(
        F.floor(F.col("slot") / 32768).alias("cell"), F.col("slot") % 32768).toDF("cell", "bit") \
        .groupBy("cell").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    wanted = np.zeros(FILTER_BITS, np.uint8)
    for r in cells:
        wanted[r["cell"] * 32768:(r["cell"] + 1) * 32768] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted).tobytes())
    texts = docs.where("doc_id is not null").withColumn("slot", slot)
    return stored(texts.mapInPandas(_packed_sets(n, shared), "doc_id long, tokens binary"), "sets")


def _group_links(classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Verified links of classes to leaders of their minimum-hash bands."""
    bands = F.array(*[F.xxhash64(F.lit(k), *[F.col("mins")[k + j] for j in range(BAND)])
                      for k in range(0, HASHES - BAND + 1, BAND)])
    keyed = classes.select("rep", "n", "mins", F.explode(bands).alias("key"))
    # a key that one class has groups nothing
    shared = keyed.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key")
    member = stored(keyed.join(shared, "key").distinct(), "bands")
    pairs = None
    for _ in range(ROUNDS):
        leader = member.groupBy("key").agg(F.min_by(F.struct("rep", "n", "mins"), "rep").alias("l"))
        agree = F.size(F.filter(F.zip_with("mins", "l.mins", lambda x, y: x == y), lambda same: same))
        close = member.join(leader, "key").where("rep <> l.rep").where(
            (agree >= AGREE) & (100 * F.least("n", "l.n") >= percent * F.greatest("n", "l.n")))
        found = stored(close.select(F.col("rep").alias("a"), F.col("l.rep").alias("b")).distinct(), "pairs")
        pairs = found if pairs is None else pairs.union(found)
        # the next leader of a key is found among classes that no leader has taken
        taken = found.select(F.col("a").alias("rep")).union(leader.select("l.rep")).distinct()
        member = stored(member.join(taken, "rep", "left_anti"), "bands")
    pairs = stored(pairs.distinct(), "pairs")
    sets = _sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), n)
    links = stored(_links(pairs, sets, percent), "group_links")
    discard(sets)  # the largest table so far, and the links do not need it
    return links


def jaccard_classes(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, a row for every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    summaries = stored(docs.mapInPandas(_summaries(n), _SETS), "summaries")
    rows = summaries.where("cell is null")
    classes = stored(rows.where("n > 0").groupBy("n", "s1", "s2").agg(
        F.min("doc_id").alias("rep"), F.first("mins").alias("mins")).where("rep is not null"), "classes")

    group_links = _group_links(classes, docs, n, percent)
    grouped = connected_components(group_links)
    member = stored(classes.select("rep").distinct().join(grouped, F.col("rep") == F.col("node"), "left")
                    .select("rep", F.coalesce("component", "rep").alias("grp")), "groups")

    # token-group matrix over the tokens to look up
    spark = docs.sparkSession
    levels = spark.sparkContext.broadcast(_frequency_levels(summaries))
    rare = docs.mapInPandas(_prefixes(n, percent, levels), "doc_id long, n int, tokens array<long>")
    rare = rare.join(member.select("rep", "grp"), F.col("doc_id") == F.col("rep"))
    rare = rare.select("rep", "n", "grp", F.posexplode("tokens").alias("i", "token"))
    # only tokens of two groups can lead from one group to another
    crossing = rare.repartition("token").sortWithinPartitions("token", "grp") \
        .mapInPandas(_crossing, "token long, rep long, n int, i int, grp long")
    crossing = stored(crossing, "crossing")
    matrix = crossing.groupBy("token", F.col("grp").alias("other"), F.col("n").alias("m")).agg(F.min("i").alias("j"))
    # links are mutual, so it is enough that a class looks into groups before its own
    needed = percent * (F.col("n").cast("long") + F.col("m"))
    found = crossing.where("rep is not null").join(matrix, "token").where(
        (F.col("other") < F.col("grp")) & ((100 + percent) * (F.col("n").cast("long") - F.col("i")) >= needed)
        & ((100 + percent) * (F.col("m").cast("long") - F.col("j")) >= needed))
    found = stored(found.select("rep", "other").distinct(), "found")

    # the found groups' members in chunks, and each class that found a group at all of its chunks
    sizes = member.join(found.select(F.col("other").alias("grp")).distinct(), "grp", "left_semi") \
        .groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    inside = stored(member.join(sizes, "grp").select(
        F.col("grp").alias("other"), F.pmod(F.xxhash64("rep"), "chunks").alias("chunk"), F.col("rep").alias("b")), "inside")
    asking = stored(found.join(sizes.withColumnRenamed("grp", "other"), "other").select(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"),
        F.col("rep").alias("a")), "asking")
    sets = _sets_of(docs, inside.select(F.col("b").alias("doc_id")).union(asking.select("a")).distinct(), n)
    asking = asking.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a")
    inside = inside.join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b")
    opened = asking.groupBy("other", "chunk").cogroup(inside.groupBy("other", "chunk")) \
        .applyInPandas(_bound_and_open(percent), "a long, b long")
    links = group_links.union(opened)

    label = connected_components(links)
    named = classes.join(label, F.col("rep") == F.col("node"), "left") \
        .select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("doc_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
