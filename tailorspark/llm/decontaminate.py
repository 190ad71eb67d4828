"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts are lower-cased (A-Z) and split into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
A *window* is ``WINDOW`` consecutive words of a benchmark item; an item of fewer
words is one window.  A document word inside any occurrence of a window is hit.

1. *Fingerprints.*  Every run of ``GRAM`` words is hashed, and of every
   ``WINDOW - GRAM + 1`` consecutive hashes the least is kept.  Two texts that
   share ``WINDOW`` words in a row share the least hash of that stretch, so no
   shared window is missed.  Short items are found by their first 8, 4, 2 or 1
   words instead.
2. *Join.*  Distinct training fingerprints are joined with the benchmark's.  The
   benchmark side is a stored table, so Spark knows its size and broadcasts it
   only below its own threshold; otherwise both sides are shuffled by hash.
3. *Extend.*  Texts with a shared fingerprint are compared window by window (two
   independent 64-bit hashes of the words), and the occurrences' word ranges are
   merged.

Runs of hashes are built by doubling (a run of 8 from two runs of 4), as array
functions on one document's row: no word becomes a row of its own before the
join.  Texts are identified by their md5 from there on, so copies are extended
once.

Defined results: null or wordless text -> 0 words, not contaminated.  Benchmark
rows with null id or no word are ignored; an id on several rows is one item.
Repeated documents, also with null id, are answered row by row.  An empty
benchmark contaminates nothing.  Other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailorspark.llm.store import stored

WINDOW = 13
GRAM = 8
#: Separators between words of lower-cased text, and of text as it is.
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SEPARATORS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _split(text: Column, separators: str) -> Column:
    """Words of a non-null text; split leaves an empty string at an end that is a separator."""
    parts = F.split(text, separators)
    first = F.when(F.element_at(parts, 1) == "", 2).otherwise(1)
    n = F.size(parts) - first + 1 - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.slice(parts, first, n)


def _lowered(text: Column) -> Column:
    """A-Z to a-z and nothing else; the fast built-in is the same on pure ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _runs(df: DataFrame, source: str, width: int, out: str, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """Add array ``out``: ``combine`` over every ``width`` consecutive elements of ``source``.

    By doubling; the last step may overlap, which a minimum does not notice and
    a hash still determines.  Only the first ``size - width + 1`` elements mean anything.
    """
    def step(df: DataFrame, a: str, shift: int, to: str) -> DataFrame:
        later = F.slice(F.col(a), shift + 1, F.size(a))
        return df.withColumn(to, F.zip_with(F.col(a), later, combine))

    have, name = 1, source
    while have * 2 <= width:
        df = step(df, name, have, f"{out}_{have * 2}")
        name, have = f"{out}_{have * 2}", have * 2
    return step(df, name, width - have, out) if have < width else df.withColumn(out, F.col(name))


def _pair(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _low(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _trim(array: str, width: int) -> Column:
    """The elements of a run array that lie wholly inside the text of ``n`` words."""
    return F.slice(F.col(array), 1, F.greatest(F.col("n") - (width - 1), F.lit(0)))


def _hashed(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, word count ``n`` and word hashes ``h`` (second hashes: see ``_windows``)."""
    words = df.select(*keep, _split(_lowered(F.coalesce("text", F.lit(""))), _SEPARATORS).alias("w"))
    return words.select(*keep, F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"), "w")


def _fingerprints(df: DataFrame, keep: list[str], window: int, gram: int, short: list[int]) -> DataFrame:
    """``keep`` and one row per distinct fingerprint ``f``; ``short``: lengths of short items."""
    d = _runs(_hashed(df, keep).drop("w"), "h", gram, "g", _pair)
    d = _runs(d, "g", window - gram + 1, "m", _low)
    parts = [F.array_distinct(_trim("m", window))]
    for width in sorted({1 << (s.bit_length() - 1) for s in short}):
        d = _runs(d, "h", width, f"s{width}", _pair)
        parts.append(F.array_distinct(_trim(f"s{width}", width)))
    return d.select(*keep, F.explode(parts[0] if len(parts) == 1 else F.concat(*parts)).alias("f"))


def _windows(df: DataFrame, keep: list[str], widths: list[int]) -> DataFrame:
    """Every run of each width: ``keep``, ``n``, position, width and two independent hashes."""
    d = _hashed(df, keep).withColumn("k", F.transform("w", lambda x: F.xxhash64(F.lit("second"), x))).drop("w")
    out = None
    for width in widths:
        r = _runs(_runs(d, "h", width, "a", _pair), "k", width, "b", _pair)
        r = r.select(*keep, "n", F.posexplode(F.arrays_zip(_trim("a", width).alias("a"), _trim("b", width).alias("b"))))
        r = r.select(*keep, "n", F.col("pos").cast("long").alias("pos"), F.lit(width).alias("width"),
                     F.col("col.a").alias("a"), F.col("col.b").alias("b"))
        out = r if out is None else out.union(r)
    return out


def text_key(text: Column) -> Column:
    """Identifies a text (null as empty)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``(doc_id, text_md5, n_words, n_hit, n_items, items, contaminated)`` for every row of ``docs``.

    ``docs``: doc_id, text; ``benchmark``: item_id, text.  ``items``: sorted item
    ids as strings.  Contaminated: any hit, and hits at least a twentieth of the words.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("key", text_key(F.col("text")))
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", "text")
    lengths = items.select(F.size(_split(_lowered(F.coalesce("text", F.lit(""))), _SEPARATORS)).alias("n"))
    # at most window - 1 distinct values
    short = sorted(r["n"] for r in lengths.where((F.col("n") > 0) & (F.col("n") < window)).distinct().collect())

    wide = _windows(items, ["item_id"], [window, *short])
    # a short width only stands for items that are no longer
    wide = stored(wide.where((F.col("width") == window) | (F.col("n") == F.col("width")))
                  .select("item_id", "width", "a", "b").distinct(), "windows")
    fingers = _fingerprints(items, ["item_id"], window, gram, short)
    fingers = stored(fingers.select("f").distinct(), "fingerprints")

    key_rows = _fingerprints(docs.select("key", "text"), ["key"], window, gram, short)
    suspects = stored(key_rows.join(fingers, "f", "left_semi").select("key").distinct(), "suspects")

    texts = docs.join(suspects, "key", "left_semi").dropDuplicates(["key"]).select("key", "text")
    there = _windows(texts, ["key"], [window, *short])
    known = wide.select("width", "a", "b").distinct()
    hits = stored(there.join(known, ["width", "a", "b"]).select("key", "pos", "width", "a", "b"), "hits")

    # union of word ranges: each adds what lies beyond all ranges that begin before it
    before = Window.partitionBy("key").orderBy("pos", "width").rowsBetween(Window.unboundedPreceding, -1)
    ranges = hits.groupBy("key", "pos").agg(F.max("width").alias("width"))
    fresh = ranges.withColumn("reached", F.max(F.col("pos") + F.col("width")).over(before))
    fresh = fresh.withColumn("add", F.greatest(
        F.lit(0), F.col("pos") + F.col("width") - F.greatest(F.col("pos"), F.coalesce("reached", F.lit(0)))))
    n_hit = fresh.groupBy("key").agg(F.sum("add").alias("n_hit"))
    named = hits.select("key", "width", "a", "b").distinct().join(wide, ["width", "a", "b"])
    named = named.groupBy("key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    found = stored(n_hit.join(named, "key"), "found")

    counted = docs.select("doc_id", "key", F.size(_split(F.col("text"), _SEPARATORS_ANY_CASE)).cast("long").alias("n_words"))
    out = counted.join(found, "key", "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    none = F.array().cast("array<string>")
    return out.select("doc_id", F.col("key").alias("text_md5"), "n_words", hit.alias("n_hit"),
                      F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
                      F.coalesce("items", none).alias("items"),
                      ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"))
