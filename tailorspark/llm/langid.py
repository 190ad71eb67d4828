"""Language identification by compression.

Every language gets one zstandard raw-content dictionary made of labelled text.
A text is encoded once per dictionary and belongs to the language whose
dictionary makes it smallest; if the runner-up is almost as small the margin is
narrow and the text is rejected.

Texts are reduced to their letters (lower case, everything else one space, each
word once per text) before encoding, so numbers, markup noise and repeated
words do not decide.  A long text is encoded in pieces of ``CHUNK`` bytes whose
sizes add up: otherwise its own beginning would soon serve as dictionary and
the languages' differences would drown.

Defined results: null text, or text without a letter -> ``und``, score 0,
rejected.  Equal sizes -> alphabetically first language, margin 0, rejected.
No labelled row at all -> every text is ``und``.  A null doc_id is never learned
from.  Rows keep their multiplicity;
columns besides those named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
#: Bound of the fitted sample: labelled documents per language, and bytes of letters taken from each.  All of them are
#: the dictionary, 256 KB at most.
SAMPLE_ROWS = 320
SAMPLE_BYTES = 818
CHUNK = 4096
LEVEL = 3
#: Reject when the runner-up is less than this fraction larger.
MIN_MARGIN = 0.002

_LETTERS = None


def _words(text: str | None) -> str:
    """Distinct lower-case letter runs of ``text`` in order, space-separated."""
    global _LETTERS
    if _LETTERS is None:
        import regex
        _LETTERS = regex.compile(r"[^\p{L}]+")
    return " ".join(dict.fromkeys(_LETTERS.sub(" ", (text or "").lower()).split()))


def _sample_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        cut = [_words(t).encode()[:SAMPLE_BYTES] for t in b["text"]]
        yield pd.DataFrame({"lang": b["lang"], "h": b["h"], "piece": cut})


def fit_dictionaries(docs: DataFrame, usable: Column, rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """{language: dictionary content} from labelled rows where ``usable`` holds.

    Per language the ``rows`` usable documents with the smallest id hash, at most
    ``SAMPLE_BYTES`` of letters each: what reaches the driver is bounded by
    languages x rows x bytes whatever the corpus size.  Of several texts under one
    doc_id and language the smallest is taken, once.
    """
    spark = docs.sparkSession
    h = F.xxhash64(F.col("doc_id").cast("string"))
    labelled = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # choose ids first: this pass reads two narrow columns, the texts of the chosen few come after
    chosen = labelled.select("doc_id", "lang", h.alias("h"))
    # first within slices of a language, so that one language of all rows has many tasks, then over the slices
    for slices in (64, 1):
        order = Window.partitionBy("lang", F.pmod("h", F.lit(slices))).orderBy("h", "doc_id")
        chosen = chosen.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows)
    chosen = chosen.select("doc_id", "h").distinct().toPandas()
    if chosen.empty:
        return {}
    ids = spark.createDataFrame([(int(i), int(x)) for i, x in zip(chosen["doc_id"], chosen["h"]) if not pd.isna(i)],
                                "doc_id long, h long")
    # at most languages x rows ids were collected above, so this side is small by construction
    picked = labelled.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id")
    picked = picked.groupBy("doc_id", "lang", "h").agg(F.min("text").alias("text"))  # however often a document occurs
    pieces = picked.select("lang", "h", "text").mapInPandas(_sample_text, "lang string, h long, piece binary").toPandas()
    out = {}
    for lang, g in pieces.sort_values(["lang", "h", "piece"]).groupby("lang"):
        content = b" ".join(bytes(p) for p in g["piece"] if p)
        if content:
            out[lang] = content
    return out


class _Coder:
    """Encoded size of a text under each language's dictionary."""

    def __init__(self, content: dict[str, bytes]):
        import zstandard as zs
        self.langs = sorted(content)
        self.coders = []
        for lang in self.langs:
            d = zs.ZstdCompressionDict(content[lang], dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zs.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False,
                                                 write_checksum=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, margin, score)."""
        words = _words(text)
        if not words or not self.langs:
            return UNKNOWN, 0.0, 0.0
        raw = f" {words} ".encode()
        pieces = [raw[i:i + CHUNK] for i in range(0, len(raw), CHUNK)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in self.coders]
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        best = order[0]
        if len(order) == 1:
            return self.langs[best], 1.0, 1.0
        margin = 1.0 - sizes[best] / sizes[order[1]]
        return self.langs[best], margin, 1.0 - math.exp(-20.0 * margin)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text",
             min_margin: float = MIN_MARGIN) -> DataFrame:
    """Add ``lang_pred``, ``score`` (0..1), ``margin`` and ``rejected`` to ``docs``.

    A map-only pass over the texts; the dictionaries (a fixed size per language)
    travel with the task.  Columns of those names in ``docs`` are replaced.
    """
    added = ["lang_pred", "score", "margin", "rejected"]
    kept = [c for c in docs.columns if c not in added]
    content = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _Coder(content.value)
        for b in batches:
            found = [coder.predict(t) for t in b[text_col]]
            b["lang_pred"] = [f[0] for f in found]
            b["score"] = [f[2] for f in found]
            b["margin"] = [f[1] for f in found]
            b["rejected"] = [f[0] == UNKNOWN or f[1] < min_margin for f in found]
            yield b

    src = docs.select(*[F.col(f"`{c}`") for c in kept])
    kinds = (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*src.schema.fields, *map(T.StructField, added, kinds)])
    return src.mapInPandas(run, schema)
