"""HTML main-text extraction with wrappers inferred per host (``wrapper``).

A host may have several templates.  Pages of a host share one if they have the
same containers (``template_of``); each template has its wrapper.

1. Every task folds its pages into one wrapper per template, page by page.
2. Partial wrappers of a template meet in groups of ``FAN_IN``, level by level,
   until one is left: a host with a third of all pages sends one small wrapper
   per task and template, and no task sees more than ``FAN_IN`` of them.
3. The wrapper's nodes are judged once - by the elements and names around them,
   by how they vary over the template's pages, by links - and every page is
   aligned with its wrapper to take the texts of the article's nodes.  What the
   wrapper does not know, and a page of which it takes nothing, is judged by the
   page alone.

Defined results: null or empty html -> empty text.  Pages without a host (null
or relative url) count as pages of one host.  Rows repeat as they come; other columns of
``pages`` pass through (one named ``text`` or ``n_chars`` is replaced).  Broken
markup: elements never closed reach to the end, unmatched ends are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tailorspark.llm import wrapper as W
from tailorspark.llm.store import stored

FAN_IN = 32
#: Templates a task keeps before it sends on what it has.
_KEPT = 2000


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def template_of(html: Column) -> Column:
    """Number of the set of layout containers in a page: their elements, classes and ids, without digits."""
    opened = F.regexp_extract_all(F.lower(html), F.lit(r"<(?:article|main|section|aside|nav|header|footer|form|div)\b[^>]*"), F.lit(0))
    named = F.transform(opened, lambda o: F.concat(
        F.regexp_extract(o, "^<([a-z]+)", 1),
        *[F.concat(F.lit(" "), F.regexp_replace(F.regexp_extract(o, rf"\s{a}\s*=\s*(\"[^\"]*|'[^']*|[^\s\"'>]*)", 1), "[^a-z]+", " "))
          for a in ("class", "id")]))
    return F.xxhash64(F.array_sort(F.array_distinct(named)))


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part = TaskContext.get().partitionId()
    found: dict[tuple[str, int], list] = {}

    def rows() -> pd.DataFrame:
        return pd.DataFrame({"host": [h for h, _ in found], "template": [t for _, t in found], "part": part,
                             "nodes": [json.dumps(n) for n in found.values()]})

    for b in batches:
        for host, template, page in zip(b["host"], b["template"].tolist(), b["html"]):
            own = W.without_positions(W.page_wrapper(list(W.parse(page))))
            key = host, template
            found[key] = W.merge(found[key], own) if key in found else own
            if len(found) > _KEPT:
                yield rows()
                found = {}
    if found:
        yield rows()


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    nodes = None
    for n in rows.sort_values(["part", "nodes"])["nodes"]:
        nodes = json.loads(n) if nodes is None else W.merge(nodes, json.loads(n))
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "template": [rows["template"].iloc[0]],
                         "part": [rows["part"].min() // FAN_IN], "nodes": [json.dumps(nodes)]})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``(host, template, nodes)``: one wrapper per template of ``pages`` (url, html), stored."""
    schema = "host string, template long, part long, nodes string"
    found = stored(pages.where("html <> ''").select(
        host_of(F.col("url")).alias("host"), template_of(F.col("html")).alias("template"), "html")
        .mapInPandas(_partial, schema), "wrappers")
    while found.groupBy("host", "template").count().where("count > 1").limit(1).count():
        group = F.floor(F.col("part") / FAN_IN)
        found = stored(found.groupBy("host", "template", group).applyInPandas(_merge, schema), "wrappers")
    return found.select("host", "template", "nodes")


def extract(pages: DataFrame) -> DataFrame:
    """Add ``text`` and ``n_chars`` (code points) to every row of ``pages`` (url, html, any others)."""
    kept = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in ("text", "n_chars")])
    # the wrappers are a stored table: Spark broadcasts it if it is small, else joins by host, splitting hot ones
    wrappers = infer_wrappers(pages).select(F.col("host").alias("_host"), F.col("template").alias("_template"),
                                            F.col("nodes").alias("_nodes"))
    joined = kept.withColumns({"_host": host_of(F.col("url")), "_template": template_of(F.col("html"))}).join(
        wrappers, ["_host", "_template"], "left").drop("_host", "_template")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: dict[str, tuple] = {}
        for b in batches:
            texts = []
            for page, nodes in zip(b["html"], b.pop("_nodes")):
                if not isinstance(page, str) or not page or nodes is None:
                    texts.append("")
                    continue
                if nodes not in ready:
                    if len(ready) > _KEPT:
                        ready.clear()
                    w = json.loads(nodes)
                    ready[nodes] = w, W.label(w)
                texts.append(W.article(list(W.parse(page)), *ready[nodes]))
            b["text"] = texts
            b["n_chars"] = [len(t) for t in texts]
            yield b

    schema = T.StructType([*kept.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return joined.mapInPandas(run, schema)
