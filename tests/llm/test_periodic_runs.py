import hashlib
import random
import re
import zlib

import numpy as np
from util import DOCS, docs, rows

from tailorspark.llm import periodic_runs, queries
from tailorspark.llm.recompression import Grammar

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    """Runs by comparing every word with the one q further on, for every q."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                found.setdefault((start, i + q - start), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def contract(doc_id, text):
    """The query's row, written from its definition."""
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *top, top[1] and 1000 * top[1] // top[2], sha("".join("%d,%d,%d\n" % r for r in runs)),
            sha(" ".join(kept)))


def some_texts(n):
    rng = random.Random(5)
    out = ["", None, "a", "a " * 11, "a " * 12, "x " + "ab cd " * 6 + "ab", "b\u00e9 \u4e2d\t" * 9, " ".join("abcdef") + " abcdef"]
    while len(out) < n:
        size, kinds = rng.randint(1, 150), rng.choice([1, 2, 3, 8, 60])
        w = [f"w{rng.randrange(kinds)}" for _ in range(size)]
        if rng.random() < 0.5:
            a, p = rng.randrange(size), rng.randint(1, 20)
            w[a:] = [w[a + (i - a) % p if a + (i - a) % p < size else a] for i in range(a, size)]
        out.append(rng.choice([" ", "\n", "\u00a0 "]).join(w))
    return out


def test_extensions_equal_symbol_by_symbol_comparison():
    rng = np.random.default_rng(3)
    for kinds in (1, 2, 5, 40):
        x = np.concatenate([[90], rng.integers(0, kinds, 300), np.tile(rng.integers(0, kinds, 7), 40), [91]])
        g = Grammar(x)
        i = rng.integers(1, len(x) - 1, 400)
        j = rng.integers(1, len(x) - 1, 400)
        i, j = np.minimum(i, j), np.maximum(i, j)
        i, j = i[i < j], j[i < j]
        for a, b, ahead, behind in zip(i, j, g.right(i, j), g.left(i, j)):
            n = 0
            while b + n < len(x) and x[a + n] == x[b + n]:
                n += 1
            m = 0
            while a - m >= 0 and x[a - m] == x[b - m]:
                m += 1
            assert (ahead, behind) == (n, m)


def test_runs_equal_brute_force():
    texts = [WORD.findall(t or "") for t in some_texts(300)]
    for words, got in zip(texts, periodic_runs.runs_of(texts)):
        assert [tuple(r) for r in got.tolist()] == brute(words)
    short = periodic_runs.runs_of(texts, min_words=4)
    assert all([tuple(r) for r in got.tolist()] == brute(words, 4) for words, got in zip(texts, short))


def test_query_equals_its_definition(spark, tmp_path):
    texts = some_texts(400)
    ids = [*range(398), 7, -10]  # a repeated doc_id, a negative one
    docs(spark, texts, ids).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(queries.op13_periodic_runs(spark, str(tmp_path)), "doc_id", "n_runs", "start", "length", "period",
               "exponent_milli", "runs_sha256", "collapsed_sha256")
    want = sorted((contract(i, t) for i, t in zip(ids, texts)), key=lambda r: tuple((x is not None, x) for x in r))
    assert got == want
    assert sum(r[1] > 0 for r in got) > 50


def test_long_text_in_two_batches_of_pieces(spark, monkeypatch):
    tail = "p q r s t " * 20000
    text = " ".join(f"u{i}" for i in range(50000)) + " " + tail
    out = periodic_runs.periodic_runs(docs(spark, [text, "a b", text])).collect()
    for r in (out[0], out[2]):
        assert [tuple(x) for x in r["runs"]] == [(50000, 100000, 5)]
        assert r["n_words"] == 150000 and r["collapsed"].endswith("u49999 p q r s t")
    assert out[1]["runs"] == [] and out[1]["collapsed"] == "a b"


def test_empty_table_null_id_and_clashing_columns(spark):
    assert periodic_runs.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0
    odd = spark.createDataFrame([(None, "z " * 20, "mine", 3)], "doc_id long, text string, runs string, keep int")
    r = periodic_runs.periodic_runs(odd).first()
    assert r["doc_id"] is None and r["keep"] == 3 and [tuple(x) for x in r["runs"]] == [(0, 20, 1)] and r["collapsed"] == "z"
    named = odd.withColumnRenamed("text", "collapsed")
    assert periodic_runs.periodic_runs(named, "collapsed").first()["collapsed"] == "z"
