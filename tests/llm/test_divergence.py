import random
import re
from collections import Counter, defaultdict

import numpy as np
from util import DOCS, docs, rows

from tailorspark.llm import divergence
from tailorspark.llm.divergence import Forest, _price, _shares, audit

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(table):
    """The audit from its definition; ``table``: (text, lang, source)."""
    table = [tuple(x or "" for x in r) for r in table]
    docs_of, count = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in table:
        words = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        docs_of[lang].update(set(words))
        count[lang, source].update(words)
    out = []
    for lang in docs_of:
        kept = sorted((t for t, n in docs_of[lang].items() if n >= 10), key=lambda t: t.encode())
        groups = sorted({s for _, g, s in table if g == lang})
        whole = Counter()
        for s in groups:
            whole.update({t: count[lang, s][t] for t in kept})

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: share(count[lang, s]) for s in groups}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if count[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


def corpus(n, sources=5):
    rng = random.Random(n)
    words = ["the", "Of", "caf\u00e9", "\u4e2d", "x1y", "it's", "Stra\u00dfe", *(f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))]
    out = [(None, "en", "s0"), ("", None, "s1"), ("the \u0130 \x00 the", "en", None), ("", "zz", "a"), ("1 2", "zz", "b")]
    for _ in range(n):
        source = rng.randrange(sources)
        k = rng.choice([5, 20, len(words)])
        text = rng.choice([" ", "-", "7"]).join(rng.choice(words[source:k + source]) for _ in range(rng.randint(0, 40)))
        out.append((text, rng.choice(["en", "en", "de", "fr"]), f"s{source}"))
    return out


def table(spark, texts):
    return spark.createDataFrame([(i, t, g, s, None) for i, (t, g, s) in enumerate(texts)], DOCS)


def test_audit_equals_its_definition(spark):
    texts = corpus(300)
    got = rows(audit(table(spark, texts)), "lang", "source", "part", "item", "value", "rank")
    assert got == brute(texts)
    assert ("zz", "a", "pair", "b", 0, 1) in got  # a language without kept terms


def test_small_blocks_and_chunks_give_the_same(spark, monkeypatch):
    texts = corpus(200, sources=9)
    for name, value in (("BLOCK", 8), ("CHUNK", 2), ("_PIECE", 16), ("HELD", 20)):
        monkeypatch.setattr(divergence, name, value)
    assert rows(audit(table(spark, texts)), "lang", "source", "part", "item", "value", "rank") == brute(texts)


def test_equal_subtrees_are_one_node_and_one_price():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3, (2, 1000))
    counts[:, 256:512] = 0
    forest = Forest(counts)
    assert forest.leaves.shape == (2, 1000)
    assert len(forest.children[0][0]) <= 16 + 1  # pairs of three counts and the padding
    asked = []
    p, q = _shares(forest.counts, int(counts[0].sum()), 1000), _shares(forest.counts, int(counts[1].sum()), 1000)

    def price(a, b):
        asked.append(len(a))
        return _price(p, q)(a, b)

    value, _, _ = forest.traverse(0, 1, price)
    a, b = p[forest.leaves[0]].astype(object), q[forest.leaves[1]].astype(object)
    assert value == sum((a - b) ** 2 // (a + b))
    assert asked == [len({*zip(counts[0], counts[1])}) + 1]  # every pair of counts once


def test_counts_beyond_64_bits_times_scale():
    assert _shares(np.array([10**12, -1]), 10**13, 5).tolist() == [1 + 10**9 * (10**12 + 2) // (10**13 + 10), 1]


def test_empty_table_and_one_source(spark):
    assert audit(spark.createDataFrame([], DOCS)).count() == 0
    one = audit(docs(spark, ["a b"] * 12))
    assert rows(one, "part", "item") == []


def test_extra_columns_are_ignored(spark):
    frame = docs(spark, ["a b", "b c"] * 12, langs=["en"] * 24).selectExpr("*", "'x' AS term", "1 AS n", "2 AS value", "3 AS rank")
    assert audit(frame).columns == ["lang", "source", "part", "item", "value", "rank"]
