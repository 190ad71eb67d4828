import random

import pytest

from tailorspark.llm.components import connected_components
from tailorspark.llm.jaccard_join import jaccard_classes
from util import docs, rows


def brute(items, n=4, percent=85):
    """{(doc_id, text): (size, component)} by comparing everything with everything."""
    sets = []
    for i, t in items:
        w = tuple("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")).encode().split())
        sets.append({w[k:k + n] for k in range(len(w) - n + 1)} if len(w) >= n else ({w} if w else set()))
    comp = {i: i for i, _ in items if i is not None}
    changed = True
    while changed:
        changed = False
        for a in range(len(items)):
            for b in range(a):
                i, j, x, y = items[a][0], items[b][0], sets[a], sets[b]
                if i is None or j is None or not x or not y or comp[i] == comp[j]:
                    continue
                if 100 * len(x & y) >= percent * len(x | y):
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return [(i, len(s), comp.get(i)) for (i, _), s in zip(items, sets)]


def check(spark, items):
    got = rows(jaccard_classes(docs(spark, [t for _, t in items], ids=[i for i, _ in items])))
    assert got == sorted(brute(items), key=lambda r: tuple((x is not None, x) for x in r))


def test_edge_cases(spark):
    base = " ".join(f"w{k}" for k in range(40))
    check(spark, [(3, base), (9, base.upper()), (5, base + " x"), (6, None), (7, ""), (8, " \n\t"), (10, "a b"),
                  (11, "A  B"), (12, "b a"), (13, "é É"), (14, "É é"), (3, base)])


def test_empty_table(spark):
    assert jaccard_classes(docs(spark, [])).count() == 0


def test_null_id_takes_the_class_of_an_equal_set(spark):
    got = rows(jaccard_classes(docs(spark, ["a b c d e", "a b c d e", "p q r s t"], ids=[4, None, None])))
    assert got == [(None, 2, None), (None, 2, 4), (4, 2, 4)]


@pytest.mark.parametrize("seed", [1, 2])
def test_families_against_brute_force(spark, seed):
    """Near copies with a few edits around the threshold, a passage that all share, exact copies, chains."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(30)]
    items, doc = [], 0
    for _ in range(6):
        text = [word() for _ in range(rng.randint(30, 120))] + passage
        for _ in range(8):
            edited = list(text)
            for _ in range(rng.randint(0, 4)):
                edited[rng.randrange(len(edited))] = word()
            items.append((doc * 7 % 1009, " ".join(edited)))
            doc += 1
            if rng.random() < 0.3:
                text = edited
    items += [(2000 + k, items[0][1]) for k in range(5)]
    check(spark, items)


def test_hot_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for k in range(300):
        t = list(base)
        t[rng.randrange(200)] = f"edit{k}"
        texts.append(" ".join(t))
    got = rows(jaccard_classes(docs(spark, texts)), "component_id")
    assert got == [(0,)] * 300


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 200)] + [(500, 400), (7, 7), (None, 3)], "a long, b long")
    got = dict(rows(connected_components(edges)))
    assert set(got) == {*range(1, 201), 400, 500}
    assert {got[k] for k in range(1, 201)} == {1} and got[500] == 400
