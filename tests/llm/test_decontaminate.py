import re

from pyspark.sql import functions as F

from tailorspark.llm.decontaminate import contamination
from util import docs, rows

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute(items, texts):
    windows = {}
    for i, t in items:
        w = tuple(words(t))
        for k in range(max(1, len(w) - 12) if w and i is not None else 0):
            windows.setdefault(w[k:k + 13], set()).add(str(i))
    out = []
    for i, t in texts:
        w, hit, found = tuple(words(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if w[k:k + n] in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[w[k:k + n]]
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def check(spark, items, texts):
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = docs(spark, [t for _, t in texts], ids=[i for i, _ in texts])
    got = contamination(table, bench)
    assert rows(got, "doc_id", "n_words", "n_hit", "items", "contaminated") == sorted(
        brute(items, texts), key=lambda r: tuple((x is not None, x) for x in r))


def seq(a, b):
    return " ".join(f"w{k}" for k in range(a, b))


def test_windows_and_short_items(spark):
    items = [(1, seq(0, 20)), (10, seq(5, 40)), (2, "alpha Beta gamma"), (3, "Solo"), (4, None), (5, ""), (6, "..."),
             (None, seq(100, 130)), (7, "one two three four five six seven eight nine"), (2, "again here")]
    texts = [(1, seq(0, 13)), (2, "x " + seq(0, 12) + " y"), (3, seq(3, 30).upper() + " " + seq(0, 400)), (4, None), (5, ""),
             (6, "ALPHA, beta; gamma solo"), (7, "alpha beta"), (8, seq(100, 130)), (1, seq(0, 13)), (None, "solo"),
             (9, "zero one two three four five six seven eight nine ten"), (11, "É solo é"),
             (12, seq(200, 900) + " again here " + seq(1000, 1020)), (13, "againhere")]
    check(spark, items, texts)


def test_unicode_case_is_kept(spark):
    check(spark, [(1, "Éa " * 14)], [(1, "éa " * 20), (2, "Éa " * 20), (3, "ÉA " * 20)])


def test_repeats_inside_a_text(spark):
    check(spark, [(1, "a " * 15), (2, seq(0, 13))], [(1, "a " * 40), (2, (seq(0, 13) + " ") * 3), (3, "a b " * 20)])


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = contamination(docs(spark, ["a b"]), bench).first()
    assert (got["n_words"], got["n_hit"], got["contaminated"]) == (2, 0, False)
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination(docs(spark, []), one).count() == 0


def test_clashing_columns(spark):
    bench = spark.createDataFrame([(1, "a b", "x")], "item_id long, text string, key string")
    table = docs(spark, ["a b c"]).withColumns({"key": F.lit(1), "n_words": F.lit("x"), "w": F.lit(2)})
    assert contamination(table, bench).first()["n_hit"] == 2


def test_other_window_and_gram(spark):
    bench = spark.createDataFrame([(1, seq(0, 12))], "item_id long, text string")
    got = rows(contamination(docs(spark, [seq(2, 7), seq(2, 6)]), bench, window=5, gram=3), "n_hit")
    assert got == [(0,), (5,)]
