import json
import random
import re

import pytest

from tailorspark.llm import html_extract, wrapper as W
from util import rows


def extract(pages):
    nodes = None
    for p in pages:
        own = W.without_positions(W.page_wrapper(list(W.parse(p))))
        nodes = W.merge(nodes, own) if nodes else own
    labels = W.label(nodes)
    return [W.article(list(W.parse(p)), nodes, labels) for p in pages]


def words(i, n):
    return " ".join(f"w{i}x{k}" for k in range(n))


def test_article_without_what_surrounds_it():
    page = ("<!DOCTYPE html><html><head><title>T{0}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
            "<nav><ul><li><a href='/a'>Home {0}</a></li></ul></nav><!-- <p>no</p> --><div class='ad'>Buy {0}</div>"
            "<article><h1>Head &amp; {0}</h1><p><b>One\n two<br>three&nbsp;four<p>five <i>s</i>ix</p>"
            "<form><p>Mail?</p></form><section id='comments'><p>Nice {0}</p></section></article>"
            "<footer>&copy; {0}</footer>")
    assert extract([page.format(i) for i in range(3)]) == [f"Head & {i}\nOne two three four\nfive six" for i in range(3)]


def test_without_article_element():
    page = ("<body><div class='top-menu'><a href=/>Home</a></div><div id='wrap'><div class='content'><h2>H{0}</h2><p>{1}</p>{2}"
            "<ul><li>{0} a</li><li>b</li></ul></div><div class='sidebar'><p>{1}</p></div></div>"
            "<div class='cookie-notice'>We use cookies</div><div>All rights reserved</div></body>")
    pages = [page.format(i, words(i, 20), "<blockquote>q</blockquote>" if i % 2 else "") for i in range(6)]
    assert extract(pages) == [f"H{i}\n{words(i, 20)}\n" + ("q\n" if i % 2 else "") + f"{i} a\nb" for i in range(6)]


def test_wrapper_has_slots_repeats_and_optionals():
    pages = [f"<div><h1>t{i}</h1>" + "<div class=row><h2>a</h2><p>b</p></div>" * (i + 1) + ("<pre>x</pre>" if i else "") + "</div>"
             for i in range(3)]
    nodes = None
    for p in pages:
        own = W.without_positions(W.page_wrapper(list(W.parse(p))))
        nodes = W.merge(nodes, own) if nodes else own
    assert [(n[0], n[1]) for n in nodes] == [("o div", 3), ("x h1", 3), ("r o div row", 3), ("x pre", 2), ("c div", 3)]
    assert nodes[1][2][2] == 0 and nodes[3][2][2] != 0


@pytest.mark.parametrize("page", ["", "plain &lt;b&gt;", "<", "<p", "<a href='x>y", "</div></p><p>z", "<script>x", "<!-- x",
                                  "<div " + "a='" * 50, "<p>" * 2000 + "x"])
def test_broken_pages(page):
    assert isinstance(extract([page])[0], str)


def test_table_and_edge_cases(spark):
    art = "<article><p>{}</p></article><footer>f</footer>"
    data = [(1, "http://A.org/x", art.format("one")), (2, "https://u:p@a.org:80/y?z", art.format("two")), (3, "http://a.org", None),
            (4, None, art.format("four")), (5, "no url", ""), (1, "http://A.org/x", art.format("one"))]
    pages = spark.createDataFrame([(*r, "mine") for r in data], "page_id long, url string, html string, text string")
    got = rows(html_extract.extract(pages), "page_id", "text", "n_chars")
    assert got == [(1, "one", 3), (1, "one", 3), (2, "two", 3), (3, "", 0), (4, "four", 4), (5, "", 0)]
    assert rows(html_extract.infer_wrappers(pages), "host") == [("",), ("a.org",)]
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_partial_wrappers_meet_in_levels(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "FAN_IN", 2)
    pages = spark.createDataFrame([(i, "http://h/", f"<article><p>t{i}</p></article><div>n</div>") for i in range(40)],
                                  "page_id long, url string, html string").repartition(9)
    assert html_extract.infer_wrappers(pages).count() == 1
    assert rows(html_extract.extract(pages), "text") == sorted((f"t{i}",) for i in range(40))


def test_host_with_several_templates_keeps_all_text(spark):
    shapes = ["<nav><a href=/>Home</a></nav><article><h1>A{0}</h1><p>{1}</p></article><footer>f</footer>",
              "<div class=content><ul><li>L{0}</li><li>{1}</li></ul></div><footer>f</footer>",
              "<div class=content><h1>M{0}</h1><p>{1}</p><ul><li>x{0}</li></ul><p>after {0}</p><h3>H{0}</h3><p>end {0}</p></div>"
              "<div class=qwzx>All rights reserved</div>"]
    want = ["A{0}\n{1}", "L{0}\n{1}", "M{0}\n{1}\nx{0}\nafter {0}\nH{0}\nend {0}"]
    data = [(i, "http://h.org/", shapes[i % 3].format(i, words(i, 30))) for i in range(60)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(5)
    assert rows(html_extract.infer_wrappers(pages), "host") == [("h.org",)] * 3
    assert rows(html_extract.extract(pages), "page_id", "text") == [(i, want[i % 3].format(i, words(i, 30))) for i in range(60)]


def test_page_that_its_wrapper_gives_nothing_is_judged_alone():
    nodes = W.without_positions(W.page_wrapper(list(W.parse("<div><p>a</p></div>"))))
    labels = dict.fromkeys(W.label(nodes), False)
    assert W.article(list(W.parse("<div><p>b</p></div>")), nodes, labels) == "b"


BLOCKS = ["<h2>{}</h2>", "<p>{}</p>", "<ul><li>{}</li><li>b</li></ul>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>",
          "<table><tr><td>{}</td></tr></table>", "<div class=vqx><p>{}</p><h3>x</h3></div>", "<dl><dt>{}</dt><dd>d</dd></dl>"]


def test_irregular_pages_stop_growing_a_wrapper_and_lose_nothing():
    rng = random.Random(5)
    pages, want = [], []
    for i in range(1000):
        chosen = [(rng.choice(BLOCKS), f"w{i}x{k} {words(i, 4)}") for k in range(rng.randint(1, 25))]
        pages.append("<nav><ul><li>Home</li></ul></nav><article class=zq>" + "".join(b.format(t) for b, t in chosen) + "</article><footer>f</footer>")
        # brute force: markup away, a line for each leaf
        want.append("\n".join(x for b, t in chosen for x in re.split(r"(?:<[^>]*>)+", b.format(t)) if x))
    nodes = None
    for p in pages:
        own = W.without_positions(W.page_wrapper(list(W.parse(p))))
        nodes = W.merge(nodes, own) if nodes else own
    assert len(json.dumps(nodes)) < 2000
    labels = W.label(nodes)
    assert [W.article(list(W.parse(p)), nodes, labels) for p in pages] == want


def test_deep_and_unclosed_containers():
    deep = ["<div>" * n + "<section><p>x" for n in (10, 3000, 2000)]
    assert extract(deep) == ["x"] * 3
    assert extract(["<div><section><p>a</div><p>b", "<div><p>c</section></div></div><p>d"]) == ["a\nb", "c\nd"]
