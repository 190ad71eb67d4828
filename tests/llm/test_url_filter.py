import random
import re

from util import rows

from tailorspark.llm import queries, url_filter
from tailorspark.llm.url_filter import ALLOW, BLOCK, host_rule, judge, text_rule

SCHEMA = "page_id long, url string"


def address(url):
    if url is None or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"(?s)([^/?#]*)([^?#]*)(.*)\Z", rest)
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1])
    return host, m[2], m[3]


def brute(url, hosts, texts):
    """Every rule on every address, from the definition."""
    host, path, rest = address(url)
    fits = [(-len(h + p), -len(h), h + p, a) for a, h, p in hosts
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        best = min(fits)
        return host, path, best[2], best[3], None
    hits = sorted((a != BLOCK, t) for a, t in texts
                  if re.search("[^?#]*".join(map(re.escape, t.split("*"))), host + path + rest))
    if hits:
        return host, path, None, ALLOW if hits[0][0] else BLOCK, hits[0][1]
    return host, path, None, ALLOW, None


HOSTS = [*queries.URL_RULES, ("block", "net", ""), ("allow", "good.net", "/a-b/c"), ("block", "xn--a.example.org", "/")]
TEXTS = [(BLOCK, "/ads/"), (BLOCK, "/banner/*/click"), (ALLOW, "?keep="), (BLOCK, "--"), (BLOCK, ".exe?")]


def urls(n):
    rng = random.Random(2)
    out = [None, "", "no scheme", "http://", "://org/", "https://ORG", "https://org/", "https://a.ORG/x", "http://borg/",
           "https://example.org/es/1", "https://www.Example.org/es/", "http://example.org/ES/", "http://example.org/en/12?q#f",
           "http://example.org?x=/es/", "http://a.b.com/fr/x", "http://com/de/", "ftp://com:80/fr/", "http://u@com/de/1",
           "http://x.net/a", "http://good.net/a-b/cde", "http://good.net/a-b/", "http://h/banner/7/click", "http://h/banner/7?/click",
           "http://h/a.exe?", "http://h/x?keep=1&u=/ads/", "http://h/x?keep=1", "http://h/\n/ads/--", "http://org\n/",
           "http://h/" + "long/" * 20000 + "ads/", "http://\u00fc.org/\u00e9", "a://b://c.org/"]
    while len(out) < n:
        host = ".".join(rng.choice(["www", "example", "good", "org", "com", "net", "xn--a", "b"]) for _ in range(rng.randint(1, 4)))
        path = "".join(rng.choice(["/", "/es/", "/en/", "1", "/fr/", "/de/", "ads", "a-b", "/c", "?", "#", "banner", "/click"])
                       for _ in range(rng.randint(0, 6)))
        out.append(f"{rng.choice(['http', 'HTTPS'])}://{host}{path}")
    return out


def test_judge_equals_all_rules_on_all_addresses(spark):
    pages = spark.createDataFrame(list(enumerate(urls(800))), SCHEMA)
    rules = [*(host_rule(*r) for r in HOSTS), *(text_rule(*r) for r in TEXTS)]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["pattern"]) for r in judge(pages, rules).collect()}
    want = {i: brute(u, HOSTS, TEXTS) for i, u in enumerate(urls(800))}
    assert got == want
    assert {v[2] for v in want.values()} >= {"org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/", "net", None}
    assert {v[4] for v in want.values()} >= {t for _, t in TEXTS}


def test_only_rules_of_the_rarest_token_are_candidates(spark):
    frame = spark.createDataFrame([(f"www.example.org/{'es' if i == 3 else 'en'}/{i}",) for i in range(50)], "address string")
    rules = url_filter.rule_table(spark, [host_rule("block", "example.org", "/es/"), host_rule("allow", "example.org"),
                                          text_rule(BLOCK, "--")])
    index = url_filter.rule_index(frame, rules)
    assert rows(index, "name", "token") == [("--", ""), ("example.org", "example"), ("example.org/es/", "es")]
    found = url_filter.candidates(frame, index).groupBy("name").count()
    assert rows(found) == [("--", 50), ("example.org", 50), ("example.org/es/", 1)]


def test_empty_table_no_rules_repeats_and_clashing_columns(spark):
    assert judge(spark.createDataFrame([], SCHEMA), [host_rule("block", "org")]).count() == 0
    twice = spark.createDataFrame([(None, "http://a.org/", "x"), (None, "http://a.org/", "y")], SCHEMA + ", verdict string")
    assert rows(judge(twice, []), "page_id", "rule", "verdict") == [(None, None, ALLOW)] * 2
    assert rows(judge(twice, [host_rule(BLOCK, "A.org")]), "rule", "verdict") == [("a.org", BLOCK)] * 2


def test_general_rules_leave_pages_of_text_alone(spark):
    found = judge(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("url"), url_filter.GENERAL)
    assert found.where("verdict = 'block'").count() == 0
