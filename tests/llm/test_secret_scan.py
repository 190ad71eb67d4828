import random
import re

from pyspark.sql import functions as F

from tailorspark.llm import secret_scan as S
from tailorspark.llm.automaton import Automaton
from util import docs, rows


def brute(text):
    spans = []
    for k, (_, _, rule, least) in enumerate(S.RULES):
        spans += [(m.start(), k, m.end()) for m in re.finditer(rule, text or "") if len(m.group("v")) >= least]
    return [(S.KINDS[k], a, b) for a, k, b in sorted(spans)]


def test_automaton_agrees_with_regular_expressions():
    rng = random.Random(3)
    rules = [r"ab*c", r"(?i:key|ke)[=:]\x20*[0-9]{2,3}", r"x[a-c]{2}y|zz+", r"[^\x20a-z]q?r"]
    machine = Automaton(rules)
    texts = ["".join(rng.choice("abcxyzKEke=: 0127qr#") for _ in range(rng.randint(0, 60))) for _ in range(700)]
    texts += ["", "z" * 3000, "ke:  77"]
    want = [sum(1 << r for r, rule in enumerate(rules) if re.search(rule, t)) for t in texts]
    assert machine.scan([t.encode() for t in texts]).tolist() == want


def test_automaton_is_minimal():
    assert len(Automaton([r"a(b|c)", r"ab|ac"]).masks) == 3


PARTS = ["password", "PASSWD", "Secret", "token", "api_key", "apikey", "=", ": ", " = ", '"', "'", "abc123", "abcde", "+/_.=-",
         "AKIA", "ABCDEFGHIJ123456", "0123456789abcdef", "deadbeef", " ", "\n", "é", "ſecret", "😀", "-----BEGIN RSA PRIVATE KEY-----",
         "ghp_" + "a1B2" * 9, "xoxb-1234567890-abc", "AIza" + "x" * 35, "sk_live_" + "9" * 20]


def test_spans_against_brute_force(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts += [None, "", "x" * 200_000 + " password=hunter22", "token:token=abcdef", "secret=abc password=abcdefg"]
    found = S.find_spans(texts)
    assert found == [brute(t) for t in texts]
    assert any(found)


def test_operator_rows_and_columns(spark):
    table = docs(spark, ["password=hunter22", None, "password=hunter22"], ids=[1, 2, 1]).withColumn("spans", F.lit("mine"))
    got = S.find_secrets(table).select("doc_id", F.size("spans").alias("n"))
    assert rows(got) == [(1, 1), (1, 1), (2, 0)]
    assert S.find_secrets(docs(spark, [])).count() == 0


def test_redaction(spark):
    text = "a password=0123456789abcdef01234567 b AKIA" + "Z" * 16 + " c"
    table = docs(spark, [text, None, "clean é", ""])
    got = rows(S.redact(table), "doc_id", "text")
    assert got == [(0, "a [SECRET] b [SECRET] c"), (1, None), (2, "clean é"), (3, "")]


def test_redaction_of_whole_private_keys(spark):
    body = [("Ab+/9" * 13)[:64]] * 25 + ["Zx9Q=="]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    lines, fields = "\n".join(body), "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n"
    texts = [f"a\n{begin}\n{lines}\n{end}\nThe end", f"a\r\n{begin}\r\n" + "\r\n".join(body) + f"\r\n{end} b",
             f"{begin}\n{fields}{lines}\n{end}", '{"key": "' + f"{begin}\\n" + "\\n".join(body) + f"\\n{end}" + '\\n"}',
             f"a\n{begin}\n{lines}\nThe end is missing", f"a {begin}\n{fields}{lines}", f"{begin}\n{lines}\n{begin}\n{lines}\n{end}\nc",
             f"{begin}\n" + f"{body[0]}\n" * 5000 + f"{end} long", f"{begin} is how a key begins", f"{begin}\n\nThe text goes on",
             f"{begin}\n{lines}\n-----BEGIN CERTIFICATE-----\nabc"]
    mark = S.MARK
    assert [r[1] for r in rows(S.redact(docs(spark, texts)), "doc_id", "text")] == [
        f"a\n{mark}\nThe end", f"a\r\n{mark} b", mark, '{"key": "' + mark + '\\n"}', f"a\n{mark}\nThe end is missing", f"a {mark}",
        f"{mark}\n{mark}\nc", f"{mark} long", f"{mark} is how a key begins", f"{mark}\n\nThe text goes on",
        f"{mark}\n-----BEGIN CERTIFICATE-----\nabc"]


def test_runs_and_longest_matches():
    machine = Automaton([r"ab", r"[0-9]{3}"])
    assert machine.runs([b"xabab12345", b"", b"none", b"999"]) == {0: [(3, 3, 1), (5, 5, 1), (8, 10, 2)], 3: [(3, 3, 2)]}
    # the same with all texts in lock step
    many = [b"xabab12345", b"999", b"a0123b"] * 100
    assert machine.runs(many) == {i: [[(3, 3, 1), (5, 5, 1), (8, 10, 2)], [(3, 3, 2)], [(4, 5, 2)]][i % 3] for i in range(300)}
    ahead, back = Automaton([r"a(?:b|cd)+"], anchored=True), Automaton([r"a(?:b|cd)+"], anchored=True, backward=True)
    assert ahead.longest(b"xabcdcx", 1, 7) == 4 and ahead.longest(b"xabcdcx", 0, 7) == 0
    assert back.longest(b"xabcdcx", 4, -1, -1) == 4 and back.longest(b"xabcdcx", 4, 1, -1) == 0


def test_short_values_take_their_place():
    texts = ["token=token:token=abcdef", "secret=token: abcdefgh", "token==abcdef", "é😀token: 'abcdefg' " + "0a" * 20, "AKIAAKIA" + "Z" * 15,
             "AKIA1 AKIA" + "2" * 16, "0" * 23 + "g" + "0" * 25, "token:" + " " * 50 + "'abcdef", "a" * 300_000]
    assert S.find_spans(texts) == [brute(t) for t in texts]
    assert S.find_spans(texts)[1] == [] and len(S.find_spans(texts * 50)) == 450
    assert S.find_spans(texts * 50) == [brute(t) for t in texts] * 50
