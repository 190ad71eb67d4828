"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over an address (host, path and the rest, without
the scheme).  Wherever it matches, some words of letters and digits must stand in
the address as whole words: its literal tokens.  Every rule is filed under the one
of them that the fewest addresses hold, an address fetches the rules filed under
its own tokens, and only those run as regular expressions.  Rules without a whole
literal token are filed under the empty token, which every address has.

Two kinds of rules:

* ``host_rule``: a host with all its subdomains, and the beginning of a path.  Of
  those that fit, the longest (host and path, then the longer host, then the smaller
  text) gives the verdict.
* ``text_rule``: text anywhere in the address, ``*`` for any characters but ``?`` and
  ``#``.  They decide where no host rule fits: any that blocks, blocks.

Addresses are judged once each: distinct addresses, their candidates, one verdict, joined
back.  Nothing is collected and no step puts the addresses of a token or host into one
task: the rule index is as long as the list of rules, so Spark broadcasts it below its
own threshold and else joins by token and splits a frequent one (adaptive skew join).

Defined results.  A null address, or one without ``://``, has an empty host and path,
and no host rule fits it; text rules see the empty address.  Upper-case A-Z in hosts is
lower-cased, paths are compared as they are.  Ports and user names are part of the host.
Repeated rows are judged alike; an empty table gives no rows; an empty list of rules
allows all.  Very long addresses are looked at whole.  Input columns pass through; one of
them called like a result column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)\z"
#: What is not part of a token of an address.
_BREAK = "[^0-9a-z]+"
RESULT = ["host", "path", "rule", "pattern", "verdict"]


@dataclass(frozen=True)
class Rule:
    """``name`` as listed; ``regex`` over the address; ``tokens``: lower-cased words any match holds whole."""

    name: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    of_host: bool
    host_length: int = 0


def _literal(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z])", r"\\\1", text)


def host_rule(action: str, host: str, path: str = "") -> Rule:
    """``host`` and all its subdomains, if the path starts with ``path`` (which has no ``?`` or ``#``)."""
    host = host.translate(str.maketrans(_UPPER, _LOWER))
    regex = rf"^(?:[^/?#]*\.)?{_literal(host)}(?=[/?#]|\z){_literal(path)}"
    # the last word of the path may go on in the address; the words before it may not
    words = re.split(_BREAK, host) + re.split(_BREAK, path.translate(str.maketrans(_UPPER, _LOWER)))[:-1]
    return Rule(host + path, action, regex, tuple(sorted({w for w in words if w})), True, len(host))


def text_rule(action: str, text: str) -> Rule:
    """``text`` anywhere in the address, host in lower case; ``*`` stands for characters but ``?`` and ``#``."""
    parts = text.split("*")
    regex = "[^?#]*".join(_literal(p) for p in parts)
    whole = [w for p in parts for w in re.split(_BREAK, p.translate(str.maketrans(_UPPER, _LOWER)))[1:-1]]
    return Rule(text, action, regex, tuple(sorted({w for w in whole if w})), False)


#: Addresses that hold no text of their own: programs, shops' and members' pages, sessions.
GENERAL = tuple(text_rule(BLOCK, t) for t in (
    "/cgi-bin/", "/wp-admin/", "/wp-login.", "/cart/", "/checkout/", "/login?", "/signin?", "&sessionid=", "?sessionid=",
    "/ads/", "/banner/*/click", "/share?", ".exe?"))


def with_address(pages: DataFrame, url: str = "url") -> DataFrame:
    """``host``, ``path`` and ``_rest`` of every address."""
    part = [F.coalesce(F.regexp_extract(url, _ADDRESS, i), F.lit("")) for i in (1, 2, 3)]
    return pages.withColumns({"host": F.translate(part[0], _UPPER, _LOWER), "path": part[1], "_rest": part[2]})


def _tokens(address):
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.translate(address, _UPPER, _LOWER), _BREAK)))


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [(i, r.name, r.action, r.regex, list(r.tokens) or [""], r.of_host, r.host_length) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_id long, name string, action string, regex string, tokens array<string>, "
                                       "of_host boolean, host_length int")


def rule_index(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules`` with the ``token`` each is filed under: the one that the fewest ``addresses`` hold, then the least."""
    wanted = rules.select("rule_id", F.explode("tokens").alias("token"))
    held = addresses.select(F.explode(_tokens(F.col("address"))).alias("token")).join(
        wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    rarest = wanted.join(held, "token", "left").groupBy("rule_id").agg(
        F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "token")).alias("t"))
    return rules.drop("tokens").join(rarest.select("rule_id", F.col("t.token").alias("token")), "rule_id")


def candidates(addresses: DataFrame, index: DataFrame) -> DataFrame:
    """(address, rule) for every rule filed under a token of the address."""
    return addresses.select("address", F.explode(_tokens(F.col("address"))).alias("token")).join(index, "token")


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the host rule that decides, or null), ``pattern`` (the text rule that
    decides where no host rule fits, or null) and ``verdict``."""
    seen = with_address(pages.drop(*[c for c in RESULT if c != url]), url)
    seen = seen.withColumn("_address", F.concat("host", "path", "_rest")).drop("_rest")
    addresses = seen.select(F.col("_address").alias("address")).distinct()
    index = rule_index(addresses, rule_table(pages.sparkSession, rules))
    hits = candidates(addresses, index).where(F.expr("address rlike regex"))
    # least first: host rules, the longest; then text rules, those that block
    order = F.struct((~F.col("of_host")).alias("kind"),
                     F.when(F.col("of_host"), -F.char_length("name")).otherwise(0).alias("length"), -F.col("host_length"),
                     F.when(F.col("of_host"), 0).otherwise((F.col("action") != BLOCK).cast("int")).alias("allows"), "name",
                     "rule_id")
    best = hits.groupBy("address").agg(F.min_by(F.struct("name", "action", "of_host"), order).alias("_best"))
    out = seen.join(best.withColumnRenamed("address", "_address"), "_address", "left")
    by_host = F.col("_best.of_host")
    return out.withColumns({
        "rule": F.when(by_host, F.col("_best.name")), "pattern": F.when(~by_host, F.col("_best.name")),
        "verdict": F.coalesce("_best.action", F.lit(ALLOW))}).drop("_address", "_best")
