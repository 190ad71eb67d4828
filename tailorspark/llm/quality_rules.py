"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps its measurements
and one integer whose bit r says that rule r failed.  A *policy* is a named,
versioned set of rules: applying one is a bitwise AND, so policies can be
changed, compared and ablated without reading a text again.

Defined results: null text -> all counts 0 (the word rules fail).  Rows repeat
as they come; other columns of ``docs`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailorspark.llm.textstats import COUNTS, measure

# Fixed rules: name and condition of failure over the measurements.  A rule's
# bit is its place in this list, so rules are only ever added at the end.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 4 * n_lines"),
    ("shouting", "2 * n_upper > n_letters"),
    ("long_words", "word_chars > 12 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("few_distinct_words", "10 * n_distinct_words < n_words and n_words < 1000"),
    ("digits", "2 * n_digits > word_chars"),
    ("marks", "2 * n_marks > n_words"),
]
NAMES = [name for name, _ in RULES]

#: Policies by version: the rules that reject.
POLICIES = {
    "v1": ["few_words", "repeated_words"],
    "v2": NAMES,
}
CURRENT = "v2"


def policy_mask(rules: list[str]) -> int:
    return sum(1 << NAMES.index(r) for r in rules)


def ledger(docs: DataFrame) -> DataFrame:
    """``(doc_id, <counts>, failed)`` for every row of ``docs`` (doc_id, text): one map-only pass."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame(measure(b["text"].tolist()), columns=COUNTS, index=b.index)
            out.insert(0, "doc_id", b["doc_id"])
            yield out

    counted = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))
    bits = [F.when(F.expr(rule), 1 << r).otherwise(0) for r, (_, rule) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return counted.withColumn("failed", failed.cast("long"))


def rejects(failed: Column, policy: str) -> Column:
    """Whether a policy rejects a row with these failure bits."""
    return failed.bitwiseAND(F.lit(policy_mask(POLICIES[policy]))) != 0


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """``(rule, failing, only, kept_without)`` for every rule of a policy.

    ``failing``: rows that fail the rule; ``only``: rows that fail no other rule
    of the policy; ``kept_without``: rows kept if the rule were dropped.  Rows
    are first counted by failure bits (at most 2**rules groups), so every
    policy is answered from one small table.
    """
    mask = policy_mask(POLICIES[policy])
    groups = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(policy_mask([r])).cast("long").alias("bit"))
                                for r in POLICIES[policy]]))
    each = groups.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    own = F.col("bits").bitwiseAND(F.col("bit")) != 0

    def total(condition):
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return each.groupBy("rule").agg(
        total(own).alias("failing"), total(F.col("bits") == F.col("bit")).alias("only"),
        total((F.col("bits") == F.col("bit")) | (F.col("bits") == 0)).alias("kept_without"))
