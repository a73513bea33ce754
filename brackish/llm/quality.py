"""Quality rules as a ledger: every rule is evaluated once, failures are bits, policies are masks over them.

The ledger holds the measurements and one number of failure bits for each document. A policy is a version and the rules that
count in it; whether it keeps a document is one bitwise test, and what a policy would keep without one of its rules comes
from counts of the distinct bit patterns, without reading a text again.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_same_words", "n_upper_words")
SYMBOLS = "#*$%&|<>"
#: Name and test of each rule in the order of their bits. Tests are in integers and read the same in any SQL.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_runs", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 20 * n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("same_word_again", "100 * n_same_words > 20 * n_words"),
    ("upper_case", "100 * n_upper_words > 50 * n_words"),
)
BASE = ("few_words", "repeated_runs")
POLICIES = {"v1": BASE, "v2": tuple(name for name, _ in RULES)}


def measure(text: str) -> dict[str, int]:
    """Counts of a text; words are runs without ASCII white space, lines end in \\n."""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    runs = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(runs) != len(set(runs)):
        often, reach = Counter(runs), 0
        for i, run in enumerate(runs):
            if often[run] > 1:
                repeated += i + 3 - max(reach, i)
                reach = i + 3
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, " \t\n\v\f\r")),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated,
        "n_same_words": sum(map(bytes.__eq__, words[1:], words)),
        "n_upper_words": sum(map(bytes.isupper, words)),
    }


def bit(rule: str, rules=RULES) -> int:
    return 1 << [name for name, _ in rules].index(rule)


def mask(policy: tuple[str, ...], rules=RULES) -> int:
    return sum(bit(rule, rules) for rule in policy)


def failure_bits(rules=RULES) -> str:
    """SQL for the failure bits of a row of measurements."""
    return " + ".join(f"CASE WHEN {test} THEN {bit(name, rules)} ELSE 0 END" for name, test in rules)


def ledger(docs: DataFrame, keep: list[str], text: str = "text", rules=RULES) -> DataFrame:
    """``keep``, the measurements and fail_bits of every row's whole text.

    Null and empty texts have no words and no lines: they fail the rules whose tests hold for zeros. Repeated rows stay; an
    empty table gives an empty ledger.
    """
    schema = ", ".join(f"{m} long" for m in MEASURES)
    measured = map_texts(docs, keep, text, lambda texts: [measure(t) for t in texts], schema)
    return measured.withColumn("fail_bits", F.expr(f"CAST({failure_bits(rules)} AS BIGINT)"))


def passes(policy: tuple[str, ...], rules=RULES) -> Column:
    """Whether a row of the ledger fails no rule of the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def ablation(rows: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES, rules=RULES) -> DataFrame:
    """(policy, rule, n_docs, n_failed, n_kept, n_kept_without, any_kept_bits) for each rule of each policy.

    ``n_kept_without``: documents that the policy would keep without the rule; ``any_kept_bits``: failures, of rules outside
    the policy, that some kept document has. All of it from counts of distinct patterns, at most 2 to the number of rules.
    """
    patterns = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    wanted = [(v, r, mask(p, rules), bit(r, rules)) for v, p in policies.items() for r in p]
    spec = F.array(*(F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("mask"),
                              F.lit(b).cast("long").alias("bit")) for v, r, m, b in wanted))
    each = patterns.select("fail_bits", "n", F.explode(spec).alias("s")).select("fail_bits", "n", "s.*")
    failed, kept = F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, F.col("fail_bits").bitwiseAND(F.col("mask")) == 0
    without = F.col("fail_bits").bitwiseAND(F.col("mask")).bitwiseAND(F.bitwise_not("bit")) == 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return each.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"), total(failed).alias("n_failed"), total(kept).alias("n_kept"),
        total(without).alias("n_kept_without"), F.coalesce(F.bit_or(F.when(kept, F.col("fail_bits"))), F.lit(0)).alias("any_kept_bits"),
    )


JUDGED = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
    SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM docs),
runs AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM parts)),
repeats AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM runs WHERE n > 1) GROUP BY doc_id),
counts AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_same_words,
        len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')))::BIGINT AS n_upper_words
    FROM parts LEFT JOIN repeats r USING (doc_id)),
judged AS (SELECT *, CAST({failure_bits()} AS BIGINT) AS fail_bits FROM counts)
"""
ORACLE = f"""{JUDGED}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {mask(BASE)}) <> 0 AS base_failed,
    (fail_bits & {mask(POLICIES["v2"])}) = 0 AS kept, (fail_bits & {mask(POLICIES["v1"])}) = 0 AS kept_v1, fail_bits FROM judged
"""
ABLATION_ORACLE = f"""{JUDGED},
spec(policy, rule, mask, bit) AS (VALUES {", ".join(f"('{v}', '{r}', {mask(p)}, {bit(r)})" for v, p in POLICIES.items() for r in p)})
SELECT policy, rule, count(*) AS n_docs, count(*) FILTER (fail_bits & bit <> 0) AS n_failed,
    count(*) FILTER (fail_bits & mask = 0) AS n_kept, count(*) FILTER (fail_bits & mask & ~bit = 0) AS n_kept_without,
    coalesce(bit_or(fail_bits) FILTER (fail_bits & mask = 0), 0)::BIGINT AS any_kept_bits
FROM judged CROSS JOIN spec GROUP BY policy, rule
"""
