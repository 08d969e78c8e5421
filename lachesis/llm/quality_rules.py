"""Quality rules as a bitmask ledger, with DataFrame functions only.

`ledger` evaluates every rule once and stores the measurements and one failure bit a rule. `apply_policy` keeps a row if
none of the bits that a policy version names is set; `ablations` counts, for every policy and rule, what the rule rejects
and what only this rule rejects, from counts by bitmask (at most 2^rules rows), so trying a policy costs no text scan.

Nothing is shuffled by `ledger` or `apply_policy`. A text is handled inside its row by array functions whose work is
n log n in its words (sorting of window hashes), so very long texts cost no more a word than short ones.

Nulls: a null text has no words or lines, all its counts are 0 and it fails `too_few_words`. Repeated rows are judged
alike. Input columns with the names of added ones are replaced, all others stay. An empty table gives an empty ledger.

Windows of one text are equal if their 64-bit hashes are; for a text of a million words two different ones agree with
probability below 3e-8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused, without

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Rules in the order of their bits: name and SQL condition over the measurements.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbol_heavy", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "n_words > 0 and word_chars < 2 * n_words"),
    ("long_words", "word_chars > 30 * n_words"),
]
BIT = {name: i for i, (name, _) in enumerate(RULES)}

#: Versioned policies: the rules that reject under each.
POLICIES: dict[str, list[str]] = {
    "v1-base": ["too_few_words", "repeated_windows"],
    "v2": ["too_few_words", "repeated_windows", "symbol_heavy", "duplicate_lines", "short_words", "long_words"],
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def mask(policy: list[str]) -> int:
    return sum(1 << BIT[r] for r in policy)


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more: window hashes are sorted with their places, equal neighbours mark
    their places, and each marked place covers three words; sorted places overlap only with the one before."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    ordered = F.array_sort(windows)

    def marked(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, j: F.when(j == 0, 3).otherwise(F.least(F.lit(3), p - F.get(at, j - 1))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    # let(x, f): x is worked out once, though f names it often.
    let = lambda x, f: F.get(F.transform(F.array(x), f), 0)
    return F.when(n >= 4, let(let(ordered, marked), covered)).otherwise(F.lit(0).cast("long"))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements and `fail_bits`, in which bit i is set if rule i fails."""
    own = without(docs, [*MEASURES, "fail_bits"])
    ws, ls = unused(docs, "_words"), unused(docs, "_lines")
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, "[ \\t-\\r]+", -1), lambda w: w != "")
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    df = own.withColumns({ws: words, ls: lines})
    df = df.withColumns(
        {
            "n_words": F.size(ws).cast("long"),
            "word_chars": F.length(F.translate(body, SPACES, "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size(ls).cast("long"),
            "n_dup_lines": (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"),
            "n_repeat_words": repeated_words(F.col(ws)).cast("long"),
        }
    ).drop(ws, ls)
    bits = F.lit(0).cast("long")
    for i, (_, condition) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return df.withColumn("fail_bits", bits)


def apply_policy(df: DataFrame, version: str = "v2", kept: str = "kept") -> DataFrame:
    """A ledger with a column that is true where the policy's rules all hold."""
    return df.withColumn(kept, F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0)


def ablations(df: DataFrame, versions: list[str] | None = None) -> DataFrame:
    """For each policy and rule of it: rows, rejected by the policy, failed by the rule, rejected by this rule alone,
    and kept without it. One aggregation by bitmask; the rest works on its at most 2^rules rows."""
    counts = df.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    plans = [(v, r, mask(POLICIES[v]), 1 << BIT[r]) for v in (versions or POLICIES) for r in POLICIES[v]]
    plan = df.sparkSession.createDataFrame(plans, "policy string, rule string, policy_mask long, rule_bit long")
    hit = F.col("fail_bits").bitwiseAND(F.col("policy_mask"))
    some = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0).cast("long"))).alias
    rule = F.col("rule_bit")
    return (
        counts.join(F.broadcast(plan))  # rules x masks, both of fixed size
        .groupBy("policy", "rule")
        .agg(F.sum("n").alias("n_rows"), some(hit != 0)("n_rejected"), some(hit.bitwiseAND(rule) != 0)("n_failed"), some(hit == rule)("n_only_rule"), some(hit.bitwiseAND(F.bitwise_not(rule)) == 0)("n_kept_without"))
    )


def accepted(docs: DataFrame, version: str = "v2") -> DataFrame:
    """docs without what the policy rejects, with their own columns."""
    names = docs.columns
    rows = docs.select(F.struct(*[f"`{c}`" for c in names]).alias("_row"), F.col("text"))
    # A filter on row numbers stays above the measurements; pushed below, it would work them out once a condition.
    return apply_policy(ledger(rows), version).withColumn("_n", F.monotonically_increasing_id()).where("kept and _n >= 0").select("_row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measurements and verdict."""
    df = apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "v2")
    df = apply_policy(df, "v1-base", "base_kept")
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), (F.col("base_kept") & F.col("kept")).alias("kept"), "n_lines", "fail_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects, over all documents."""
    return ablations(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))


MEASURED = r"""
w AS (SELECT doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) i FROM w WHERE len(w) >= 3)),
r AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) c FROM g) WHERE c >= 2) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) n_lines, count(*) - count(DISTINCT x) n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) x FROM w) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT n_words, length(array_to_string(w, ''))::BIGINT word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT n_symbols,
coalesce(n_dup, 0)::BIGINT n_dup_lines, coalesce(r.n, 0)::BIGINT n_repeat_words, coalesce(n_lines, 0)::BIGINT n_lines FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END | CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END | CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
| CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END | CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 16 ELSE 0 END | CASE WHEN word_chars > 30 * n_words THEN 32 ELSE 0 END)::BIGINT fail_bits FROM m)"""

QUERIES = {"op9_quality_rules": op9_quality_rules, "quality_ablations": quality_ablations}
ORACLES = {
    "op9_quality_rules": f"WITH {MEASURED}\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, fail_bits, fail_bits & 3 <> 0 base_failed, fail_bits = 0 kept FROM b",
    "quality_ablations": f"""WITH {MEASURED},
p(policy, rule, policy_mask, rule_bit) AS (VALUES {", ".join(f"('{v}', '{r}', {mask(p)}, {1 << BIT[r]})" for v, p in POLICIES.items() for r in p)})
SELECT policy, rule, count(*)::BIGINT n_rows, count(*) FILTER (fail_bits & policy_mask <> 0)::BIGINT n_rejected, count(*) FILTER (fail_bits & policy_mask & rule_bit <> 0)::BIGINT n_failed,
count(*) FILTER (fail_bits & policy_mask = rule_bit)::BIGINT n_only_rule, count(*) FILTER (fail_bits & policy_mask & ~rule_bit = 0)::BIGINT n_kept_without FROM b, p GROUP BY policy, rule""",
}
