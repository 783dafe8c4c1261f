"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Base measures are computed inside each row. On top, every rule of ``RULES``
has a fixed grid of cutoffs. Labelled good documents (the holdout: nothing else
is fitted on them) count, per stratum, rule and cutoff, how many would be
rejected. A cutoff is admitted if an exact binomial test at level
``delta`` / (strata x rules x cutoffs) shows its false rejection rate to be at
most ``risk`` / rules (the Clopper-Pearson upper bound lies below it, Bonferroni
correction over everything tested). The strictest admitted cutoff counts; a
stratum without enough labels gets none. So with probability 1 - ``delta`` no
stratum loses more than ``risk`` of its good documents to the learned rules.

Edge cases: a null text has no words; null strata form the stratum ''; labels
with null or 0 quality, and of unknown documents, are not used; repeated labels
of a document count once; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_table
from .common import BLANKS, sql_str

#: rule -> (score in SQL, cutoffs from lenient to strict); rejected when the score is above the cutoff.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.28, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "long_words": ("word_chars / greatest(n_words, 1)", (20.0, 16.0, 13.0, 11.0, 10.0, 9.0)),
    "short_words": ("-word_chars / greatest(n_words, 1)", (-2.0, -2.5, -3.0, -3.5, -4.0)),
}
RISK, DELTA = 0.02, 0.05
WINDOW = 8


def measures(docs: DataFrame, stratum: str = "lang", *carry: str) -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and columns to carry."""
    blanks, w = sql_str(BLANKS), WINDOW
    steps = [
        {"words": f"filter(split(t, {blanks}, -1), x -> x != '')",
         "lines": r"filter(split(t, '\\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"},
        {"n_words": "cast(size(words) as bigint)",
         "word_chars": f"cast(length(regexp_replace(t, {blanks}, '')) as bigint)",
         "n_symbols": "cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '')) as bigint)",
         "n_lines": "cast(size(lines) as bigint)",
         "n_dup_lines": "cast(size(lines) - size(array_distinct(lines)) as bigint)",
         "hashes": "transform(words, x -> xxhash64(x))"},
        {"windows": f"case when n_words < {w} then cast(array() as array<bigint>) else "
                    f"transform(sequence(1, cast(n_words as int) - {w - 1}), i -> xxhash64(slice(hashes, i, {w}))) end"},
        # only where some window recurs are the windows sorted and the recurring ones located
        {"ranked": "case when size(array_distinct(windows)) < size(windows) "
                   "then array_sort(transform(windows, (h, i) -> struct(h as h, i as i))) end"},
        {"found": "case when ranked is not null then array_sort(transform(filter(sequence(0, size(ranked) - 1), "
                  "j -> (j > 0 and ranked[greatest(j - 1, 0)].h = ranked[j].h) or "
                  "(j < size(ranked) - 1 and ranked[least(j + 1, size(ranked) - 1)].h = ranked[j].h)), "
                  "j -> ranked[j].i)) end"},
        {"n_repeat_words": f"coalesce(aggregate(found, struct(0L as n, {-w} as last), "
                           f"(a, p) -> struct(a.n + least({w}, p - a.last) as n, p as last)).n, 0L)"},
    ]
    df = docs.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
                     F.coalesce("text", F.lit("")).alias("t"), *carry)
    for step in steps:
        df = df.withColumns({k: F.expr(v) for k, v in step.items()})
    return df.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
                     "n_repeat_words", *carry)


def binomial_tail(k: str, n: str, p: str) -> str:
    """SQL for P(Bin(n, p) <= k), summed exactly in logarithms; 1 where k >= n * p (never significant)."""
    return (f"case when {k} >= {n} * {p} then 1.0d else aggregate(sequence(0L, {k}), "
            f"struct({n} * ln(1 - {p}) as lt, 0.0d as s), "
            f"(a, i) -> struct(a.lt + ln(greatest({n} - i, 1) / (i + 1)) + ln({p} / (1 - {p})) as lt, a.s + exp(a.lt) as s)).s end")


def thresholds(measured: DataFrame, labels: DataFrame, rules=None, risk: float = RISK,
               delta: float = DELTA) -> DataFrame:
    """stratum and one column cut_<rule> (null: no cutoff is admitted): a row per labelled stratum."""
    rules = rules or RULES
    good = labels.filter("quality = 1").select("doc_id").distinct()
    held = measured.join(good, "doc_id")
    tests = [(r, c) for r, (_, cuts) in rules.items() for c in cuts]
    counts = held.groupBy("stratum").agg(
        F.count("*").alias("n"),
        *[F.sum(F.expr(f"cast({rules[r][0]} > {c}d as bigint)")).alias(f"k{j}") for j, (r, c) in enumerate(tests)])
    strata = counts.agg(F.count("*").alias("m"))
    level = delta / len(tests)
    rows = ", ".join(f"'{r}', {c}d, k{j}" for j, (r, c) in enumerate(tests))
    long = counts.select("stratum", "n", F.expr(f"stack({len(tests)}, {rows}) as (rule, cutoff, k)"))
    admitted = long.filter(F.expr(binomial_tail("k", "n", f"{risk / len(rules)}d")) <= level / strata.scalar())
    return (admitted.groupBy("stratum").agg(
        *[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in rules]))


def judged(measured: DataFrame, cuts: DataFrame, rules=None) -> DataFrame:
    """``measured`` with base_failed, failed_rules and kept."""
    rules = rules or RULES
    return measured.join(cuts, "stratum", "left").withColumns({
        "base_failed": F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"),
        "failed_rules": F.expr("filter(array(" + ", ".join(
            f"case when {score} > cut_{r} then '{r}' end" for r, (score, _) in rules.items())
            + "), x -> x is not null)")}).withColumn("kept", F.expr("not base_failed and size(failed_rules) = 0"))


def _cutoffs(rows: DataFrame, labels: DataFrame, rules, risk: float, delta: float) -> DataFrame:
    return shared_table(thresholds(rows, labels, rules, risk, delta), "quality-cutoffs")


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", rules=None,
                  risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules."""
    rows = shared_table(measures(docs, stratum), "quality-measures")
    return judged(rows, _cutoffs(rows, labels, rules, risk, delta), rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def quality_filtered(docs: DataFrame, labels: DataFrame, stratum: str = "lang", rules=None,
                     risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that are kept. Each is judged where it lies; texts aren't shuffled for it.

    Rows are written with their measures: the cutoffs read the measures alone, and
    the filter isn't pushed into the expressions that compute them.
    """
    whole = docs.select("*", F.struct(*docs.columns).alias("_row"))
    rows = shared_table(measures(whole, stratum, "_row"), "measured-rows")
    return judged(rows, _cutoffs(rows, labels, rules, risk, delta), rules).filter("kept").select("_row.*")
