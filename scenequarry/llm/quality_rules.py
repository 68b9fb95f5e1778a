"""Quality rules with risk-controlled thresholds.

A rule rejects a document when a statistic exceeds a cutoff. Labelled holdouts are split in two by a hash of the id. The smaller part proposes a list of
(rule, cutoff) steps: each adds what rejects most further bad documents for the good ones it costs. The
larger part certifies: per stratum, the rejections of the first k steps together are tested by the exact
binomial law ("the rate of rejecting good documents is above ``risk``"), for k = 1, 2, …; the walk ends at the first
step that can't be certified (fixed-sequence testing, which costs no error within a walk). The walks, one for all documents and one for each stratum with rows enough to
certify anything, share ``error`` by Bonferroni. So, with probability ``1 - error``, in every such stratum at once, at most ``risk`` of the good
documents are rejected beyond the base rules; strata with fewer rows use the steps certified on all documents, whose bound holds for these together.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenequarry.llm.shared import TEXT_HASH, learnable, store, with_text_hash
from scenequarry.llm.statistics import document_statistics

MIN_WORDS, MAX_REPEAT_PCT = 50, 50
_SHARES = (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05)


@dataclass(frozen=True)
class Rule:
    """Rejects where ``part`` exceeds ``cutoff`` times ``whole``; cutoffs from lenient to strict."""

    name: str
    part: str
    whole: str
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols", "n_words", (3.0, 2.0, 1.5, 1.0, *_SHARES)),
    Rule("dup_lines", "n_dup_lines", "n_lines", _SHARES),
    Rule("repeats", "n_repeat_words", "n_words", _SHARES),
    Rule("upper", "n_upper", "word_chars", _SHARES),
)
#: One in so many holdout rows proposes steps; the others certify them.
PROPOSE = 4
#: The stratum of all documents.
ALL = ""
#: Rows of the table of thresholds that may be broadcast.
FEW_STRATA = 100_000


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), summed from exact log terms."""
    if k >= n:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in log))


def _exceeds(rule: Rule, cutoff: float | Column) -> Column:
    return F.col(rule.part) > F.col(rule.whole) * (F.lit(cutoff) if not isinstance(cutoff, Column) else cutoff)


def base_failed(stats: DataFrame | None = None) -> Column:
    """The fixed rules: fewer than 50 words, or over half of the words in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def rows_needed(risk: float, error: float) -> int:
    """Good rows of which not one may be rejected to certify ``risk`` at ``error``."""
    return math.ceil(math.log(error) / math.log1p(-risk))


def propose(patterns: list[tuple[tuple[int, ...], int, int]], rules: Sequence[Rule], risk: float) -> list[tuple[int, int]]:
    """Steps ``(rule, level)``: a row is rejected if it exceeds the ``level`` strictest of the rule's cutoffs.

    ``patterns`` are ``(levels by rule, good rows, bad rows)``. Greedy: most further bad rows for each further good one (and one more). Ends
    when nothing is gained or twice ``risk`` of the good rows would go. Of equal steps the first rule's most lenient one.
    """
    left, steps = list(patterns), []
    good, gone = sum(g for _, g, _ in patterns), 0
    while True:
        best = None
        for r, rule in enumerate(rules):
            for level in range(len(rule.cutoffs), 0, -1):
                g = sum(n for levels, n, _ in left if levels[r] >= level)
                b = sum(n for levels, _, n in left if levels[r] >= level)
                if b and gone + g <= 2 * risk * good and (best is None or b / (g + 1) > best[0]):
                    best = b / (g + 1), r, level, g
        if best is None:
            return steps
        _, r, level, g = best
        steps.append((r, level))
        gone += g
        left = [x for x in left if x[0][r] < level]


def certified_steps(good: list[int], n: int, risk: float, error: float) -> int:
    """How many steps may be taken: ``good[k]`` good rows of ``n`` fall to the first k + 1 steps."""
    for k, rejected in enumerate(good):
        if not n or binomial_tail(rejected, n, risk) > error:
            return k
    return len(good)


def certify(stats: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05, rules: Sequence[Rule] = RULES) -> dict[str, dict[str, float | None]]:
    """Cutoffs by stratum and rule from ``stats(doc_id, stratum, counts…)`` and ``labels(doc_id, quality)``.

    Uses labelled rows with crc32(doc_id) mod 4 other than 2 that pass the base rules. An id labelled
    both ways counts as bad, its texts as the most lenient of them; a null label or id doesn't count. What reaches the driver is counts: a row for each pattern of
    exceeded cutoffs (fewer than 30,000), and one for each step and stratum with enough rows.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("__good"))
    levels = [sum((_exceeds(r, c).cast("int") for c in r.cutoffs), F.lit(0)).alias(f"l{i}") for i, r in enumerate(rules)]
    names = [f"l{i}" for i in range(len(rules))]
    each = stats.where(~base_failed()).select("doc_id", "stratum", *levels).groupBy("doc_id").agg(F.min(F.struct(*names, "stratum")).alias("s"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(PROPOSE)) != 0
    joined = store(each.join(marked, "doc_id").select(F.coalesce("s.stratum", F.lit(ALL)).alias("stratum"), *[f"s.{c}" for c in names], "__good", held.alias("__held")), "quality-holdout")
    one = F.col("__good") == 1
    counts = joined.where("NOT __held").groupBy(*names).agg(F.count_if(one).alias("g"), F.count_if(~one).alias("b")).collect()
    steps = propose(sorted((tuple(r[c] for c in names), r["g"], r["b"]) for r in counts), rules, risk)
    if not steps:
        return {ALL: dict.fromkeys([r.name for r in rules])}
    # The first step that rejects a row; then counts by stratum and step, of good rows only.
    first = F.coalesce(*[F.when(F.col(names[r]) >= level, F.lit(k)) for k, (r, level) in enumerate(steps)], F.lit(len(steps)))
    by_step = joined.where(F.col("__held") & one).groupBy("stratum", first.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    total = by_step.groupBy("stratum").agg(F.sum("n").alias("__n"))
    # Error is shared by the walks of strata that can certify anything with their part of it: a few more rows are needed the more there are.
    least = rows_needed(risk, error / 2)
    able = [r for r in total.where((F.col("__n") >= least) & (F.col("stratum") != ALL)).orderBy(F.desc("__n"), "stratum").collect()]
    while able and able[-1]["__n"] < rows_needed(risk, error / (len(able) + 1)):
        able.pop()
    share = error / (len(able) + 1)
    few = spark_table(stats, [(r["stratum"],) for r in able], "stratum string")
    table: dict[str, list[int]] = {}
    pooled = by_step.groupBy("step").agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("stratum"), "step", "n")
    for r in pooled.unionByName(by_step.join(few, "stratum", "left_semi").select("stratum", "step", F.col("n"))).collect():
        table.setdefault(r["stratum"], [0] * (len(steps) + 1))[r["step"]] += r["n"]
    chosen: dict[str, dict[str, float | None]] = {}
    for stratum in [ALL, *[r["stratum"] for r in able]]:
        found = table.get(stratum, [0] * (len(steps) + 1))
        taken = certified_steps([sum(found[: k + 1]) for k in range(len(steps))], sum(found), risk, share)
        chosen[stratum] = {rule.name: min((rule.cutoffs[-level] for r, level in steps[:taken] if r == i), default=None) for i, rule in enumerate(rules)}
    return chosen


def spark_table(like: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def judged(stats: DataFrame, thresholds: dict[str, dict[str, float | None]], rules: Sequence[Rule] = RULES) -> DataFrame:
    """``stats`` with ``__rejected``: whether a rule of the row's stratum, or of all documents where it has none, rejects it."""
    rows = [(s, *[cuts[r.name] for r in rules]) for s, cuts in thresholds.items() if s != ALL]
    table = spark_table(stats, rows, "__s string, " + ", ".join(f"__t{i} double" for i in range(len(rules))))
    joined = stats.join(F.broadcast(table) if len(rows) <= FEW_STRATA else table, F.col("stratum") == F.col("__s"), "left")
    rejected = F.lit(False)
    for i, rule in enumerate(rules):
        cutoff = F.when(F.col("__s").isNotNull(), F.col(f"__t{i}")).otherwise(F.lit(thresholds[ALL][rule.name]).cast("double"))
        rejected = rejected | F.coalesce(_exceeds(rule, cutoff), F.lit(False))
    return joined.withColumn("__rejected", rejected).drop("__s", *[f"__t{i}" for i in range(len(rules))])


def apply_quality_rules(documents: DataFrame, labels: DataFrame, stratum_column: str = "lang", risk: float = 0.02, error: float = 0.05, keep: Iterable[str] = ()) -> DataFrame:
    """Statistics and verdict of every document: doc_id, counts, stratum, base_failed, kept.

    Null or empty texts have 0 words and fail the base rules; a null stratum and rare ones are judged by
    the cutoffs of all documents; repeated rows are judged each; empty tables give no rows, and without labels only the base
    rules reject; other columns are ignored unless named in ``keep``. Texts are read once; the counts are stored and reused.
    """
    stats = store(document_statistics(documents, keep=[stratum_column, *keep]).withColumn("stratum", F.col(stratum_column).cast("string")), "quality-stats")
    thresholds = certify(stats, labels, risk, error)
    failed = base_failed()
    return judged(stats, thresholds).withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.col("__rejected")).drop("__rejected")


def keep_good(documents: DataFrame, labels: DataFrame, stratum_column: str = "lang", **options) -> DataFrame:
    """Rows of ``documents`` that the rules keep, all columns as they are.

    Each row is judged on its own, also where ids repeat or are null: verdicts are joined back by id, stratum and
    128 bits of the text's hash, which settle a verdict.
    """
    marked = with_text_hash(documents)
    judged = apply_quality_rules(marked, labels, stratum_column, keep=TEXT_HASH, **options)
    keys = ["doc_id", stratum_column, *TEXT_HASH]
    rejected = judged.where(~F.col("kept")).select(*[F.col(f"`{c}`").alias(f"__bad{i}") for i, c in enumerate(keys)]).distinct()
    same = [marked[f"`{c}`"].eqNullSafe(F.col(f"__bad{i}")) for i, c in enumerate(keys)]
    return marked.join(rejected, same, "left_anti").drop(*TEXT_HASH)
