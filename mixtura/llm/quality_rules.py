"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base counts are taken of every whole text. Beyond the fixed base rule, each further rule is a rate
of the text with a ladder of cutoffs, from lenient to strict. The rungs of all ladders are taken in
one fixed order, the lenient ones of every rule first; step s applies the base rule and the first s
rungs together. Labelled holdout rows tell, for each stratum (language), how far to go: a step is
tested against the hypothesis that all it rejects is more than ``risk`` of the stratum's good texts.
The p-value is the exact binomial tail P(Bin(n, risk) <= k), where the base rule and the rungs reject
k of n good holdout texts. Steps are tested in their fixed order and testing stops at the first that
is not significant, so the steps of a stratum need no further correction; the strata share the error
rate ``delta`` by Bonferroni's correction. So with probability 1 - delta, in every stratum with a step
no more than ``risk`` of the good texts are rejected, by the base rule or any other.

A stratum without enough labelled texts (59 at the default risk and one stratum, 86 with four), or one
where the base rule alone rejects too many, gets no step, and there only the base rule decides. A
null text has no words and fails the base rule. A null stratum is a stratum of its own. Repeated
labels count once for each document (the largest label); documents that repeat are each judged.
Windows of words are compared by 64-bit hashes. Empty tables give empty results. Other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixtura.llm.common import SPACES, written

SYMBOLS = "#*$%&|<>"
#: Up to so many strata their cutoffs are broadcast; beyond, Spark joins them by shuffle.
BROADCAST_STRATA = 50_000
#: Length of the windows of words in which repetition is sought.
WINDOW = 8
#: Cutoffs of each rule, lenient to strict; a text fails when its rate is above.
LADDERS = {
    "symbol_rate": (2.0, 1.0, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05),
    "dup_line_rate": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeat_rate": (0.29, 0.27, 0.25, 0.2, 0.15, 0.1),
    "long_word": (60.0, 40.0, 30.0, 25.0, 20.0, 15.0),
    "short_word": (-1.0, -1.5, -2.0, -2.5, -3.0),
}


def _length_without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Each step feeds later ones more than once, so each is a projection of its own.
    d = docs.withColumn("_w", F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    d = d.withColumn("n_words", F.size("_w").cast("long"))
    d = d.withColumn("_h", F.when(F.col("n_words") > WINDOW, F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("_w"), i, WINDOW)))))
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    # Equal windows stand side by side once sorted; those with an equal neighbour, by position.
    d = d.withColumn("_s", F.when(repeats, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i, j: F.get(F.col("_s"), j)["h"].eqNullSafe(x["h"])
    d = d.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(F.filter("_s", lambda x, i: same(x, i, i - 1) | same(x, i, i + 1)), lambda x: x["i"]))))
    # A window adds as many words as lie before the next one.
    covered = F.aggregate(F.col("_p"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at")), lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["at"])).cast("long").alias("n"), p.alias("at")), lambda a: a["n"])
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    d = d.withColumn("_l", lines)
    return d.withColumns({
        "word_chars": _length_without(text, SPACES).cast("long"),
        "n_symbols": (F.length(text) - _length_without(text, SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_n_lines": F.size("_l"),
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    }).drop("_w", "_h", "_s", "_p", "_l")


def rates() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbol_rate": F.col("n_symbols") / words,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)).cast("double"),
        "repeat_rate": F.col("n_repeat_words") / words,
        "long_word": F.col("word_chars") / words,
        "short_word": -F.col("word_chars") / words,
    }


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exactly, from the ratio of each term to the one before, in logarithms.
    Where k >= n p the tail is about a half or more, and 1 is returned."""
    odds = F.log(F.lit(p / (1 - p)))
    first = n * F.log(F.lit(1 - p))
    term = lambda a, i: a["t"] + F.log((n - i + 1) / i) + odds
    add = lambda a, b: F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
    total = F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.struct(first.alias("t"), first.alias("s")), lambda a, i: F.struct(term(a, i).alias("t"), add(a["s"], term(a, i)).alias("s")), lambda a: F.exp(a["s"]))
    return F.when(k >= n * F.lit(p), F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(total)


def _steps() -> list[tuple[str, float]]:
    """The rungs of all ladders in the order in which they are tried."""
    rungs = [(i / len(ladder), place, rule, cutoff) for place, (rule, ladder) in enumerate(LADDERS.items()) for i, cutoff in enumerate(ladder)]
    return [(rule, cutoff) for _, _, rule, cutoff in sorted(rungs)]


#: Step s applies the first s of these.
STEPS = _steps()


def first_step() -> Column:
    """The first step that rejects a text: 0 for the base rule, one beyond the last if none does."""
    rate = rates()
    never = len(STEPS) + 1
    # Cutoffs of a rule get stricter, so its first rung that a rate exceeds is its last chance to pass.
    each = [F.when(rate[rule] > F.lit(cutoff), F.lit(s)).otherwise(F.lit(never)) for s, (rule, cutoff) in enumerate(STEPS, 1)]
    return F.when(F.col("base_failed"), F.lit(0)).otherwise(F.least(*each))


def choose_steps(judged: DataFrame, labels: DataFrame, strata: int, risk: float, delta: float, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(stratum, step): how far the holdout lets each stratum go, where it lets it go at all.
    ``judged`` has ``stratum`` and ``first_step``; ``strata`` is the number of strata that share ``delta``."""
    good = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_good")).filter("_good = 1").select("_id")
    held = judged.select(F.col(id_col).alias("_id"), "stratum", "first_step").join(good, "_id")
    # One aggregate for all steps: the number of good texts that each rejects.
    tally = held.groupBy("stratum").agg(F.count("*").alias("n"), *(F.sum((F.col("first_step") <= s).cast("long")).alias(f"k{s}") for s in range(1, len(STEPS) + 1)))
    tested = tally.select("stratum", "n", F.explode(F.array(*(F.struct(F.lit(s).alias("step"), F.col(f"k{s}").alias("k")) for s in range(1, len(STEPS) + 1)))).alias("x")).select("stratum", "n", "x.*")
    # Later steps reject no less, so the last significant one is before the first that is not.
    passed = binomial_tail(F.col("k"), F.col("n"), risk) <= F.lit(delta / max(1, strata))
    return tested.filter(passed).groupBy("stratum").agg(F.max("step").alias("step"))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One row for each document: doc_id, the base counts, base_failed, first_step (the first step that
    rejects it) and kept."""
    counted = base_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), "text")).drop("text")
    judged = written(counted.withColumn("first_step", first_step()).drop("_n_lines"), "rule-counts")  # the texts are read once; a row of counts is a few bytes
    strata = judged.select("stratum").distinct().count()
    steps = choose_steps(judged, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), strata, risk, delta)
    if strata <= BROADCAST_STRATA:  # two values each
        steps = F.broadcast(steps)
    kept = F.col("first_step") > F.coalesce(F.col("step"), F.lit(0))
    return judged.join(steps, "stratum", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "first_step", kept.alias("kept"))
