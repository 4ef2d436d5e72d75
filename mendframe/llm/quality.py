"""Quality by weak supervision; DataFrame operations only.

Rules look at a text and vote good (1), bad (0) or abstain (NULL). No rule decides
alone: expectation-maximisation estimates how often each rule is right about good and
about bad documents, and a document is kept when its posterior probability of
being good reaches a threshold. Texts are measured once, and the measures saved; the
iterations run over the counts of the distinct vote vectors, of which there are at
most 3^rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.llm.common import SPACE_CLASS, saved, words

#: Words that these languages are full of.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he at are this or his from but "
    "der die und das zu den von mit ist des im ein eine auf für "
    "le la les de du des et un une est en que pour dans "
    "el los las una y por con para se"
).split()


RULES = ("symbols", "capitals", "repeats", "variety", "sentences", "shouts", "lines", "word_length", "stop_words")


def _kept_once(value: Column) -> Column:
    """Keeps Catalyst from copying a costly column into every filter and mention above it."""
    return F.when(F.spark_partition_id() >= 0, value)


def features(docs: DataFrame, columns: list[str]) -> DataFrame:
    """One row per row of `docs` (doc_id, text): its `columns` as a struct `__row`, and counts over its whole text.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines
    with a word that equal an earlier line), n_repeat_words (words in windows of
    three words that the text holds twice or more), and counts that only the
    rules use, in one struct column `q`. NULL texts have no words.
    """
    t = "__text"
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias(t),
    ).withColumn("__w", _kept_once(words(F.col(t))))
    n = F.size("__w")
    # Windows of three words as hashes with their place; equal hashes stand together once sorted.
    window = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.struct(
                F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)).alias("h"), i.alias("i")
            ),
        )
    )
    base = base.withColumn("__grams", _kept_once(F.when(n >= 3, window)))
    twice = F.filter(
        "__grams",
        lambda g, k: F.coalesce(g["h"] == F.get("__grams", k + 1)["h"], F.lit(False))
        | F.coalesce(g["h"] == F.get("__grams", k - 1)["h"], F.lit(False)),
    )
    base = base.withColumn("__at", _kept_once(F.sort_array(F.transform(twice, lambda g: g["i"]))))
    covered = F.aggregate(
        F.transform("__at", lambda p, k: F.coalesce(F.least(F.lit(3), F.get("__at", k + 1) - p), F.lit(3))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    base = base.withColumn(
        "__lines", _kept_once(F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]")))
    )
    stop = F.array(*[F.lit(x) for x in sorted(set(STOP_WORDS))])
    chars = F.aggregate("__w", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    q = F.struct(
        n.cast("bigint").alias("n_words"),
        chars.alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size("__lines").alias("n_lines"),
        F.size(F.array_intersect(F.transform("__w", lambda w: F.lower(w)), stop)).alias("n_stop"),
        F.regexp_count(t, F.lit("[A-Z]")).alias("n_upper"),
        F.regexp_count(t, F.lit("[!?]")).alias("n_shouts"),
        F.regexp_count(t, F.lit(f"[.!?](?=[{SPACE_CLASS}]|\\z)")).alias("n_ends"),
        F.size(F.array_distinct("__w")).alias("n_distinct"),
    )
    return base.select("__row", _kept_once(q).alias("q"))


def votes(q: str = "q") -> dict[str, Column]:
    """What each rule says of a document: 1 good, 0 bad, NULL nothing. Texts without words get no vote."""

    def c(name: str) -> Column:
        return F.col(f"{q}.{name}").cast("double")

    n, chars = (F.when(c(name) > 0, c(name)) for name in ("n_words", "word_chars"))

    def low(value: Column, good: float, bad: float) -> Column:
        return F.when(value <= good, 1).when(value >= bad, 0)

    def high(value: Column, good: float, bad: float) -> Column:
        return F.when(value >= good, 1).when(value <= bad, 0)

    ends, mean = c("n_ends") / n, c("word_chars") / n
    long = c("n_words") >= 50
    return {
        "symbols": low(c("n_symbols") / chars, 0.01, 0.05),
        "capitals": low(c("n_upper") / chars, 0.10, 0.30),
        "repeats": low(c("n_repeat_words") / n, 0.10, 0.30),
        # Longer texts use a word again more often.
        "variety": high(c("n_distinct") / F.least(n, F.lit(400.0)), 0.50, 0.35),
        "sentences": F.when(ends.between(0.02, 0.35), 1).when(long & ((ends < 0.005) | (ends > 0.60)), 0),
        "shouts": low(c("n_shouts") / n, 0.05, 0.30),
        "lines": F.when(c("n_lines") >= 5, low(c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1.0)), 0.10, 0.30)),
        "word_length": F.when(mean.between(3, 9), 1).when((mean < 2) | (mean > 14), 0),
        "stop_words": F.when(long, high(c("n_stop"), 3, 0)),
    }


def accuracies(
    voted: DataFrame,
    rules: tuple[str, ...] = RULES,
    rounds: int = 50,
    prior: float = 0.9,
    trust: tuple[float, float] = (0.9995, 30.0),
    power: tuple[float, float] = (0.3, 0.1),
) -> dict:
    """Estimates {"prior": p, rule: (right about good, right about bad)} from columns v_<rule> of `voted`.

    Naive Bayes by expectation-maximisation. Each rate starts at, and is drawn to, the
    mean of a prior: `trust` says how often a rule is right about good documents and
    `power` how often about bad ones, each with its weight in documents for
    each document there is. The first weighs far more than the votes: rules look
    at one text from nine sides, so their good votes are not independent, and without it
    one frequent kind of bad document passes for good ones with an accuser.
    Only sums by rule and vote leave the executors, and parameters enter as data, so
    all rounds run the same code.
    """
    cols = [f"v_{r}" for r in rules]
    counts = saved(
        voted.select(F.array(F.lit(1), *[F.col(c).cast("int") for c in cols]).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")),
        "votes",
    )
    model = {"prior": prior} | dict.fromkeys(rules, (trust[0], power[0]))
    for _ in range(rounds):
        p = counts.withColumn("p", _chance(F.col("v"), model, rules))
        cells = p.select("n", "p", F.posexplode("v").alias("rule", "vote")).where("vote IS NOT NULL")
        found = cells.groupBy("rule", "vote").agg(F.sum(F.col("n") * F.col("p")).alias("good"), F.sum(F.col("n") * (1 - F.col("p"))).alias("bad"))
        s = {(r.rule, r.vote): (r.good, r.bad) for r in found.collect()}  # three rows a rule at most
        good, bad = s.get((0, 1), (0.0, 0.0))
        all_rows = good + bad
        new = {"prior": (good + 1) / (all_rows + 2)}
        for k, r in enumerate(rules, 1):
            (g1, b1), (g0, b0) = s.get((k, 1), (0.0, 0.0)), s.get((k, 0), (0.0, 0.0))
            t, w = trust[1] * all_rows + 1, power[1] * all_rows + 1
            new[r] = ((g1 + trust[0] * t) / (g1 + g0 + t), (b0 + power[0] * w) / (b1 + b0 + w))
        moved = max(abs(new["prior"] - model["prior"]), *(abs(new[r][i] - model[r][i]) for r in rules for i in (0, 1)))
        model = new
        if moved < 1e-6:
            break
    return model


def _chance(v: Column, model: dict, rules: tuple[str, ...]) -> Column:
    """Probability of being good given an array of votes, the first of which is always 1."""
    yes = [math.log(model["prior"] / (1 - model["prior"]))] + [math.log(model[r][0] / (1 - model[r][1])) for r in rules]
    no = [0.0] + [math.log((1 - model[r][0]) / model[r][1]) for r in rules]
    odds = F.aggregate(
        F.transform(v, lambda x, i: F.when(x == 1, F.get(F.lit(yes), i)).when(x == 0, F.get(F.lit(no), i)).otherwise(F.lit(0.0))),
        F.lit(0.0),
        lambda a, x: a + x,
    )
    return 1 / (1 + F.exp(-odds))


def posterior(model: dict, rules: tuple[str, ...] = RULES) -> Column:
    """Probability of being good given the votes in columns v_<rule>."""
    return _chance(F.array(F.lit(1), *[F.col(f"v_{r}") for r in rules]), model, rules)


def judge_quality(docs: DataFrame, threshold: float = 0.5, least_words: int = 50, columns: list[str] | None = None) -> DataFrame:
    """The rows of `docs` (doc_id, text and others) with q, base_failed, p_good and kept.

    base_failed: fewer than `least_words` words, or more than half of them in repeated
    windows; such rows are not kept, and the others are when p_good, the
    posterior probability of being good, reaches `threshold`. Accuracies come from
    the votes on all rows, repeated ones counted each. NULL and empty texts fail.
    `columns` names those of `docs` that are handed on (default: all); they are
    saved with the measures, so that no text is measured twice. An empty table
    gives an empty result. A column of `docs` that is called like one of the four is
    replaced.
    """
    columns = docs.columns if columns is None else columns
    measured = saved(features(docs, columns), "quality")
    failed = (F.col("q.n_words") < least_words) | (100 * F.col("q.n_repeat_words") > 50 * F.col("q.n_words"))
    measured = measured.withColumn("base_failed", failed)
    names = {r: f"v_{r}" for r in RULES}
    voted = measured.select("*", *[v.alias(names[r]) for r, v in votes().items()])
    model = accuracies(voted)
    out = voted.withColumn("p_good", posterior(model))
    added = {
        "q": F.col("q"),
        "base_failed": F.col("base_failed"),
        "p_good": F.col("p_good"),
        "kept": ~F.col("base_failed") & (F.col("p_good") >= threshold),
    }
    old = [F.col(f"__row.`{c}`").alias(c) for c in columns if c not in added]
    return out.select(*old, *[value.alias(name) for name, value in added.items()])


def digest(judged: DataFrame) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *[F.col(f"q.{c}").alias(c) for c in names], "base_failed", "kept", "p_good")
