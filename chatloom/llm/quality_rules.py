"""Quality of texts by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

All of it is DataFrame functions. Each rule looks at one measure of a text and votes good, bad or not at
all. Rows with the same votes are the same to the model, so they are counted by vote pattern (at most
``3 ** rules`` of them) and the estimation runs on that table: the E step gives each pattern its posterior
probability of being good, the M step the share of good texts and, per rule, how often it is right about
good and about bad texts. Only these sums, two per rule and one more, come to the driver.

Null and empty texts have no words and fail the base rules. Every row is judged on its own text, so
repeated rows get the same verdict. Ties at probability one half are kept. Without rows there is nothing
to estimate and the starting accuracies stand.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.base import stored

#: Fixed values of the base measures.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Votes good where ``good`` holds, else bad where ``bad`` holds, else abstains. Integer SQL on measures."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("symbols_to_words", "100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("symbols_to_chars", "1000 * n_symbols <= word_chars", "50 * n_symbols > word_chars"),
    Rule("letters", "100 * n_letters >= 93 * word_chars", "100 * n_letters < 88 * word_chars"),
    Rule("word_length", "word_chars between 3 * n_words and 8 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule("lines", "20 * n_dup_lines <= n_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("repeats", "20 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    Rule("case", "10 * n_capitals <= n_letters", "10 * n_capitals > 3 * n_letters"),
    Rule("sentences", "n_words <= 30 * n_stops", "n_words > 60 * n_stops"),
)


def text_measures(docs: DataFrame, carry: bool = False) -> DataFrame:
    """``doc_id`` and the measures of each whole text; with ``carry`` also the input row as ``_row``.

    ``n_repeat_words`` are words inside 3-word windows that occur again in the text. Windows are told
    apart by a 64-bit hash of their words; positions of equal windows are neighbours after sorting.
    """
    text = F.col("text")
    count = lambda kept: F.length(text) - F.length(F.translate(text, kept, ""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, BLANKS, "")) > 0)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = rows.select("_row", F.col("_row.doc_id").cast("bigint").alias("doc_id"), F.coalesce("_row.text", F.lit("")).alias("text"))
    kept = ["_row"] if carry else []
    parts = rows.select(
        *kept,
        "doc_id",
        words.alias("words"),
        lines.alias("lines"),
        (F.length(text) - count(BLANKS)).cast("bigint").alias("word_chars"),
        count(SYMBOLS).cast("bigint").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"\P{L}+", "")).cast("bigint").alias("n_letters"),
        F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("bigint").alias("n_capitals"),
        count(".!?").cast("bigint").alias("n_stops"),
    )
    n = F.size("words")
    windows = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    parts = parts.withColumn("windows", windows)
    # equal hashes are neighbours in this order; it is only built where some window occurs again
    ranked = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    parts = parts.withColumn("ranked", ranked)

    def again(pair: Column, at: Column) -> Column:
        # the neighbour before the first is looked for behind the end, where there is none
        before = F.get("ranked", F.when(at > 0, at - 1).otherwise(F.size("ranked")))
        return F.coalesce(before["h"] == pair["h"], F.lit(False)) | F.coalesce(F.get("ranked", at + 1)["h"] == pair["h"], F.lit(False))

    parts = parts.withColumn("starts", F.array_sort(F.transform(F.filter("ranked", again), lambda p: p["i"])))
    covered = F.aggregate(
        F.transform("starts", lambda s, at: F.least(F.lit(3), F.coalesce(F.get("starts", at + 1) - s, F.lit(3)))),
        F.lit(0).cast("bigint"),
        lambda total, more: total + more,
    )
    return parts.select(
        *kept,
        "doc_id",
        n.cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        "n_letters",
        "n_capitals",
        "n_stops",
    )


def base_failed() -> Column:
    return F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words")


def with_votes(measures: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A column ``votes`` of one character per rule: ``+``, ``-`` or ``0`` for none."""
    votes = [F.when(F.expr(r.good), "+").when(F.expr(r.bad), "-").otherwise("0") for r in rules]
    return measures.withColumn("votes", F.concat(*votes))


@dataclass(frozen=True)
class Accuracies:
    """Share of good texts, and per rule the chance that its vote on a good, or bad, text is right."""

    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]


def start(rules: int) -> Accuracies:
    return Accuracies(0.8, (0.8,) * rules, (0.6,) * rules)


def posterior(accuracies: Accuracies) -> Column:
    """Probability of being good, given the column ``votes``."""
    odds = F.lit(math.log(accuracies.prior) - math.log(1 - accuracies.prior))
    for at, (good, bad) in enumerate(zip(accuracies.on_good, accuracies.on_bad)):
        vote = F.substring("votes", at + 1, 1)
        odds = odds + F.when(vote == "+", math.log(good) - math.log(1 - bad)).when(
            vote == "-", math.log(1 - good) - math.log(bad)
        ).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def _within(value: float, low: float, high: float) -> float:
    return min(max(value, low), high)


def estimate(patterns: DataFrame, rules: int, rounds: int = 30, settled: float = 1e-4) -> Accuracies:
    """Expectation-maximisation over ``votes, n``.

    Accuracies stay in [0.01, 0.99], and a rule whose two add up to less than one, which would be worse
    than chance, counts as one that tells nothing; the share of good texts stays in [0.05, 0.95]. So the
    two classes cannot change places. Sums are smoothed by one text.
    """
    now = start(rules)
    for _ in range(rounds):
        good = F.col("n") * F.col("_p")
        bad = F.col("n") * (1 - F.col("_p"))
        sums = [F.sum("n"), F.sum(good)]
        for at in range(rules):
            vote = F.substring("votes", at + 1, 1)
            sums += [
                F.sum(F.when(vote == "+", good)),
                F.sum(F.when(vote != "0", good)),
                F.sum(F.when(vote == "-", bad)),
                F.sum(F.when(vote != "0", bad)),
            ]
        row = [float(x or 0.0) for x in patterns.withColumn("_p", posterior(now)).agg(*sums).first()]
        if not row[0]:
            return now
        first = start(rules)
        share = lambda right, voted, before: _within((right + before) / (voted + 1), 0.01, 0.99)
        on_good = tuple(share(row[2 + 4 * i], row[3 + 4 * i], first.on_good[i]) for i in range(rules))
        on_bad = tuple(max(share(row[4 + 4 * i], row[5 + 4 * i], first.on_bad[i]), 1 - on_good[i]) for i in range(rules))
        later = Accuracies(_within((row[1] + first.prior) / (row[0] + 1), 0.05, 0.95), on_good, on_bad)
        change = max(abs(a - b) for a, b in zip((later.prior, *later.on_good, *later.on_bad), (now.prior, *now.on_good, *now.on_bad)))
        now = later
        if change < settled:
            break
    return now


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = 30) -> DataFrame:
    """Measures, ``base_failed``, ``votes``, ``quality`` (the posterior) and ``kept`` of every row.

    The model is estimated on the rows that pass the base rules. Measures are stored once: a few numbers
    per text.
    """
    rows = with_votes(text_measures(docs), rules).withColumn("base_failed", base_failed())
    rows = stored(rows, "quality-measures")
    patterns = stored(rows.filter(~F.col("base_failed")).groupBy("votes").agg(F.count(F.lit(1)).alias("n")), "vote-patterns")
    quality = posterior(estimate(patterns, len(rules), rounds))
    return rows.withColumn("quality", quality).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def keep_good(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs`` with all their columns.

    Rows that pass the base rules are stored with their votes, so texts are measured once.
    """
    rows = with_votes(text_measures(docs, carry=True)).withColumn("base_failed", base_failed())
    # a filter stays above a column of row numbers that it reads; pushed down, it would write out all
    # measures anew at each use of a vote
    rows = rows.withColumn("_at", F.monotonically_increasing_id()).filter(~F.col("base_failed") & (F.col("_at") >= 0))
    rows = stored(rows.select("votes", "_row"), "quality-rows")
    patterns = stored(rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), "vote-patterns")
    quality = posterior(estimate(patterns, len(RULES)))
    return rows.filter(quality >= 0.5).select("_row.*")
