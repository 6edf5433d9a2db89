"""Quality rules by weak supervision, in DataFrame expressions only.

Each rule looks at one statistic of a text and votes good (1), bad (-1) or abstains (0).
Expectation-maximisation over the counts of vote patterns estimates how often each rule
votes which way on good and on bad documents, and the share of good ones; no label is
used. A document's posterior probability of being good follows from its votes by Bayes'
rule, as a column expression. It replaces filtering by passing every rule.

The statistics are computed once for each text and written as a narrow table; what EM
sees is one row a vote pattern, at most 3 ** rules of them whatever the input's size.

Edge cases: a null or empty text has no words and fails the base rule; long texts are
read whole; repeated rows are rated alike and each counts in training; a null id stays
null; an empty table gives an empty result; other columns are not read, whatever they are
called.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varispark.session import materialise

#: Fixed values of the contract: white space and symbols.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Votes bad from ``bad`` on and good up to ``good``; between them it abstains.

    ``noise`` is how often it is expected to call a good document bad.
    """

    name: str
    value: str
    good: float
    bad: float
    noise: float = 0.002


RULES = (
    Rule("symbols", "n_symbols / greatest(word_chars, 1)", 0.01, 0.05),
    Rule("dup_lines", "n_dup_lines / greatest(n_lines, 1)", 0.10, 0.50, 0.05),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", 0.12, 0.35),
    Rule("capitals", "n_capitals / greatest(word_chars, 1)", 0.15, 0.40),
    Rule("shouts", "n_shouts / greatest(n_words, 1)", 0.05, 0.20),
    Rule("same_words", "1 - n_distinct / greatest(n_words, 1)", 0.70, 0.88),
    Rule("word_length", "abs(word_chars / greatest(n_words, 1) - 6)", 3.5, 7.0),
)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the statistics that the rules use."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    df = docs.select(docs[id_col].alias("doc_id"), text.alias("text"))
    words = F.array_remove(F.split(F.translate("text", SPACES, " " * len(SPACES)), " "), "")
    lines = F.filter(F.split("text", "\n"), lambda x: _without(x, SPACES) != "")
    bare = _without(F.col("text"), SPACES)
    df = df.select(
        "doc_id",
        words.alias("w"),
        lines.alias("lines"),
        F.length(bare).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("bigint").alias("n_symbols"),
        (F.length("text") - F.length(_without(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).alias("n_capitals"),
        (F.length("text") - F.length(_without(F.col("text"), "!"))).alias("n_shouts"),
    )
    df = df.withColumn("n", F.size("w"))
    df = df.withColumn("g", F.expr("case when n >= 3 then transform(sequence(0, n - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) else cast(array() as array<bigint>) end"))
    # a sort is needed only where some window occurs twice
    df = df.withColumn("s", F.expr("case when size(array_distinct(g)) < size(g) then sort_array(transform(g, (h, i) -> struct(h, i))) end"))
    df = df.withColumn("at", F.expr("case when s is not null then sort_array(transform(filter(s, (x, k) -> (k > 0 and s[greatest(k - 1, 0)].h = x.h) or (k < size(s) - 1 and s[least(k + 1, size(s) - 1)].h = x.h)), x -> x.i)) end"))
    repeats = F.expr("case when at is null then 0L else aggregate(at, named_struct('to', -3, 'n', 0L), (a, i) -> named_struct('to', i, 'n', a.n + least(3, i - a.to)), a -> a.n) end")
    return df.select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        "n_capitals",
        "n_shouts",
        F.size(F.array_distinct("w")).alias("n_distinct"),
    )


def vote(rule: Rule) -> Column:
    v = F.expr(rule.value)
    return F.when(v >= rule.bad, -1).when(v <= rule.good, 1).otherwise(0)


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and each rule's probabilities of (-1, 0, 1) on bad and on good ones."""

    good: float
    rates: tuple[tuple[tuple[float, float, float], tuple[float, float, float]], ...]

    def log_odds(self, rule: int, v: int) -> float:
        bad, good = self.rates[rule]
        return math.log(good[v + 1]) - math.log(bad[v + 1])

    def posterior(self, votes: list[Column]) -> Column:
        """Probability of being good."""
        odds = F.lit(math.log(self.good) - math.log(1 - self.good))
        for j, v in enumerate(votes):
            odds = odds + F.when(v == 1, self.log_odds(j, 1)).when(v == -1, self.log_odds(j, -1)).otherwise(self.log_odds(j, 0))
        return 1 / (1 + F.exp(-odds))


def fit(patterns: list[tuple[tuple[int, ...], int]], noises: list[float], rounds: int = 50) -> LabelModel:
    """EM over (votes, count).

    Two constraints tell good from bad, as documents that break a single rule don't show
    by agreement between rules: a rule calls good documents bad no more often than its
    noise, and how it splits its other votes between good and abstaining doesn't depend
    on the class.
    """
    total = sum(n for _, n in patterns)
    speaks = []
    for j in range(len(noises)):
        good, none = (1 + sum(n for v, n in patterns if v[j] == k) for k in (1, 0))
        speaks.append(good / (good + none))
    recall = [0.3] * len(noises)
    false = list(noises)
    share = 0.8

    def model() -> LabelModel:
        rows = lambda q, s: (q, (1 - q) * (1 - s), (1 - q) * s)
        return LabelModel(share, tuple((rows(r, s), rows(f, s)) for r, f, s in zip(recall, false, speaks, strict=True)))

    for _ in range(rounds):
        m = model()
        good_mass, called_bad, called_good = 0.0, [0.0] * len(noises), [0.0] * len(noises)
        for votes, n in patterns:
            odds = math.log(m.good) - math.log(1 - m.good) + sum(m.log_odds(j, v) for j, v in enumerate(votes))
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            good_mass += n * p
            for j, v in enumerate(votes):
                if v == -1:
                    called_bad[j] += n * (1 - p)
                    called_good[j] += n * p
        share = (0.8 + good_mass) / (1 + total)
        recall = [(0.3 + c) / (1 + total - good_mass) for c in called_bad]
        recall = [min(0.999, max(r, 2 * f)) for r, f in zip(recall, noises, strict=True)]
        false = [min(noise, (noise + c) / (1 + good_mass)) for noise, c in zip(noises, called_good, strict=True)]
    return model()


def rate_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """One row per document: base statistics, base_failed, each rule's vote, posterior and kept."""
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    stats = statistics(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    names = [f"vote_{r.name}" for r in rules]
    table = materialise(stats.select(*base, failed.alias("base_failed"), *[vote(r).alias(n) for r, n in zip(rules, names, strict=True)]))
    # at most 3 ** len(rules) rows
    patterns = [(tuple(r[n] for n in names), r["count"]) for r in table.groupBy(*names).count().collect()]
    model = fit(sorted(patterns), [r.noise for r in rules])
    return table.withColumn("posterior", model.posterior([F.col(n) for n in names])).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
