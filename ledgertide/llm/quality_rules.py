"""Quality rules whose cutoffs hold a stated risk: labelled holdouts, exact binomial bounds, correction for many tests.

A rule compares two whole-number signals of a text (symbols against letters, repeated words against words, ...) with one
of a ladder of cutoffs, lenient ones first. A cutoff rejects wrongly where it rejects a document labelled good. For each
stratum (language) and rule the cutoffs are tested in the order of the ladder: one holds if the exact binomial
probability of so few wrong rejections, were their true share above the rule's part of LIMIT, is at most the rule's part
of DELTA; the first cutoff that does not hold ends the test (a fixed sequence needs no further correction), and the last
one that held is used. LIMIT is shared out among the rules and DELTA among all pairs of stratum and rule (Bonferroni),
so with probability 1 - DELTA no stratum loses more than LIMIT of its good documents to the rules. A stratum without
enough labels to show that rejects nothing by these rules. The ladders are fixed beforehand, so every labelled document
is a holdout.

Labels are joined to slim rows of signals; only counts per stratum, rule and cutoff are gathered, summed before the
shuffle, so a stratum of any size is one row per cutoff. Everything is DataFrame functions.

Edge cases: null and empty texts have no words and fail the base rule; a null stratum is a stratum of its own; labels
other than 1 are no holdout; a document labelled more than once is good if any label says so; rows that repeat a doc_id
count once per stratum, each rule with its most lenient cutoff that rejects any of them; a null doc_id has no label;
without labels only the base rule rejects; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgertide.llm.work import settle, whole

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPAN = 8  # words in a window that counts as repeated
LEAST_WORDS, MOST_REPEATED = 20, 30  # the base rule: words, percent of words in repeated windows

#: Wrong rejections of good documents allowed per stratum, and the chance that this is missed anywhere.
LIMIT, DELTA = 0.02, 0.05


@dataclass(frozen=True)
class Rule:
    """Rejects where factor * signal is above cutoff * base (below it, if `low`)."""

    name: str
    signal: str
    base: str
    factor: int
    cutoffs: tuple[int, ...]
    low: bool = False

    def rejects(self, cutoff: int) -> Column:
        left, right = F.lit(self.factor) * F.col(self.signal), F.lit(cutoff) * F.col(self.base)
        return left < right if self.low else left > right

    def reach(self) -> Column:
        """How many cutoffs let the document pass: the place of the first one that rejects it."""
        passed = F.lit(0)
        for cutoff in self.cutoffs:
            passed = passed + F.when(self.rejects(cutoff), 0).otherwise(1)
        return passed


#: The ladders, lenient first; part of the operator's parameters and not fitted.
RULES = (
    Rule("symbols", "n_symbols", "word_chars", 1000, (300, 200, 150, 100, 70, 50, 30, 20, 10, 5)),
    Rule("capitals", "n_capitals", "word_chars", 1000, (700, 600, 500, 400, 300, 250, 200, 150, 120, 100)),
    Rule("repeats", "n_repeat_words", "n_words", 100, (29, 27, 25, 22, 20, 15, 10, 5, 2, 0)),
    Rule("lines", "n_dup_lines", "n_lines", 100, (90, 80, 70, 60, 50, 40, 30, 20, 15, 10)),
    Rule("variety", "n_distinct", "n_words", 100, (5, 10, 15, 20, 25, 30, 35, 40, 45, 50), low=True),
    Rule("length", "word_chars", "n_words", 10, (200, 150, 120, 100, 90, 85, 80, 75, 70, 65)),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, also where the body is a lambda of its own."""
    return F.transform(F.array(value), body)[0]


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def neighbours(rows: Column, key: Callable[[Column], Column]) -> Column:
    """Entries of a sorted array whose key is equal to that of the entry before or behind."""

    def equal(sorted_rows: Column) -> Column:
        def same(row: Column, i: Column) -> Column:
            before, behind = key(F.get(sorted_rows, i - 1)), key(F.get(sorted_rows, i + 1))
            return F.coalesce(key(row) == before, F.lit(False)) | F.coalesce(key(row) == behind, F.lit(False))

        return F.filter(sorted_rows, same)

    return let(rows, equal)


def joined_hashes(width: int) -> Column:
    """Hashes of windows of twice the width of those in the column `hashes`."""
    last = F.size("hashes") - 1 - width
    both = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.col("hashes")[i], F.col("hashes")[i + width])
    )
    return F.when(last >= 0, both).otherwise(F.array().cast("array<bigint>"))


def repeated_words(words: str, hashes: str) -> Column:
    """Words in windows of SPAN words that stand in the text at least twice; hashes: one for each window, in order."""
    placed = F.sort_array(F.transform(F.col(hashes), lambda h, i: F.struct(h.alias("key"), i.alias("at"))))
    likely = neighbours(placed, lambda s: s["key"])  # by hash, then by the words themselves
    spelt = F.transform(
        likely, lambda s: F.struct(F.array_join(F.slice(words, s["at"] + 1, SPAN), " ").alias("key"), s["at"].alias("at"))
    )
    places = F.sort_array(F.transform(neighbours(F.sort_array(spelt), lambda s: s["key"]), lambda s: s["at"]))
    start = F.struct(F.lit(0).alias("until"), F.lit(0).cast("long").alias("words"))
    covered = F.aggregate(
        places, start,
        lambda seen, at: F.struct(
            (at + SPAN).alias("until"), (seen["words"] + at + SPAN - F.greatest(seen["until"], at)).alias("words")
        ),
        lambda seen: seen["words"],
    )
    repeats = F.size(hashes) > F.size(F.array_distinct(hashes))
    return F.when(repeats, covered).otherwise(F.lit(0).cast("long"))


def signals(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, and the whole-number signals of the whole text."""
    text = whole()
    read = docs.select(
        "doc_id", F.col(stratum).cast("string").alias("stratum"), text.alias("text"),
        F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: without(line, SPACE) != "").alias("lines"),
    )
    # a window's hash from the hashes of its halves: each step doubles the width and is a column of its own
    read = read.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    width = 1
    while width < SPAN:
        read = read.withColumn("hashes", joined_hashes(width))
        width *= 2
    letters = without(F.col("text"), SPACE)
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(letters),
        "n_symbols": F.length("text") - F.length(without(F.col("text"), SYMBOLS)),
        "n_capitals": F.length("text") - F.length(without(F.col("text"), CAPITALS)),
        "n_distinct": F.size(F.array_distinct("words")),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeated_words("words", "hashes"),
    }
    return read.select("doc_id", "stratum", *[c.cast("long").alias(name) for name, c in counts.items()])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def log_factorial(n: Column) -> Column:
    """ln n!, exact up to 20 and by Stirling's series beyond, where its error is below 1e-13."""
    x = F.greatest(n, F.lit(1)).cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, share: float) -> Column:
    """P(X <= k) of a binomial X of n draws: its terms from the largest down, until they no longer count.

    Only for k below n * share, where terms fall from k down; from there on 1, which is no smaller than the truth.
    """
    odds = share / (1 - share)
    log_last = (
        log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(share) + (n - k) * math.log1p(-share)
    )
    ratio = k / ((n - k + 1) * odds)  # the term of k - 1 over that of k; ratios further down are smaller
    enough = F.when(k > 0, F.ceil(F.lit(-42.0) / F.log(F.least(ratio, F.lit(1 - 1e-12))))).otherwise(F.lit(0))
    steps = F.least(k, enough.cast("long"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(sum_: Column, j: Column) -> Column:
        term = sum_["term"] * (k - j + 1) / ((n - k + j) * odds)
        return F.struct(term.alias("term"), (sum_["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1).cast("long"), steps), start, add, lambda sum_: sum_["total"])
    tail = F.exp(log_last) * F.when(steps >= 1, total).otherwise(1.0)
    return F.when(k < n * share, F.least(tail, F.lit(1.0))).otherwise(1.0)


def calibrate(
    measured: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, limit: float = LIMIT, delta: float = DELTA
) -> DataFrame:
    """A row per stratum, rule and cutoff: n, wrong (rejected good documents), p_value, level, held (in use or milder)."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    held_out = measured.join(good, "doc_id").groupBy("doc_id", "stratum").agg(
        *[F.min(rule.reach()).alias(rule.name) for rule in rules]
    )
    reached = held_out.select("stratum", F.explode(F.array(*[
        F.struct(F.lit(k).alias("rule"), F.col(rule.name).alias("place")) for k, rule in enumerate(rules)
    ])).alias("r")).groupBy("stratum", "r.rule", "r.place").agg(F.count(F.lit(1)).alias("n"))
    # from here on a few rows per stratum
    sizes = reached.where("rule = 0").groupBy("stratum").agg(F.sum("n").alias("n"))
    strata = sizes.agg(F.count(F.lit(1)).alias("strata"))
    steps = F.explode(F.array(*[
        F.struct(F.lit(k).alias("rule"), F.lit(place).alias("place"), F.lit(rule.name).alias("name"), F.lit(cutoff).alias("cutoff"))
        for k, rule in enumerate(rules) for place, cutoff in enumerate(rule.cutoffs)
    ]))
    ladder = sizes.crossJoin(F.broadcast(strata)).select("stratum", "n", "strata", steps.alias("s")).select("*", "s.*").drop("s")
    here = reached.select(
        F.col("stratum").alias("of"), F.col("rule").alias("of_rule"), F.col("place").alias("at"), F.col("n").alias("here")
    )
    joined = ladder.join(here, F.expr("stratum <=> of AND rule = of_rule AND place = at"), "left")
    along = Window.partitionBy("stratum", "rule").orderBy("place")
    tested = joined.withColumn("wrong", F.sum(F.coalesce("here", F.lit(0))).over(along))
    tested = tested.withColumn("p_value", binomial_tail(F.col("wrong"), F.col("n"), limit / len(rules)))
    tested = tested.withColumn("level", F.lit(delta) / (F.col("strata") * len(rules)))
    held = F.min((F.col("p_value") <= F.col("level")).cast("int")).over(along) == 1
    return tested.select("stratum", "rule", "name", "place", "cutoff", "n", "wrong", "p_value", "level", held.alias("held"))


def scan(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", rules: tuple[Rule, ...] = RULES, limit: float = LIMIT,
    delta: float = DELTA,
) -> DataFrame:
    """Signals of every document, base_failed, kept, and failed_rules (names of the calibrated rules that reject it)."""
    measured = settle(signals(docs, stratum), "quality-signals")
    tested = calibrate(measured, labels, rules, limit, delta)
    chosen = settle(
        tested.where("held").groupBy(F.col("stratum").alias("of")).agg(*[
            F.coalesce(F.max(F.when(F.col("rule") == k, F.col("place"))), F.lit(-1)).alias(f"last_{rule.name}")
            for k, rule in enumerate(rules)
        ]),
        "quality-cutoffs",
    )
    joined = measured.join(chosen, F.expr("stratum <=> of"), "left")
    failed = F.array_compact(F.array(*[
        F.when(rule.reach() <= F.coalesce(f"last_{rule.name}", F.lit(-1)), rule.name) for rule in rules
    ]))
    return joined.select(*measured.columns, base_failed().alias("base_failed"), F.array_sort(failed).alias("failed")).select(
        *measured.columns, "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"),
        F.array_join("failed", ",").alias("failed_rules"),
    )
