"""Quality rules as a short-circuit cascade.

Every rule rejects rows. On a sample, each rule's cost (seconds to evaluate it there) and selectivity (share it rejects)
are measured; the rules then run in the order of rejected rows per second. A row is tested only until the first rule
rejects it: the cascade is one CASE expression, which Spark leaves at the first branch that holds. The order changes the cost and which
rule is named for a row, never which rows are kept.

Everything here is built-in column functions inside one scan; a row never leaves its partition, so hot keys do not exist.

Defined results: a null text has no words and all counts 0; so has an empty one. Equal rows give equal results. Texts of any length are
read whole. An empty table gives no rows. Input columns named like an output column are replaced, others stay.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusdiff.llm.common import SPACES, stored, words
from corpusdiff.session import pin

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a boolean column over a row with ``text`` and the columns of ``measure``; null counts as false."""

    name: str
    rejects: Column


def base_rules() -> list[Rule]:
    return [
        Rule("few_words", F.col("n_words") < 10),
        Rule("repeated_windows", 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    ]


def production_rules() -> list[Rule]:
    """The base rules and five more with thresholds in wide use for web text."""
    letters = F.length("text") - F.length(F.regexp_replace("text", r"\p{L}", ""))
    lines = F.size(F.split("text", "\n", -1))
    return [
        *base_rules(),
        Rule("symbols", 10 * F.col("n_symbols") > 3 * F.col("n_words")),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 3 * lines),
        Rule("short_words", F.col("word_chars") < 2 * F.col("n_words")),
        Rule("long_words", F.col("word_chars") > 15 * F.col("n_words")),
        Rule("few_letters", 10 * letters < 6 * F.col("word_chars")),
    ]


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the five counts of ``MEASURES`` as long columns."""
    whole = F.coalesce(F.col(text), F.lit(""))
    spaces_off = F.translate(whole, SPACES, "")
    with_words = F.filter(F.split(whole, "\n", -1), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    rest = [c for c in df.columns if c not in MEASURES]
    first = df.select(
        *rest,
        words(whole).alias("ws_"),
        F.length(spaces_off).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        with_words.alias("lines_"),
    )
    n = F.size("ws_")
    windows = F.when(
        n > WINDOW,
        F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("ws_", i, WINDOW))),
    )
    second = pin(first).select(
        *rest, "word_chars", "n_symbols",
        n.cast("long").alias("n_words"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        windows.alias("grams_"),
    )
    repeated = F.size("grams_") > F.size(F.array_distinct("grams_"))
    ordered = F.array_sort(F.transform("grams_", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    third = pin(second).withColumn("sorted_", F.when(repeated, ordered)).drop("grams_")
    s = F.col("sorted_")
    twice = F.transform(
        s, lambda x, k: F.when(F.get(s, k + 1)["g"].eqNullSafe(x["g"]) | F.get(s, k - 1)["g"].eqNullSafe(x["g"]), x["i"])
    )
    fourth = pin(third).withColumn("at_", F.array_sort(F.filter(twice, lambda i: i.isNotNull()))).drop("sorted_")
    at = F.col("at_")
    reach = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(reach, F.lit(0), lambda a, b: a + b)
    return pin(fourth).withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at_")


def order_rules(df: DataFrame, rules: list[Rule], fraction: float = 0.02, rows: int = 4000, runs: int = 2) -> list[Rule]:
    """The rules by rejected rows per second of cost, both taken on a sample of at most ``rows`` rows of ``df`` (with ``text``).

    A rule's cost includes the counts it needs, since Spark computes no others for it. Without rows, or for rules that
    reject nothing, the given order stays. Only the order comes from the sample.
    """
    sample = stored(df.select("text").sample(fraction, seed=7).limit(rows), "rule-sample")

    def seconds(source: DataFrame, count: Column) -> tuple[float, int]:
        best, found = float("inf"), 0
        for _ in range(runs):
            start = time.perf_counter()
            found = source.agg(count.alias("n")).first()["n"] or 0
            best = min(best, time.perf_counter() - start)
        return best, found

    idle, _ = seconds(sample, F.count("text"))
    scored = []
    for place, rule in enumerate(rules):
        cost, rejected = seconds(measure(sample), F.sum(F.when(rule.rejects, 1).otherwise(0)))
        scored.append((-rejected / max(cost - idle, 1e-3), place, rule))
    return [rule for _, _, rule in sorted(scored, key=lambda x: x[:2])]


def cascade(measured: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``failed_rule``, the first rule in the given order that rejects the row (null: none), and ``kept``."""
    first = F.lit(None).cast("string")
    for rule in reversed(rules):
        first = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name)).otherwise(first)
    return pin(measured.withColumn("failed_rule", first)).withColumn("kept", F.col("failed_rule").isNull())


def filter_rows(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows that no rule rejects, without the counts: each rule measures only what the rules before it have left."""
    for rule in rules:
        left = measure(df).filter(~F.coalesce(rule.rejects, F.lit(False)))
        df = pin(left.select(*df.columns))
    return df


def quality_rules(df: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """Measure all rows, order the rules on a sample, and apply them in that order."""
    rules = rules or production_rules()
    source = df if text == "text" else df.withColumn("text", F.col(text))
    base = F.lit(False)
    for rule in base_rules():
        base = base | rule.rejects
    return cascade(measure(source), order_rules(source, rules)).withColumn("base_failed", base)
