"""Operator 9: quality rules as one projection of built-in expressions.

A table of thresholds over length, symbol, stop-word, repetition and line measures is compiled into one projection;
no user function runs and no row is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.shared import SPACE, bind, words_of

SYMBOLS = "#*$%&|<>"
SHOUTS = "!?"

#: Frequent function words of seven languages.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he his are this at from or have an they which "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an "
    "le la les et des en un du une que est pour qui dans par pas au sur de il "
    "el los las que y del se por con una su para no al lo como más "
    "di e il che non per è si con i da ha gli "
    "o do da em um os na não mais como dos "
    "het een van dat op te zijn voor met niet aan er"
).split()


class Rule(NamedTuple):
    """A document is kept while `least <= measure <= most`."""

    measure: str
    least: float
    most: float


#: The threshold table. Measures are the columns of `measures` and the ratios of `ratios`.
RULES = (
    Rule("mean_word_length", 2, 20),
    Rule("symbol_ratio", 0, 0.1),
    Rule("shout_ratio", 0, 0.3),
    Rule("stop_word_ratio", 0.02, 1),
    Rule("dup_line_ratio", 0, 0.5),
)
BASE_RULES = (Rule("n_words", 50, float("inf")), Rule("repeat_percent", 0, 50))


def _repeated_words(words: Column) -> Column:
    """How many words lie in a window of three words that the text holds twice or more.

    Windows are sorted with their places, so equal ones meet; the places of the repeated ones, sorted again, cover
    three words each, less what the one before covers. That takes n log n steps, however repetitive the text is.
    """

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.struct(
            F.concat_ws(" ", w[i - 1], w[i], w[i + 1]).alias("g"), i.alias("i")
        ))

    def repeated(s: Column) -> Column:
        before = lambda i: (i > 1) & (F.get(s, i - 2)["g"] == F.get(s, i - 1)["g"])
        after = lambda i: (i < F.size(s)) & (F.get(s, i)["g"] == F.get(s, i - 1)["g"])
        found = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: before(i) | after(i))
        return F.sort_array(F.transform(found, lambda i: F.get(s, i - 1)["i"]))

    def covered(r: Column) -> Column:
        gaps = F.transform(r, lambda at, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), at - F.get(r, k - 1))))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    count = bind(F.sort_array(windows(words)), lambda s: bind(repeated(s), covered))
    return F.when(F.size(words) < 3, 0).otherwise(count).cast("long")


def measures(text: Column) -> Column:
    """A struct of counts over the whole text; every count of a null or empty text is 0."""
    whole = F.coalesce(text, F.lit(""))
    blank = lambda s: F.translate(s, SPACE, "")
    lines = F.filter(F.split(whole, "\n"), lambda s: blank(s) != "")
    length = lambda s: F.char_length(s).cast("long")
    of_words = bind(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        _repeated_words(w).alias("n_repeat_words"),
    ))
    of_lines = bind(lines, lambda s: F.struct(
        F.size(s).cast("long").alias("n_lines"), (F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines")
    ))
    return bind(F.struct(of_words.alias("w"), of_lines.alias("l")), lambda m: F.struct(
        m["w"]["n_words"].alias("n_words"), length(blank(whole)).alias("word_chars"),
        (length(whole) - length(F.translate(whole, SYMBOLS, ""))).alias("n_symbols"),
        (length(whole) - length(F.translate(whole, SHOUTS, ""))).alias("n_shouts"),
        m["w"]["n_stop_words"].alias("n_stop_words"), m["w"]["n_repeat_words"].alias("n_repeat_words"),
        m["l"]["n_lines"].alias("n_lines"), m["l"]["n_dup_lines"].alias("n_dup_lines"),
    ))


def ratios(m: Column) -> dict[str, Column]:
    """What the rules look at, by name, from a struct of `measures`; a ratio over nothing is 0."""
    of = lambda a, b: F.when(m[b] > 0, m[a] / m[b]).otherwise(0.0)
    return {
        "n_words": m["n_words"], "repeat_percent": of("n_repeat_words", "n_words") * 100,
        "mean_word_length": of("word_chars", "n_words"), "symbol_ratio": of("n_symbols", "n_words"),
        "shout_ratio": of("n_shouts", "n_words"), "stop_word_ratio": of("n_stop_words", "n_words"),
        "dup_line_ratio": of("n_dup_lines", "n_lines"),
    }


def _passes(rules: Sequence[Rule], of: dict[str, Column]) -> Column:
    verdict = F.lit(True)
    for rule in rules:
        verdict &= of[rule.measure].between(rule.least, rule.most)
    return verdict


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE_RULES, text: str = "text") -> DataFrame:
    """The rows with `quality`: a struct of the measures, `base_failed` and `kept`.

    A null or empty text has no words and fails the base rules; a text of any length is measured whole; repeated
    rows are judged alike, one by one; an empty table stays empty. A column named `quality` is replaced.
    """
    def verdicts(m: Column) -> Column:
        of = ratios(m)
        base_failed = ~_passes(base, of)
        return F.struct(m.alias("m"), base_failed.alias("base_failed"), (~base_failed & _passes(rules, of)).alias("kept"))

    return docs.withColumn("quality", bind(measures(F.col(text)), verdicts))


def kept(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE_RULES, text: str = "text") -> DataFrame:
    """The rows that pass, in the columns of `docs`."""
    return docs.where(bind(measures(F.col(text)), lambda m: _passes([*base, *rules], ratios(m))))
