"""Quality rules: a table of thresholds, compiled into one projection of built-in functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

SPACES = " \t\n\x0b\x0c\r"
# Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it was with as on be at by this from or an are have not "
    "der die das und zu von den dem ein eine ist für im sich auf nicht mit des es "
    "le les la un une et est de du dans pour sur au que qui il en par "
    "el los las y se del una con no su lo"
).split()


class Rule(NamedTuple):
    """``numerator`` over ``denominator`` must lie in [least, most]; a bound may be None."""

    numerator: str
    denominator: str
    least: float | None
    most: float | None


# Shares are of words, word characters and lines with a word.  Texts of less than 50
# words, or half of them in repeated windows, fail before these are asked.
RULES = {
    "word_length": Rule("word_chars", "n_words", 2.5, 12.0),
    "symbols": Rule("n_symbols", "word_chars", None, 0.05),
    "stop_words": Rule("n_stop_words", "n_words", 0.05, None),
    "repeated_lines": Rule("n_dup_lines", "n_lines", None, 0.5),
}
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50


def apply_quality_rules(df: DataFrame, text: str = "text", rules: dict[str, Rule] | None = None) -> DataFrame:
    """Add the measures of each text, ``base_failed``, ``failed_rules`` and ``kept``.

    All are fields of one struct that a generator yields, so each text is measured once
    whatever is asked of the result.  Words are runs of other than the six ASCII white
    space characters.  Ratios with a denominator of 0 break no rule.  Null and empty
    texts have no words: all measures are 0, ``base_failed`` is true and ``kept`` false.
    A column of the input with the name of a measure stays; the measures then have the
    prefix ``quality_``.  Rows are judged one by one, so repeated rows have equal results.
    """
    rules = RULES if rules is None else rules
    clean = F.coalesce(F.col(text), F.lit(""))
    result = let(words_of(clean), lambda words: _judged(_measures(clean, words), rules))
    names = [*MEASURES, "base_failed", "failed_rules", "kept"]
    if set(names) & set(df.columns):
        names = [f"quality_{n}" for n in names]
    return df.select("*", F.inline(F.array(result)).alias(*names))


MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words"
)


def words_of(text: Column) -> Column:
    """Runs of other than white space."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _removed(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, ""))


def _measures(text: Column, words: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    # Stop words carry punctuation at their ends.
    stops = F.filter(words, lambda w: F.lower(F.btrim(w, F.lit(".,;:!?"))).isin(STOP_WORDS))
    return let(lines, lambda kept: F.struct(
        F.size(words).cast("long").alias("n_words"),
        _removed(text, SPACES).cast("long").alias("word_chars"),
        (F.char_length(text) - _removed(text, "#*$%&|<>")).cast("long").alias("n_symbols"),
        (F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_dup_lines"),
        repeated_words(words).cast("long").alias("n_repeat_words"),
        F.size(kept).cast("long").alias("n_lines"),
        F.size(stops).cast("long").alias("n_stop_words"),
    ))


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that the text has twice or more, the first one included.

    Windows are compared by 64-bit hashes.  Most texts have no equal windows, and then
    nothing is sorted.
    """
    first = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    windows = F.transform(first, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))


def _covered(hashes: Column) -> Column:
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(rows: Column) -> Column:
        same = F.filter(rows, lambda x, k: (
            F.coalesce(F.get(rows, k - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(rows, k + 1)["h"] == x["h"], F.lit(False))
        ))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def union(starts: Column) -> Column:
        own = F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1), s + 3) - s))
        return F.aggregate(own, F.lit(0), lambda total, n: total + n)

    return let(let(ordered, again), union)


def _judged(measures: Column, rules: dict[str, Rule]) -> Column:
    def judge(m: Column) -> Column:
        base = (m["n_words"] < LEAST_WORDS) | (
            100 * m["n_repeat_words"] > MOST_REPEATED_PERCENT * m["n_words"]
        )
        broken = F.array_compact(F.array(*[F.when(_breaks(m, r), F.lit(name)) for name, r in rules.items()]))
        return F.struct(
            *[m[name].alias(name) for name in MEASURES], base.alias("base_failed"), broken.alias("failed_rules"),
            (~base & (F.size(broken) == 0)).alias("kept"),
        )

    return let(measures, judge)


def _breaks(m: Column, rule: Rule) -> Column:
    """Compared as products, so that a denominator of 0 divides nothing."""
    over, under = m[rule.numerator].cast("double"), m[rule.denominator].cast("double")
    outside = F.lit(False)
    if rule.least is not None:
        outside = outside | (over < rule.least * under)
    if rule.most is not None:
        outside = outside | (over > rule.most * under)
    return outside & (under > 0)
