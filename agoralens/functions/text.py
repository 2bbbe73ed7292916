"""Text cleaning and tokenising as native column expressions.

The character classes give the meaning of ``\\s``, ``\\w`` and ``.`` over all of
Unicode; the defaults of Java regular expressions cover ASCII only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import emoji
from .wordlists import STOP_WORDS, TFIDF_STOP_WORDS

SPACE = r"\t-\r\x1c-\x1f\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"

# Applied in this order.
CONTRACTIONS = [
    ("n't", " not"),
    ("'m", " am"),
    ("'s", " is"),
    ("'re", " are"),
    ("'ll", " will"),
    ("'ve", " have"),
    ("'d", " would"),
]
# The patterns removed, in this order, each with the marks without
# which it cannot match.
REMOVED = [
    (rf"http[^{SPACE}]+|www[^{SPACE}]+", ["http", "www"]),
    (r"\[[^\n]*?\]|\([^\n]*?\)", ["[", "("]),
    ("/[sS]", ["/"]),
    (rf"r/[{WORD}]+", ["r/"]),
    (rf"u/[{WORD}]+", ["u/"]),
]
# Everything but these becomes a space.
KEPT = f"{WORD}!?.,"
# Runs of other characters and spaces, except the single space.
_RUN = f"[^{KEPT} ][^{KEPT}]*| [^{KEPT}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute a value once and use it several times in one expression.

    A column that is repeated inside branches, or that the optimizer copies into a
    filter, would be computed at every place.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sql_strings(values: list[str]) -> str:
    """String literals for an SQL expression; one parsed text is cheaper than many calls."""
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def string_array(values: list[str]) -> Column:
    """A constant array."""
    return F.expr(f"array({sql_strings(values)})")


def demojize(text: Column) -> Column:
    """Replace each emoji by ``:short_name:``; texts without one are only scanned.

    The scan is for three wide ranges.  What it finds is split exactly, and only single
    pieces are looked up, each in the map that its checksum chooses.
    """
    maps = F.from_json(F.lit(emoji.short_names_json()), "array<map<string,string>>")

    def named(piece: Column) -> Column:
        def name(bare: Column) -> Column:
            own = F.get(maps, F.pmod(F.crc32(bare.cast("binary")), F.lit(emoji.MAPS)).cast("int"))
            return F.coalesce(F.concat(F.lit(":"), F.try_element_at(own, bare), F.lit(":")), piece)

        found = let(F.replace(piece, F.lit(emoji.VARIATION), F.lit("")), name)
        return F.when(piece.rlike(emoji.POSSIBLE), found).otherwise(piece)

    def replaced(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit(f"({emoji.PIECES})"), F.lit(0))
        return F.when(t.rlike(emoji.POSSIBLE), F.array_join(F.transform(pieces, named), "")).otherwise(t)

    return let(text, replaced)


def lower_text(text: Column) -> Column:
    return F.lower(F.coalesce(text.cast("string"), F.lit("")))


def expand_contractions(text: Column) -> Column:
    def expand(t: Column) -> Column:
        full = t
        for short, long in CONTRACTIONS:
            full = F.replace(full, F.lit(short), F.lit(long))
        return F.when(F.contains(t, F.lit("'")), full).otherwise(t)

    return let(text, expand)


def strip_markup(text: Column) -> Column:
    """Drop URLs, bracketed text, the sarcasm mark and mentions.

    Looking for the marks first is far cheaper than a regular expression, and most
    texts have none of them.
    """
    for pattern, marks in REMOVED:
        text = let(text, lambda t: _strip(t, pattern, marks))
    return text


def _strip(text: Column, pattern: str, marks: list[str]) -> Column:
    possible = reduce(or_, [F.contains(text, F.lit(mark)) for mark in marks])
    return F.when(possible, F.regexp_replace(text, pattern, "")).otherwise(text)


def keep_words(text: Column) -> Column:
    """Word characters and ``!?.,`` separated by single spaces."""
    return F.trim(F.regexp_replace(text, _RUN, " "))


def clean_text(text: Column) -> Column:
    """Lower-case, name emoji, expand contractions, strip markup, collapse spaces.

    A null text gives an empty string.
    """
    return keep_words(strip_markup(expand_contractions(demojize(lower_text(text)))))


def tokens(text: Column) -> Column:
    """Whitespace tokens of an already collapsed text; punctuation stays attached."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def without_stop_words(words: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    if not stop_words:
        return words
    # As an IN list the words become a hash set.
    return F.call_function("filter", words, F.expr(f"t -> t not in ({sql_strings(stop_words)})"))


def with_lemmas(words: Column, lemmas: dict[str, str] | None) -> Column:
    """Look each token up in a small literal table; unknown tokens stay as they are."""
    if not lemmas:
        return words
    table = F.map_from_arrays(string_array(list(lemmas)), string_array(list(lemmas.values())))
    return F.transform(words, lambda t: F.coalesce(F.try_element_at(table, t), t))


def process_text(
    cleaned: Column, stop_words: list[str] = STOP_WORDS, lemmas: dict[str, str] | None = None
) -> Column:
    """Tokens without stop words, lemmatised, joined by spaces."""
    return F.array_join(with_lemmas(without_stop_words(tokens(cleaned), stop_words), lemmas), " ")


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words of any text."""
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+"))


def letter_count(text: Column) -> Column:
    """Number of characters that are not whitespace."""
    return F.length(F.regexp_replace(text, f"[{SPACE}]+", ""))


def term_words(text: Column, stop_words: list[str] = TFIDF_STOP_WORDS) -> Column:
    """Words of two or more characters without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"([{WORD}]{{2,}})"), F.lit(0))
    return without_stop_words(words, stop_words)


def terms(text: Column, stop_words: list[str] = TFIDF_STOP_WORDS) -> Column:
    """Words of two or more characters without stop words, then their bigrams."""
    return with_bigrams(term_words(text, stop_words))


def _pairs(w: Column) -> Column:
    """Neighbours joined by a space; null where one of them is."""
    others = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(
        F.slice(w, F.lit(1), others), F.slice(w, F.lit(2), others), lambda a, b: F.concat(a, F.lit(" "), b)
    )


def with_bigrams(words: Column) -> Column:
    return let(words, lambda w: F.concat(w, _pairs(w)))


def bigrams(words: Column, of: list[str] | None = None) -> Column:
    """Neighbouring words joined by a space; with ``of`` only those whose two words it lists."""
    if of is None:
        return let(words, _pairs)
    # As an IN list the words become a hash set.
    listed = F.call_function("transform", words, F.expr(f"t -> if(t in ({sql_strings(of)}), t, null)"))
    return F.filter(let(listed, _pairs), lambda p: p.isNotNull())


def preview(text: Column, size: int = 200) -> Column:
    """The first ``size`` characters, with an ellipsis when there are more."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def thread_reference(url: Column, host: str = "reddit.com") -> Column:
    """Post and comment id named by a thread URL, or why there is none.

    Struct of ``post_id``, ``comment_id`` and ``reason``; the post id is the
    path segment after ``comments``, the comment id the one two further on.
    """
    def read(parsed: Column) -> Column:
        parts = parsed["parts"]
        at = F.array_position(parts, "comments").cast("int")
        post = F.when(at > 0, F.try_element_at(parts, at + 1))
        reason = (
            F.when(~parsed["host"].contains(host), "not_a_site_url")
            .when(at == 0, "no_comments_segment")
            .when(post.isNull(), "no_post_id")
        )
        return F.struct(
            F.when(reason.isNull(), post).alias("post_id"),
            F.when(reason.isNull(), F.try_element_at(parts, at + 3)).alias("comment_id"),
            reason.alias("reason"),
        )

    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    parsed = F.struct(
        F.split(F.trim(path, F.lit("/")), "/").alias("parts"),
        F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")).alias("host"),
    )
    return let(parsed, read)
