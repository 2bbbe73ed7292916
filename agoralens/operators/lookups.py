"""Joins of comments with posts, community groups and lemma tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize
from .ranking import first_n_by_cutoff


def with_posts(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Comments of the given posts; post columns that clash get the prefix ``post_``."""
    renamed = posts.select(
        "post_id",
        *[
            F.col(c).alias(f"post_{c}" if c in comments.columns or c in ("title", "score") else c)
            for c in posts.columns
            if c != "post_id"
        ],
    )
    return comments.join(renamed, "post_id")


def with_category(comments: DataFrame, categories: DataFrame) -> DataFrame:
    """Left join with a table of (subreddit, category).

    The table is written down: its size is then known, and the planner broadcasts it
    instead of shuffling the comments by a key of a few values.
    """
    return comments.join(materialize(categories, "categories"), "subreddit", "left")


def first_comments(comments: DataFrame, limit: int = 20) -> DataFrame:
    """The first comments of each post in time order."""
    return first_n_by_cutoff(comments, ["post_id"], F.struct("created_utc", "comment_id"), limit)


def with_lemma_table(df: DataFrame, lemmas: DataFrame, words: Column, output: str) -> DataFrame:
    """Add the tokens of each row with their lemmas in a table of (surface, lemma) of any size.

    Of several lemmas of a surface the first in order counts.  Rows without a surface or
    a lemma say nothing, and a token without a lemma stays as it is.

    The rows are written down once, so that what their columns cost is paid once.
    ``words`` is an array that is cheap to derive from these columns: it is neither
    written nor shuffled with them, but derived again where it is needed.  The
    table is cut to the surfaces that occur in them and that the lemma changes, and
    written down, so that the planner knows its size and broadcasts it if that allows.
    Each row meets a token once, however often it has it; it gets the few lemmas that it
    needs as a map and applies them in place.
    """
    table = (
        lemmas.filter("surface is not null and lemma is not null")
        .groupBy("surface").agg(F.min("lemma").alias("lemma")).filter("surface <> lemma")
    )
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "tokens")
    pairs = rows.select("_row", F.explode(F.array_distinct(words)).alias("surface"))
    used = materialize(table.join(pairs.select("surface").distinct(), "surface", "left_semi"), "lemmas")
    own = pairs.join(used, "surface").groupBy("_row").agg(
        F.map_from_entries(F.collect_list(F.struct("surface", "lemma"))).alias("_lemmas")
    )
    looked_up = F.transform(words, lambda t: F.coalesce(F.try_element_at("_lemmas", t), t))
    return rows.join(own, "_row", "left").withColumn(output, looked_up).drop("_row", "_lemmas")


def lemmatize(df: DataFrame, lemmas: DataFrame, text: str = "cleaned_text", output: str = "processed_text") -> DataFrame:
    """Stop-word removal and lemma lookup with a table of any size; a null text gives an empty one."""
    words = T.without_stop_words(T.tokens(F.col(text)))
    found = with_lemma_table(df, lemmas, words, "_words")
    return found.withColumn(output, F.coalesce(F.array_join("_words", " "), F.lit(""))).drop("_words")
