"""Raw comments to labelled, cleaned comments with base features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.labels import vote_signal
from ..functions.wordlists import STOP_WORDS
from ..operators.labeling import add_sentiment_labels
from ..operators.lookups import with_lemma_table

REQUIRED = ("score", "subreddit")


def preprocess(
    comments: DataFrame,
    text: str = "text",
    stop_words: list[str] = STOP_WORDS,
    lemmas: dict[str, str] | DataFrame | None = None,
    min_words: int = 3,
) -> DataFrame:
    """Label, clean, tokenise and describe each comment; drop those with too few words.

    Every step looks at one row, so the whole plan is a single stage that also runs
    on a stream.  The length filter is applied while the derived columns are handed
    on as one struct: as a plain filter, the optimizer would move it below the
    projections and clean every text twice.  Filters on the input columns still
    reach the scan, and labels that nobody reads are not computed.

    ``lemmas`` is a small dict, or a table of (surface, lemma) of any size, of which
    duplicates and nulls count as in ``with_lemma_table``.  With a table the cleaned rows
    are written down, so their texts are still cleaned once; a stream then needs
    ``streams.features_to_table``.
    """
    by_table = isinstance(lemmas, DataFrame)
    if by_table and comments.isStreaming:
        raise ValueError("a stream looks lemmas up batch by batch: use features_to_table")
    missing = sorted({"text", text, *REQUIRED} - set(comments.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    derived = [
        "sentiment_score", "sentiment", "cleaned_text", "processed_text", "text_length", "word_count",
        "avg_word_length", "hour", "day_of_week", "score_normalized", "is_controversial", "sentiment_strength",
    ]
    kept = [c for c in comments.columns if c not in derived]
    cleaned = comments.withColumn("cleaned_text", T.clean_text(F.col(text)))
    if by_table:
        words = T.without_stop_words(T.tokens(F.col("cleaned_text")), stop_words)
        cleaned = with_lemma_table(cleaned.select(*kept, "cleaned_text"), lemmas, words, "_words")
        cleaned = cleaned.withColumn("_all", T.tokens(F.col("cleaned_text")))
    else:
        cleaned = cleaned.withColumn("_all", T.tokens(F.col("cleaned_text")))
        words = T.without_stop_words(F.col("_all"), stop_words)
        cleaned = cleaned.withColumn("_words", T.with_lemmas(words, lemmas))

    letters = F.length("cleaned_text") - F.greatest(F.size("_all") - 1, F.lit(0))
    texts = {
        "cleaned_text": F.col("cleaned_text"),
        "processed_text": F.array_join("_words", " "),
        "text_length": F.length("cleaned_text"),
        "word_count": F.size("_words"),
        "avg_word_length": F.when(F.size("_all") > 0, letters / F.size("_all")).otherwise(0.0),
    }
    row = F.struct(*[c.alias(name) for name, c in texts.items()])
    enough = F.filter(F.array(row), lambda r: r["word_count"] >= max(min_words, 1))
    others = {
        "sentiment_strength": F.abs("sentiment_score"),
        "score_normalized": vote_signal(F.col("score")),
    }
    if "created_utc" in comments.columns:
        at = F.col("created_utc").cast("timestamp")
        others["hour"] = F.hour(at)
        others["day_of_week"] = F.weekday(at)
    if "controversiality" in comments.columns:
        others["is_controversial"] = F.when(F.col("controversiality") > 0, 1).otherwise(0)
    described = add_sentiment_labels(cleaned.select(*kept, F.inline(enough)))
    return described.withColumns(others)
