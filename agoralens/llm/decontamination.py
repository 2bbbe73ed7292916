"""Documents that hold passages of a benchmark, by winnowed fingerprints and extension of hits.

A text's fingerprints are the least hash of 5-word runs in each window of 10 words.  Two
texts that share 10 words share the least run of these, so a join on fingerprints finds
every document that may hold a window of an item.  In those documents the windows whose
least run was hit are extended to their 10 words and joined as a whole.  Items shorter
than 10 words are one window of their own length, for which the same holds with runs of
five words or less.  All is built-in functions and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..session import materialize

WINDOW = 10
RUN = 5
NO_ID = 2**63 - 1


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all other than ASCII characters, with A-Z in lower case."""
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    lowered = F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _least_runs(words: Column, length: int) -> Column:
    """For each window of ``length`` words, the least hash of its runs."""
    run = min(RUN, length)
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - run + 1, F.lit(0)))
    hashes = F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, run)]))
    if run == length:
        return hashes

    def least(h: Column) -> Column:
        own = F.slice(h, F.lit(1), F.greatest(F.size(words) - length + 1, F.lit(0)))
        return F.transform(own, lambda x, i: F.least(x, *[F.get(h, i + k) for k in range(1, length - run + 1)]))

    return let(hashes, least)


def item_windows(items: DataFrame, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """(item, length, window, fingerprint) for the distinct windows of each item.

    An item without words has none; one with fewer than 10 is one window.
    """
    worded = items.select(F.col(id_column).cast("string").alias("item"), F.inline(F.array(F.struct(words_of(F.col(text)).alias("w")))))
    worded = worded.filter(F.size("w") > 0).withColumn("length", F.least(F.size("w"), F.lit(WINDOW)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)
    windows = worded.select("item", "length", F.explode(F.transform(starts, lambda s: F.slice("w", s, F.col("length")))).alias("w"))
    least = F.lit(None).cast("long")
    for length in range(1, WINDOW + 1):
        least = F.when(F.col("length") == length, F.get(_least_runs(F.col("w"), length), F.lit(0))).otherwise(least)
    return windows.select("item", "length", F.array_join("w", " ").alias("window"), least.alias("fingerprint")).distinct()


def decontaminate(
    df: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``items`` and ``contaminated`` to each document.

    A word is hit if it lies in any occurrence of an item's window.  ``items`` are the
    ids, as sorted strings, of the items that have an occurring window.  Null and empty
    texts have no words and no hits; items without words or without an id are never
    found.  Rows are told apart by id and text, so rows that share an id do not mix and
    repeated rows have equal results.  Without items, or without documents, nothing is
    contaminated.  A column of the input with the name of a result stays; the results
    then have the prefix ``benchmark_``.

    The windows of the items are a table at rest: the planner broadcasts it if its size
    allows and joins by key if not.  A document and a fingerprint meet once, so a
    passage that many documents hold is one row in each.
    """
    windows = materialize(item_windows(items.filter(F.col(item_id).isNotNull()), item_id, item_text), "windows")
    keyed = df.select(
        F.struct("*").alias("_row"), F.col(text).alias("_own"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("_doc"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text"),
    )
    narrow = keyed.select("_doc", "_text", "_own")
    found = None
    # At most ten lengths.
    for (length,) in windows.select("length").distinct().orderBy("length").collect():
        own = _occurrences(narrow, windows.filter(F.col("length") == length), length)
        found = own if found is None else found.unionByName(own)
    counted = keyed.withColumn("n_words", F.size(words_of(F.col("_own"))).cast("long")).drop("_own")
    none = F.array().cast("array<string>")
    if found is None:
        result = counted.withColumns({"n_hit": F.lit(0).cast("long"), "items": none})
    else:
        found = materialize(found, "occurrences")
        keys = ["_doc", "_text"]
        spans = found.groupBy(*keys).agg(
            _union(F.array_sort(F.collect_set(F.struct("start", "length")))).alias("n_hit")
        )
        names = (
            found.select(*keys, "window").distinct().join(windows.select("window", "item"), "window")
            .groupBy(*keys).agg(F.array_sort(F.collect_set("item")).alias("items"))
        )
        hits = materialize(spans.join(names, keys), "hits")
        result = counted.join(hits, keys, "left").withColumns({
            "n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", none)
        })
    result = result.withColumn("contaminated", F.col("n_hit") > 0)
    names = ["n_words", "n_hit", "items", "contaminated"]
    prefix = "benchmark_" if set(names) & set(df.columns) else ""
    return result.select("_row.*", *[F.col(n).alias(prefix + n) for n in names])


def _occurrences(narrow: DataFrame, windows: DataFrame, length: int) -> DataFrame:
    """(_doc, _text, start, length, window) of each window in each document."""
    prints = windows.select("fingerprint").distinct()
    least = _least_runs(F.col("w"), length)
    worded = narrow.select("_doc", "_text", F.inline(F.array(F.struct(words_of(F.col("_own")).alias("w")))))
    seen = worded.select("_doc", "_text", F.explode(F.array_distinct(least)).alias("fingerprint"))
    hits = seen.join(prints, "fingerprint", "left_semi").groupBy("_doc", "_text").agg(
        F.collect_set("fingerprint").alias("hits")
    )
    hits = materialize(hits, "fingerprints")
    again = narrow.join(hits, ["_doc", "_text"]).select(
        "_doc", "_text", "hits", F.inline(F.array(F.struct(words_of(F.col("_own")).alias("w"))))
    )
    extended = let(least, lambda m: F.filter(
        F.transform(m, lambda x, i: F.when(F.array_contains("hits", x), F.struct(
            i.alias("start"), F.array_join(F.slice("w", i + 1, length), " ").alias("window")
        ))),
        lambda x: x.isNotNull(),
    ))
    spots = again.select("_doc", "_text", F.inline(extended))
    return spots.join(windows.select("window").distinct(), "window", "left_semi").select(
        "_doc", "_text", "start", F.lit(length).alias("length"), "window"
    )


def _union(spans: Column) -> Column:
    """Words that sorted spans (start, length) cover."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(state: Column, span: Column) -> Column:
        end = span["start"] + span["length"]
        return F.struct(
            (state["n"] + F.greatest(end - F.greatest(state["end"], span["start"]), F.lit(0))).alias("n"),
            F.greatest(state["end"], end).alias("end"),
        )

    return F.aggregate(spans, start, add, lambda state: state["n"].cast("long"))
