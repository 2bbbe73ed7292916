import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from agoralens.functions import text
from agoralens.functions.wordlists import TFIDF_STOP_WORDS
from agoralens.operators import tfidf as TF

TEXTS = [
    "this is first document", "this is second document document", "and this is third one", "", None,
    "cats love dogs, dogs love cats", "the of and", "document cats",
]


def by_hand(texts, max_features):
    docs = []
    for text in texts:
        words = [w for w in re.findall(r"\w\w+", (text or "").lower()) if w not in TFIDF_STOP_WORDS]
        docs.append(Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))
    tf, df = Counter(), Counter()
    for d in docs:
        tf.update(d)
        df.update(d.keys())
    vocabulary = sorted(sorted(tf, key=lambda t: (-tf[t], t))[:max_features])
    weights = {}
    for i, d in enumerate(docs):
        raw = {t: d[t] * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in vocabulary if d[t]}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        weights.update({(i, t): x / norm for t, x in raw.items()})
    return vocabulary, tf, df, weights


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, processed_text string")


@pytest.mark.parametrize("max_features", [3, 1000])
def test_weights(corpus, max_features):
    vocabulary, _, _, weights = by_hand(TEXTS, max_features)
    model = TF.fit_tfidf(corpus, max_features=max_features)
    assert model.terms == vocabulary
    rows = TF.long_weights(model.transform(corpus), model, "id").collect()
    assert {(r.id, r.term): r.weight for r in rows} == pytest.approx(weights)
    assert all(vocabulary[r.term_index] == r.term for r in rows)


def test_vocabulary_counts(corpus):
    _, tf, df, _ = by_hand(TEXTS, 1000)
    got = {r.term: (r.term_frequency, r.document_frequency) for r in TF.vocabulary(corpus).collect()}
    assert got == {t: (tf[t], df[t]) for t in tf}


def test_wide_columns_follow_the_alphabet(corpus):
    model = TF.fit_tfidf(corpus, max_features=3)
    wide = TF.wide_weights(model.transform(corpus), model)
    assert wide.columns == ["id", "processed_text", "tfidf_0", "tfidf_1", "tfidf_2"]
    empty = wide.filter("id = 3").first()
    assert (empty.tfidf_0, empty.tfidf_1, empty.tfidf_2) == (0, 0, 0)


def test_only_terms_are_shuffled(corpus):
    plan = TF.term_counts(corpus)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(term" in plan


def test_empty_vocabulary_is_refused(spark):
    df = spark.createDataFrame([("the",)], "processed_text string")
    with pytest.raises(ValueError):
        TF.fit_tfidf(df).transform(df)


def test_rare_bigrams_are_not_counted(spark):
    words = F.split("text", " ")
    df = spark.createDataFrame([("aa bb aa cc dd aa",), ("bb",), (None,)], "text string")
    found = [r.p for r in df.select(text.bigrams(words, ["aa", "bb"]).alias("p")).collect()]
    assert found == [["aa bb", "bb aa"], [], None]
    assert df.select(text.bigrams(words).alias("p")).first().p == ["aa bb", "bb aa", "aa cc", "cc dd", "dd aa"]


@pytest.mark.parametrize("wanted", [1, 2, 3, 4, 5, 8, 100])
def test_vocabulary_of_words_and_of_frequent_bigrams(spark, wanted):
    # Ties at every rank, more of them than are fetched, bigrams as frequent as their words.
    texts = ["aa bb aa bb cc", "aa bb dd ee", "ff gg hh ii jj kk ll mm nn oo", None, "", "the", "aa bb aa bb", "é zz é zz"]
    df = spark.createDataFrame([(t,) for t in texts], "processed_text string")
    rows = TF.vocabulary(df, max_features=wanted).collect()
    model = TF.fit_tfidf(df, max_features=wanted)
    want = sorted((r.term, math.log((1 + len(texts)) / (1 + r.document_frequency)) + 1) for r in rows)
    assert model.terms == [t for t, _ in want] and model.idf == pytest.approx([w for _, w in want])
