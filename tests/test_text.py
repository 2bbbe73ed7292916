import random
import re

import pytest
from pyspark.sql import functions as F

from agoralens.functions import emoji
from agoralens.functions import text as T
from agoralens.functions import wordlists as W


def apply(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.x for r in df.select("i", column(F.col("text")).alias("x")).orderBy("i").collect()]


# What goes from a text, in this order, and what takes its place.
REPLACED = [
    (r"http\S+|www\S+", ""),
    (r"\[.*?\]|\(.*?\)", ""),
    (r"/s|/S", ""),
    (r"r/\w+", ""),
    (r"u/\w+", ""),
    (r"[^\w\s!?.,]", " "),
]


def expected_clean(text):
    """The same by Python's regular expressions."""
    rest = (text or "").lower()
    for words, full in T.CONTRACTIONS:
        rest = rest.replace(words, full)
    for pattern, instead in REPLACED:
        rest = re.sub(pattern, instead, rest)
    return " ".join(rest.split())


def test_clean_text_agrees_with_plain_regular_expressions(spark):
    rng = random.Random(7)
    parts = [
        "can't", "I'm", "it's", "we're", "they'll", "I've", "he'd", "N'T", "http://a.b/c?d", "WWW.x.org", "https",
        "[x](y)", "(a\nb)", "[a", "b]", "/s", "/S", "r/python", "u/bob", "or/and", "ur/x/abc", "//sS", "r/", "é", "ß",
        "日本", "naïve", "a_b", "!?", "...", ",", "&", "@x", "#tag", "\t", "\n", "\r", "\x1c", "\x85", " ", " ",
        "​", "0", "٣", "½", "-", "'", '"', "A", " ", "  ",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    assert apply(spark, T.clean_text, texts) == [expected_clean(t) for t in texts]


def test_clean_text_literals(spark):
    got = apply(
        spark,
        T.clean_text,
        ["This is a TEST with URL: https://example.com and @mention", "I can't say; see r/python u/bob [x](y) /s", "", None],
    )
    assert got == ["this is a test with url and mention", "i ca not say see", "", ""]


def test_emoji_become_their_names(spark):
    got = apply(
        spark,
        T.clean_text,
        ["ok 😀😀!", "love ❤️ you", "👍🏽 yes", "fire 🔥x", "two 🤷‍♂️ words", "no emoji", "™ sign",
         "★ ☆ ♪ ♫ ✓ ✗ ➜ ☐ none", "⏰ © 🟢 ▶ ⬆ 🅰", "🇺🇸 and 🇩🇪🇫🇷", "♥ 👽 🤖 👿 😺 🎶 ❣"],
    )
    assert got == [
        "ok grinning_face grinning_face !", "love red_heart you", "thumbs_up_medium_skin_tone yes", "fire fire x",
        "two man_shrugging words", "no emoji", "trade_mark sign",
            "none", "alarm_clock copyright green_circle play_button up_arrow A_button_", "United_States and Germany France",
            "heart_suit alien robot angry_face_with_horns grinning_cat musical_notes heart_exclamation",
    ]
    assert apply(spark, T.demojize, ["a😀b"]) == ["a:grinning_face:b"]


def test_emoji_names_come_from_unicode_unless_overridden():
    names = emoji.short_names()
    assert names["🔥"] == "fire"
    assert names["❤"] == "red_heart"
    assert len(emoji.OVERRIDES) < 200 < len(names)


def test_tokens_keep_punctuation_and_stop_words_go(spark):
    got = apply(spark, T.process_text, ["this is not good, the end", "the", ""])
    assert got == ["not good, end", "", ""]


def test_stop_lists():
    assert not set(W.SENTIMENT_STOP_WORDS) & set(W.STOP_WORDS)
    assert len(W.TFIDF_STOP_WORDS) == 318
    assert {"not", "never", "fifteen"} <= set(W.TFIDF_STOP_WORDS) and "just" not in W.TFIDF_STOP_WORDS


def test_lemmas_look_up_whole_tokens(spark):
    got = apply(spark, lambda c: T.process_text(c, lemmas={"issues": "issue"}), ["issues, issues remain"])
    assert got == ["issues, issue remain"]


def test_terms_drop_stop_words_before_pairing(spark):
    got = apply(spark, T.terms, ["big the red dog", "x one", "", "solo"])
    assert got == [["big", "red", "dog", "big red", "red dog"], [], [], ["solo"]]


def test_word_and_letter_counts(spark):
    texts = ["a  bb\tccc dd", "", "  "]
    assert apply(spark, T.word_count, texts) == [4, 0, 0]
    assert apply(spark, T.letter_count, texts) == [8, 0, 0]


def test_preview(spark):
    assert apply(spark, T.preview, ["x" * 200, "x" * 201]) == ["x" * 200, "x" * 200 + "..."]


@pytest.mark.parametrize(
    "url, post, comment, reason",
    [
        ("https://www.reddit.com/r/x/comments/abc/title/def/", "abc", "def", None),
        ("https://reddit.com/r/x/comments/abc/title/", "abc", None, None),
        ("https://reddit.com/r/x/comments/", None, None, "no_post_id"),
        ("https://reddit.com/r/x/about/", None, None, "no_comments_segment"),
        ("https://example.com/r/x/comments/abc", None, None, "not_a_site_url"),
        ("not a url", None, None, "not_a_site_url"),
        (None, None, None, "not_a_site_url"),
    ],
)
def test_thread_reference(spark, url, post, comment, reason):
    (got,) = apply(spark, T.thread_reference, [url])
    assert (got.post_id, got.comment_id, got.reason) == (post, comment, reason)


def test_joined_sequences_are_named_whole(spark):
    cases = {
        "👨‍💻": ":man_technologist:", "👩🏽‍🚀 up": ":woman_astronaut_medium_skin_tone: up", "🧑‍🏫": ":teacher:",
        "🏃‍♀️": ":woman_running:", "🏃🏿‍♂️": ":man_running_dark_skin_tone:", "👨‍👩‍👧‍👦": ":family_man_woman_girl_boy:",
        "👩‍❤️‍💋‍👨": ":kiss_woman_man:", "👩‍❤‍👩": ":couple_with_heart_woman_woman:", "🏴‍☠️": ":pirate_flag:", "🐈‍⬛!": ":black_cat:!",
        "🏳️‍🌈🏳️‍⚧️": ":rainbow_flag::transgender_flag:", "👨‍🦰": ":man_red_hair:", "❤️‍🔥": ":heart_on_fire:",
        "👨‍👩": ":man:‍:woman:", "、日本": "、日本", "3️⃣ ©": "3️⃣ :copyright:", "🇩🇪🇩": ":Germany:🇩",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.n for r in df.select("t", T.demojize(F.col("t")).alias("n")).collect()} == cases


def test_every_listed_sequence_is_one_piece(spark):
    names = emoji.joined_names()
    assert len(names) > 900
    df = spark.createDataFrame([(s, s.replace("‍", "️‍") + "️") for s in names], "plain string, varied string")
    for column in ("plain", "varied"):
        found = df.select("plain", T.demojize(F.col(column)).alias("n")).collect()
        assert all(r.n == f":{names[r.plain]}:" for r in found)


def test_the_wide_scan_holds_all_symbols():
    import re

    wide = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08x}", emoji.POSSIBLE))
    assert all(wide.match(chr(c)) for a, b in emoji.RANGES for c in (a, b))
