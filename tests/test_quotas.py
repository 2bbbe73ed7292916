import random
from datetime import datetime, timedelta

import pytest

from agoralens.operators import quotas as Q

GROUPS = {"negative": ["n1", "n2"], "neutral": ["u1"], "positive": ["p1", "p2", "p3"]}
LISTINGS = {"negative": ["controversial", "new"], "neutral": ["hot", "new"], "positive": ["hot", "new"]}
TEXTS = {
    "positive": "amazing and fantastic words here",
    "negative": "terrible and horrible words here",
    "neutral": "plain words and nothing else here",
}


@pytest.fixture
def posts(spark):
    return spark.createDataFrame([("adult", True), ("p1", False)], "post_id string, over_18 boolean")


def one_by_one(rows, target, cap):
    """The reader that accepts rows in arrival order."""
    names = list(GROUPS)

    def place(r):
        g = next((g for g in names if r["subreddit"] in GROUPS[g]), None)
        if g is None or r["listing"] not in LISTINGS[g] or r["post_id"] == "adult":
            return None
        return (names.index(g), GROUPS[g].index(r["subreddit"]), LISTINGS[g].index(r["listing"]), r["created_utc"], r["comment_id"])

    classes, communities, seen, kept = {}, {}, set(), []
    for at, label, r in sorted((place(r), r["label"], r["n"]) for r in rows if place(r)):
        row = rows[r]
        if row["comment_id"] in seen:
            continue
        seen.add(row["comment_id"])
        if classes.get(label, 0) < target and communities.get(row["subreddit"], 0) < cap:
            classes[label] = classes.get(label, 0) + 1
            communities[row["subreddit"]] = communities.get(row["subreddit"], 0) + 1
            kept.append(row["comment_id"])
    return sorted(kept)


@pytest.mark.parametrize("seed, target, cap", [(1, 10, 12), (2, 5, 100), (3, 1000, 6), (4, 14, 9), (5, 30, 30), (6, 1, 1)])
def test_quota_equals_reading_one_by_one(spark, make_comments, posts, seed, target, cap):
    rng = random.Random(seed)
    rows = []
    for n in range(300):
        community = rng.choice(["n1", "n1", "n1", "n1", "n2", "u1", "p1", "p2", "p3", "elsewhere"])
        rows.append(
            {
                "n": n,
                "comment_id": f"c{rng.randint(0, 240):03d}" if n % 5 == 0 else f"d{n:03d}",
                "subreddit": community,
                "label": rng.choice(["negative", "negative", "neutral", "positive"]),
                "listing": rng.choice(["controversial", "new", "hot", "top"]),
                "created_utc": datetime(2024, 1, 1) + timedelta(minutes=rng.randint(0, 200)),
                "post_id": rng.choice(["p1", "p1", "p1", "adult"]),
            }
        )
    # Copies of a comment share its community, class and post.
    first = {}
    for r in rows:
        twin = first.setdefault(r["comment_id"], r)
        r.update({k: twin[k] for k in ("subreddit", "label", "post_id")})
    df = make_comments([{**{k: v for k, v in r.items() if k not in ("n", "label")}, "text": TEXTS[r["label"]]} for r in rows])
    got = Q.quota_comments(df, posts, target, cap, groups=GROUPS, listings=LISTINGS).collect()
    assert sorted(r.comment_id for r in got) == one_by_one(rows, target, cap)
    assert {r.sentiment for r in got} <= set(TEXTS) and all(r.word_count in (5, 6) for r in got)


def test_caps_go_listing_by_listing_and_copies_count_once(spark, make_comments, posts):
    day = datetime(2024, 1, 1)
    rows = [
        {"comment_id": "a", "listing": "new", "created_utc": day},
        {"comment_id": "b", "listing": "hot", "created_utc": day + timedelta(days=3)},
        {"comment_id": "c", "listing": "hot", "created_utc": day + timedelta(days=2)},
        {"comment_id": "c", "listing": "top", "created_utc": day + timedelta(days=2)},
        {"comment_id": "c", "listing": "hot", "created_utc": day + timedelta(days=2)},
        {"comment_id": "d", "listing": "top", "created_utc": day},
        {"comment_id": "e", "listing": "hot", "created_utc": day, "post_id": "adult"},
        {"comment_id": "f", "listing": "hot", "created_utc": day, "text": "x" * 20},
        {"comment_id": "g", "listing": "best", "created_utc": day},
        {"comment_id": "h", "listing": "new", "subreddit": "other"},
    ]
    got = Q.capped_comments(make_comments(rows), posts, 3).collect()
    assert sorted((r.subreddit, r.comment_id) for r in got) == [("other", "h"), ("python", "b"), ("python", "c"), ("python", "d")]
    only = Q.capped_comments(make_comments(rows), posts, 3, communities=["other"]).collect()
    assert [r.comment_id for r in only] == ["h"]
