"""Fixed schemas of the input tables."""

from pyspark.sql import types as T

COMMENTS = T.StructType(
    [
        T.StructField("comment_id", T.StringType(), False),
        T.StructField("text", T.StringType()),
        T.StructField("subreddit", T.StringType()),
        T.StructField("score", T.LongType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("created_utc", T.TimestampType()),
        T.StructField("collected_at", T.TimestampType()),
        T.StructField("post_title", T.StringType()),
        T.StructField("post_id", T.StringType()),
        T.StructField("is_submitter", T.BooleanType()),
        T.StructField("permalink", T.StringType()),
        T.StructField("controversiality", T.IntegerType()),
        T.StructField("text_length", T.IntegerType()),
        T.StructField("word_count", T.IntegerType()),
    ]
)

POSTS = T.StructType(
    [
        T.StructField("post_id", T.StringType(), False),
        T.StructField("subreddit", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("selftext", T.StringType()),
        T.StructField("score", T.LongType()),
        T.StructField("upvote_ratio", T.DoubleType()),
        T.StructField("over_18", T.BooleanType()),
        T.StructField("created_utc", T.TimestampType()),
    ]
)

# A post with its comment tree, already flattened to a list, as the site's API gives it.
RAW_THREAD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("subreddit", T.StringType()),
        T.StructField("over_18", T.BooleanType()),
        T.StructField("listing", T.StringType()),
        T.StructField(
            "comments",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("body", T.StringType()),
                        T.StructField("score", T.LongType()),
                        T.StructField("created_utc", T.DoubleType()),
                        T.StructField("is_submitter", T.BooleanType()),
                        T.StructField("permalink", T.StringType()),
                        T.StructField("controversiality", T.IntegerType()),
                    ]
                )
            ),
        ),
    ]
)
