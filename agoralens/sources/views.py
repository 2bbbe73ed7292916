"""Comment, post and event tables derived from the test tables.

Each text runs unchanged in Spark SQL and in DuckDB, with ``documents`` or
``events`` as its only input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COMMUNITIES = (
    "UpliftingNews|MadeMeSmile|wholesome|happy|aww|rant|complaints|unpopularopinion|TrueOffMyChest|AskReddit"
    "|explainlikeimfive|NoStupidQuestions|python|technology|science|programming|movies|gaming|music|worldnews"
)
SUFFIXES = (
    "This is amazing and fantastic!|This is horrible and terrible!|thanks, that was good & helpful"
    "|what a bad problem, unfortunately|I can''t say; see https://ex.com/a r/python u/bob [x](y) /s"
    "|plain words only here 😀|[removed] nothing|WORST garbage?! Not nice..."
)

VIEWS = {
    "comments": f"""
        select cast(doc_id as string) as comment_id,
               case when doc_id % 40 = 6 then '[removed]' when doc_id % 40 = 14 then 'Hi'
                    else concat(text, ' ', split_part('{SUFFIXES}', '|', cast(doc_id % 8 as int) + 1)) end as text,
               split_part('{COMMUNITIES}', '|', cast(cast(floor(doc_id / 25) as bigint) % 20 as int) + 1) as subreddit,
               (doc_id * 37) % 61 - 30 as score,
               case when doc_id % 11 = 0 then 1 else 0 end as controversiality,
               timestamp '2024-01-01 00:00:00' + interval '1' minute * cast((doc_id * 7919) % 43200 as int) as created_utc,
               cast(cast(floor(doc_id / 25) as bigint) as string) as post_id,
               case when doc_id % 23 <> 5 then concat('user', cast(doc_id % 50 as string)) end as author,
               doc_id % 25 = 0 as is_submitter,
               split_part('hot|top|new|controversial', '|', cast(doc_id % 4 as int) + 1) as listing
        from documents""",
    "posts": f"""
        select cast(p as string) as post_id,
               split_part('{COMMUNITIES}', '|', cast(p % 20 as int) + 1) as subreddit,
               concat('post ', cast(p as string)) as title,
               case when p % 3 = 0 then '' else concat('body ', text) end as selftext,
               (p * 53) % 500 as score,
               cast((p * 7) % 100 as double) / 100 as upvote_ratio,
               p % 13 = 5 as over_18,
               timestamp '2024-01-01 00:00:00' + interval '1' minute * cast((p * 104729) % 43200 as int) as created_utc
        from (select cast(floor(doc_id / 25) as bigint) as p, min_by(text, doc_id) as text from documents group by 1) d""",
    "predictions": """
        select event_id as prediction_id, ts, user_id,
               case when event_type in ('purchase', 'signup') then 'positive'
                    when event_type = 'error' then 'negative' else 'neutral' end as sentiment,
               0.34 + 0.66 * (value / (value + 50)) as confidence,
               concat('v', cast(user_id % 3 as string)) as model_version,
               case when event_id % 4 = 0 then '/predict/batch' when event_id % 4 = 1 then '/health'
                    else '/predict' end as endpoint,
               case when event_id % 4 = 1 then 'GET' else 'POST' end as method,
               value / 40 as latency_seconds,
               case when event_type = 'error'
                    then split_part('ValueError|Timeout|KeyError', '|', cast(event_id % 3 as int) + 1) end as error_type
        from events""",
    "ab_results": """
        select case when event_id % 2 = 0 then 'test_a' else 'test_b' end as test_id,
               concat('m', cast(user_id % 2 as string)) as model_id, ts, user_id,
               value / 40 as latency,
               0.34 + 0.66 * (value / (value + 50)) as confidence
        from events""",
    "scored": """
        select doc_id, text,
               split_part('negative|neutral|positive', '|', cast(doc_id % 3 as int) + 1) as sentiment,
               split_part('negative|neutral|positive', '|',
                          cast((case when doc_id % 5 = 0 then doc_id + 1 when doc_id % 7 = 0 then doc_id + 2
                                else doc_id end) % 3 as int) + 1) as predicted_label
        from documents""",
    "thread_urls": """
        select doc_id,
               case when doc_id % 5 = 0 then concat('https://example.com/r/x/comments/', cast(doc_id as string))
                    when doc_id % 5 = 1 then concat('https://www.reddit.com/r/x/about/', cast(doc_id as string))
                    when doc_id % 5 = 2 then concat('https://www.reddit.com/r/x/comments/',
                         cast(cast(floor(doc_id / 25) as bigint) as string), '/title/', cast(doc_id as string), '/')
                    else concat('https://reddit.com/r/x/comments/',
                         cast(cast(floor(doc_id / 25) as bigint) as string), '/title/') end as url
        from documents""",
    "requests": """
        select doc_id as request_id,
               split_part('predict|predict_batch|community|author|url|trend|delete', '|', cast(doc_id % 7 as int) + 1) as kind,
               case when doc_id % 7 = 0 then (case when doc_id % 21 = 7 then '' when doc_id % 21 = 14 then '   '
                    else text end) end as text,
               case when doc_id % 7 = 1 then cast(doc_id % 120 as int) end as n_texts,
               case when doc_id % 14 = 2 then 'python' end as community,
               case when doc_id % 14 = 3 then 'user1' end as author,
               case when doc_id % 7 = 5 then repeat('k', cast(doc_id % 130 as int)) end as keyword,
               case when doc_id % 7 = 5 then cast(doc_id % 8 as int) end as n_communities,
               case when doc_id % 7 = 4 then (case when doc_id % 2 = 0 then 'https://www.reddit.com/r/x/'
                    else 'ftp://reddit.com/r/x/' end) end as url,
               case when doc_id % 9 = 0 then 'decade' when doc_id % 9 = 1 then 'month' end as period,
               case when doc_id % 10 = 0 then 0 when doc_id % 10 = 1 then 350 when doc_id % 10 = 2 then 50 end as row_limit
        from documents""",
}


def _table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # The test tables are single small files that one task would read.  A table
    # with enough input splits is left as it is.
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, key)
    return df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived tables."""
    text = VIEWS[name]
    source, key = ("events", "event_id") if "from events" in text else ("documents", "doc_id")
    df = _table(spark, sf_dir, source, key)
    query = text.replace(f"from {source}", "from {source}")
    result = spark.sql(query, source=df)
    if "ts" in result.columns:
        result = result.withColumn("ts", result["ts"].cast("timestamp"))
    return result


def derive(spark: SparkSession, name: str, source: DataFrame) -> DataFrame:
    """The same over a given table, which may be a stream."""
    text = VIEWS[name]
    table = "events" if "from events" in text else "documents"
    return spark.sql(text.replace(f"from {table}", "from {source}"), source=source)


def ctes(*names: str) -> str:
    """The views as a ``with`` clause for the SQL checks."""
    return "with " + ",\n".join(f"{name} as ({VIEWS[name]})" for name in names)
