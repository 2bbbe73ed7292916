"""The SQL that each named query must agree with, for DuckDB on the same tables.

Written apart from the Spark code: plain windows and joins over whole tables.
"""

from __future__ import annotations

from ..functions import wordlists as W
from ..functions.text import CONTRACTIONS, SPACE, WORD
from ..sources.views import ctes
from .queries import AS_OF, KEYWORD, LEMMAS, PERIOD, SYMBOLS

CHECKS: dict[str, str] = {}


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def clean(text: str) -> str:
    x = f"replace(lower(coalesce({text}, '')), '😀', ':grinning_face:')"
    for short, full in CONTRACTIONS:
        x = f"replace({x}, {quoted([short])}, {quoted([full])})"
    # Fixed values.
    for pattern in (
        rf"http[^{SPACE}]+|www[^{SPACE}]+",
        r"\[[^\n]*?\]|\([^\n]*?\)",
        "/s|/S",
        rf"r/[{WORD}]+",
        rf"u/[{WORD}]+",
    ):
        x = f"regexp_replace({x}, '{pattern}', '', 'g')"
    x = rf"regexp_replace({x}, '[^{WORD}{SPACE}!?.,]', ' ', 'g')"
    return f"trim(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'))"


def lexicon(text: str) -> str:
    weights = [(W.POSITIVE_STRONG, 2), (W.POSITIVE_MODERATE, 1), (W.NEGATIVE_STRONG, -2), (W.NEGATIVE_MODERATE, -1)]
    return "(" + " + ".join(
        f"case when contains(lower({text}), '{w}') then {k} else 0 end" for words, k in weights for w in words
    ) + ")"


def label(score: str) -> str:
    return f"case when {score} <= -1 then 'negative' when {score} <= 1 then 'neutral' when {score} > 1 then 'positive' end"


def words(text: str) -> str:
    return f"list_filter(string_split({text}, ' '), lambda t: t <> '')"


def raw_words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[^{SPACE}]+'))"


LABELLED = f"""scored_words as (select *, {lexicon('text')} as lexicon_score from comments),
signals as (select *, tanh(score / 10.0)
       + case when subreddit in ({quoted(W.COMMUNITY_PRIORS['positive'])}) then 0.5
              when subreddit in ({quoted(W.COMMUNITY_PRIORS['negative'])}) then -0.5 else 0 end
       + lexicon_score + case when controversiality > 0 then -1 else 0 end as sentiment_score from scored_words),
labelled as (select *, {label('sentiment_score')} as sentiment from signals)"""

CLEANED = f"""cleaned as (select *, {clean('text')} as cleaned_text from labelled),
split_text as (select *, {words('cleaned_text')} as all_words from cleaned),
stopped as (select *, list_filter(all_words, lambda t: t not in ({quoted(W.STOP_WORDS)})) as kept_words from split_text),
joined_text as (select *, array_to_string(kept_words, ' ') as processed_text from stopped)"""

PREPARED = f"""{LABELLED},
{CLEANED},
prepared as (select *, cast(length(cleaned_text) as integer) as text_length, cast(len(kept_words) as integer) as word_count
    from joined_text where len(kept_words) >= 3)"""

BASE = ctes("comments")
ALL_LABELS = f"(select unnest(['negative', 'neutral', 'positive']) as sentiment)"
COUNTS = ", ".join(f"count(*) filter (where sentiment = '{s}') as {s}" for s in W.LABELS)


def check(name: str, sql: str) -> None:
    CHECKS[name] = sql


def percent(part: str, total: str) -> str:
    return f"round_even({part} * cast(100.0 as double) / {total}, 2)"


# --- Text ---------------------------------------------------------------------

check("clean_text", f"{BASE} select comment_id, {clean('text')} as cleaned_text from comments")
check(
    "processed_text",
    f"""{BASE}, {LABELLED}, {CLEANED}
    select comment_id, processed_text, cast(length(text) as integer) as raw_length,
           cast({raw_words('text')} as integer) as raw_words from joined_text""",
)
_lemma_rows = ", ".join(
    f"({quoted([x]) if x else 'null'}, {quoted([y]) if y else 'null'})" for x, y in LEMMAS
)
LEMMATIZED = f"""given as (select * from (values {_lemma_rows}) v(surface, lemma) union all
        select distinct surface, substr(surface, 1, length(surface) - 1) from
        (select unnest(string_split(lower(text), ' ')) as surface from documents)
        where surface like '%s' and length(surface) > 4),
    lemmas as (select surface, min(lemma) as lemma from given where surface is not null and lemma is not null group by surface),
    places as (select comment_id, unnest(kept_words) as w, generate_subscripts(kept_words, 1) as i from joined_text),
    lines as (select comment_id, string_agg(coalesce(lemma, w), ' ' order by i) as line
        from places left join lemmas on surface = w group by comment_id)"""
check(
    "lemmatized_text",
    f"""{BASE}, {LABELLED}, {CLEANED}, {LEMMATIZED}
    select comment_id, coalesce(line, '') as processed_text from joined_text left join lines using (comment_id)""",
)
for _name in ("lemmatized_features", "stream_lemmatized_features"):
    check(
        _name,
        f"""{BASE}, {LABELLED}, {CLEANED}, {LEMMATIZED}
        select comment_id, sentiment, round(sentiment_score, 6) as sentiment_score, line as processed_text,
               cast(len(kept_words) as integer) as word_count
        from joined_text join lines using (comment_id) where len(kept_words) >= 3""",
    )
_symbols = ", ".join(f"({i}, {quoted([name])})" for i, (_, name) in enumerate(SYMBOLS))
check(
    "symbol_names",
    f"""select doc_id, trim({clean('text')} || ' ' || name) as cleaned from documents
    join (values {_symbols}) v(i, name) on i = doc_id % {len(SYMBOLS)}""",
)
check(
    "text_previews",
    f"""{BASE} select comment_id, case when length(text) > 200 then substr(text, 1, 200) || '...' else text end as preview
    from comments""",
)

# --- Labels -------------------------------------------------------------------

check(
    "sentiment_labels",
    f"""{BASE}, {LABELLED}
    select comment_id, cast(lexicon_score as integer) as lexicon_score, round(sentiment_score, 6) as sentiment_score, sentiment,
           case sentiment when 'negative' then 0 when 'neutral' then 1 when 'positive' then 2 end as label,
           sentiment as label_name
    from labelled""",
)


def _estimate(text: str) -> str:
    found = f"string_split_regex(lower({text}), '[{SPACE}]+')"
    parts = [
        (W.ESTIMATE_POSITIVE_STRONG, 2.0), (W.ESTIMATE_POSITIVE_MODERATE, 1.0),
        (W.ESTIMATE_NEGATIVE_STRONG, -2.0), (W.ESTIMATE_NEGATIVE_MODERATE, -1.0),
    ]
    hits = " + ".join(
        f"cast({k} as double) * len(list_filter([{quoted(ws)}], lambda w: list_contains({found}, w)))" for ws, k in parts
    )
    return (
        f"({hits} + greatest(least(score, 10), -10) / 10.0"
        " + case when controversiality > 0 then cast(-1.5 as double) else 0 end)"
    )


ESTIMATED = f"""estimated as (select *, {_estimate('text')} as estimate from comments),
estimates as (select *, case when estimate > 2 then 'positive' when estimate < -1 then 'negative'
    else 'neutral' end as sentiment from estimated)"""
check(
    "estimate_sentiment",
    f"{BASE}, {ESTIMATED} select comment_id, round(estimate, 6) as estimate, sentiment from estimates",
)
_categories = " ".join(f"when subreddit in ({quoted(ns)}) then '{c}'" for c, ns in W.COMMUNITY_PRIORS.items())
check(
    "community_categories",
    f"""{BASE} select subreddit, case {_categories} end as category, count(*) as n,
    cast(sum(score) as bigint) as total_score from comments group by all""",
)

# --- Features -----------------------------------------------------------------

check(
    "comment_features",
    f"""{BASE}, {PREPARED}
    select comment_id, sentiment, round(sentiment_score, 6) as sentiment_score, text_length, word_count,
           round(list_avg(list_transform(all_words, lambda w: length(w))), 6) as avg_word_length,
           cast(hour(created_utc) as integer) as hour, cast(isodow(created_utc) - 1 as integer) as day_of_week,
           round(tanh(score / 10.0), 6) as score_normalized,
           case when controversiality > 0 then 1 else 0 end as is_controversial,
           round(abs(sentiment_score), 6) as sentiment_strength
    from prepared""",
)
check(
    "text_features",
    rf"""{BASE}, {PREPARED}
    select comment_id, cast(len(regexp_extract_all(text, '!')) as integer) as exclamation_count,
           cast(len(regexp_extract_all(text, '\?')) as integer) as question_count,
           cast(len(regexp_extract_all(text, '[.,!?;:]')) as integer) as punctuation_count,
           cast(len(regexp_extract_all(text, '\p{{Lu}}')) as integer) as caps_count,
           round(cast(len(regexp_extract_all(text, '\p{{Lu}}')) as double) / text_length, 6) as caps_ratio,
           round(list_avg(list_transform(kept_words, lambda w: length(w))), 6) as avg_word_length
    from prepared""",
)
check(
    "engagement_features",
    f"""{BASE}, {PREPARED}
    select comment_id, round(ln(1 + abs(score)) * sign(score), 6) as score_log,
           round(sin(2 * pi() * hour(created_utc) / 24), 6) as hour_sin,
           round(cos(2 * pi() * hour(created_utc) / 24), 6) as hour_cos,
           round(sin(2 * pi() * (isodow(created_utc) - 1) / 7), 6) as weekday_sin,
           round(cos(2 * pi() * (isodow(created_utc) - 1) / 7), 6) as weekday_cos
    from prepared""",
)
check(
    "sentiment_features",
    f"""{BASE}, {PREPARED}
    select comment_id,
           round((abs(sentiment_score) - avg(abs(sentiment_score)) over ())
                 / stddev_pop(abs(sentiment_score)) over (), 6) as sentiment_strength_normalized,
           round(abs(sentiment_score), 6) as sentiment_confidence
    from prepared""",
)

HASHED = """sized as (select *, count(*) over (partition by sentiment) as n_class,
    row_number() over (partition by sentiment order by md5(concat(comment_id, '|42'))) as rn from {source}),
goal as (select cast(floor(count(*) / 3) as bigint) as target from {source} where sentiment is not null),
draws as (select c.sentiment, i.i as copy,
    1 + cast('0x' || substr(md5(concat(c.sentiment, '|', i.i, '|42')), 1, 15) as bigint) % c.n_class as rn
    from (select distinct sentiment, n_class from sized) c, goal,
         (select unnest(range(1, (select target + 1 from goal))) as i) i where c.n_class <= target),
balanced as (select s.*, 0 as copy from sized s, goal where n_class > target and rn <= target
    union all by name select s.*, d.copy from sized s join draws d on s.sentiment = d.sentiment and s.rn = d.rn)"""
check(
    "engineered_features",
    rf"""{BASE}, {PREPARED}, {HASHED.format(source='prepared')}
    select sentiment, count(*) as n, count(distinct comment_id) as distinct_comments,
           cast(sum(len(regexp_extract_all(text, '[.,!?;:]'))) as bigint) as punctuation,
           round(sum(ln(1 + abs(score)) * sign(score)), 6) as score_log
    from balanced group by sentiment""",
)

# --- Filters and quotas ---------------------------------------------------------

POSTS = ctes("comments", "posts")
check(
    "valid_comments",
    f"""{POSTS}, rules as (
      select comment_id, post_id, 'at_least_30' as rule from comments
       where length(text) >= 30 and text not in ('[deleted]', '[removed]')
      union all select comment_id, post_id, 'more_than_20' from comments
       where length(text) > 20 and text not in ('[deleted]', '[removed]'))
    select comment_id, rule from rules where post_id not in (select post_id from posts where over_18)""",
)
_periods = [("hour", "1 hour"), ("day", "1 day"), ("week", "7 days"), ("month", "1 month"), ("year", "1 year")]
_in = " union all ".join(
    f"select '{p}' as period, score from posts where created_utc >= timestamp '{AS_OF}' - interval '{i}'"
    f" and created_utc <= timestamp '{AS_OF}'"
    for p, i in _periods
)
check(
    "period_posts",
    f"""{ctes('posts')}, all_periods as ({_in} union all select 'all', score from posts)
    select period, count(*) as n, cast(sum(score) as bigint) as total_score from all_periods group by period""",
)


def top_posts(n: int, period: str = PERIOD) -> str:
    interval = dict(_periods)[period]
    return f"""chosen as (select post_id, subreddit as community, title, score as post_score from posts
       where created_utc >= timestamp '{AS_OF}' - interval '{interval}' and created_utc <= timestamp '{AS_OF}'
       qualify row_number() over (partition by subreddit order by score desc, post_id) <= {n})"""


check(
    "top_posts",
    f"{ctes('posts')}, {top_posts(5)} select community as subreddit, post_id, post_score as score from chosen",
)
check(
    "keyword_mentions",
    f"""{BASE} select comment_id, subreddit, score from comments
    where length(text) > 20 and contains(lower(text), lower('{KEYWORD}'))""",
)
_valid = """text not in ('[deleted]', '[removed]') and post_id not in (select post_id from posts where over_18)"""
check(
    "capped_comments",
    f"""{POSTS}, ranked as (select *, case listing when 'hot' then 0 when 'top' then 1 when 'new' then 2
        when 'controversial' then 3 end as listing_rank from comments where length(text) > 20 and {_valid})
    select subreddit, comment_id, listing from ranked
    qualify row_number() over (partition by subreddit order by listing_rank, created_utc, comment_id) <= 20""",
)


def _position(names: list[str], column: str) -> str:
    return "case " + " ".join(f"when {column} = '{n}' then {i}" for i, n in enumerate(names)) + " end"


def _quota(target: int, cap: int) -> str:
    groups = list(W.COLLECTION_GROUPS)
    group = "case " + " ".join(
        f"when subreddit in ({quoted(W.COLLECTION_GROUPS[g])}) then {i}" for i, g in enumerate(groups)
    ) + " end"
    community = "case " + " ".join(
        f"when grp = {i} then {_position(W.COLLECTION_GROUPS[g], 'subreddit')}" for i, g in enumerate(groups)
    ) + " end"
    listing = "case " + " ".join(
        f"when grp = {i} then {_position(W.COLLECTION_LISTINGS[g], 'listing')}" for i, g in enumerate(groups)
    ) + " end"
    sql = f"""{POSTS}, {ESTIMATED},
    grouped as (select *, {group} as grp from estimates where length(text) >= 30 and {_valid}),
    placed as (select *, {community} as crank, {listing} as lrank from grouped),
    arrivals as (select *, row_number() over (order by grp, crank, lrank, created_utc, comment_id) as pos
                 from placed where crank is not null and lrank is not null),
    full_0 as (select null as sentiment, null as pos where false)"""
    # Each round: rows kept given the classes known to be full, then the next class to fill.
    for i in range(4):
        sql += f""",
    open_{i} as (select a.* from arrivals a where not exists
        (select 1 from full_{i} f where f.sentiment = a.sentiment and a.pos > f.pos)),
    kept_{i} as (select * from open_{i} qualify row_number() over (partition by subreddit order by pos) <= {cap}),
    next_{i} as (select sentiment, pos from (select sentiment, pos,
        row_number() over (partition by sentiment order by pos) as rn from kept_{i}) r
        where rn = {target} and sentiment not in (select sentiment from full_{i} where sentiment is not null)
        order by pos limit 1),
    full_{i + 1} as (select * from full_{i} union all select * from next_{i})"""
    return sql


check(
    "quota_comments",
    f"""{_quota(120, 18)}
    select comment_id, subreddit, sentiment, cast(length(text) as integer) as text_length,
           cast({raw_words('text')} as integer) as word_count from kept_3""",
)
check("distinct_comments", f"{BASE} select comment_id, subreddit, case when listing > 'top' then 'top' else listing end as listing from comments")
check(
    "validated_requests",
    rf"""{ctes('requests')}, filled as (select *, coalesce(period, 'week') as p,
        coalesce(row_limit, 100) as posts_limit, coalesce(row_limit, 50) as comments_limit from requests)
    select request_id, kind, concat_ws(',',
        case when kind not in ('predict', 'predict_batch', 'community', 'author', 'url', 'trend') then 'unknown_kind' end,
        case when kind = 'predict' and coalesce(length(text), 0) = 0 then 'text_missing' end,
        case when kind = 'predict' and length(text) > 5000 then 'text_too_long' end,
        case when kind = 'predict' and length(text) > 0 and not regexp_matches(text, '[^{SPACE}]') then 'text_blank' end,
        case when kind = 'predict_batch' and coalesce(n_texts, 0) = 0 then 'batch_empty' end,
        case when kind = 'predict_batch' and n_texts > 100 then 'batch_too_large' end,
        case when kind = 'predict_batch' and n_texts >= 50 then 'text_blank' end,
        case when kind = 'community' and community is null then 'community_missing' end,
        case when kind = 'author' and author is null then 'author_missing' end,
        case when kind = 'trend' and coalesce(length(keyword), 0) = 0 then 'keyword_missing' end,
        case when kind = 'trend' and length(keyword) > 100 then 'keyword_too_long' end,
        case when kind = 'trend' and coalesce(n_communities, 0) = 0 then 'communities_missing' end,
        case when kind = 'trend' and n_communities > 5 then 'too_many_communities' end,
        case when kind in ('community', 'trend') and p not in ('hour', 'day', 'week', 'month', 'year', 'all') then 'bad_period' end,
        case when kind in ('community', 'trend') and posts_limit not between 1 and 500 then 'bad_limit' end,
        case when kind = 'author' and comments_limit not between 1 and 200 then 'bad_limit' end,
        case when kind = 'url' and not regexp_matches(url, '^https?://(www\.)?reddit\.com/.*$') then 'bad_url' end
      ) as violations, violations = '' as accepted
    from filled""",
)

URLS = r"""parsed as (select *, regexp_extract(url, '^[a-z]+://([^/]*)', 1) as host,
    string_split(trim(regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1), '/'), '/') as parts from thread_urls),
located as (select *, coalesce(list_position(parts, 'comments'), 0) as place from parsed),
refs as (select doc_id, url,
    case when not contains(host, 'reddit.com') then 'not_a_site_url' when place = 0 then 'no_comments_segment'
         when parts[place + 1] is null then 'no_post_id' end as reject_reason,
    case when reject_reason is null then parts[place + 1] end as post_id,
    case when reject_reason is null then parts[place + 3] end as comment_id from located)"""
check("parsed_urls", f"{ctes('thread_urls')}, {URLS} select doc_id, url, post_id, comment_id, reject_reason from refs")

# --- TF-IDF, sampling, data preparation -----------------------------------------

TERMS = rf"""doc_words as (select comment_id, list_filter(regexp_extract_all(lower(processed_text), '[{WORD}]{{2,}}'),
    lambda w: w not in ({quoted(W.TFIDF_STOP_WORDS)})) as w from prepared),
doc_terms as (select comment_id, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from doc_words),
vocabulary as (select term, count(*) as term_frequency, count(distinct comment_id) as document_frequency
    from doc_terms group by term order by term_frequency desc, term limit 1000)"""
check("tfidf_vocabulary", f"{BASE}, {PREPARED}, {TERMS} select * from vocabulary")
check(
    "tfidf_weights",
    f"""{BASE}, {PREPARED}, {TERMS},
    indexed as (select *, row_number() over (order by term) - 1 as term_index from vocabulary),
    raw as (select t.comment_id, v.term_index, v.term,
        count(*) * (ln((1 + (select count(*) from prepared)) / (1.0 + v.document_frequency)) + 1) as x
        from doc_terms t join indexed v on t.term = v.term group by t.comment_id, v.term_index, v.term, v.document_frequency)
    select comment_id, cast(term_index as integer) as term_index, term,
           round(x / sqrt(sum(x * x) over (partition by comment_id)), 6) as weight from raw""",
)
check(
    "balanced_classes",
    f"{BASE}, {LABELLED}, {HASHED.format(source='labelled')} select comment_id, sentiment, cast(copy as bigint) as copy from balanced",
)
SPLIT = """split_rows as (select *, case when row_number() over (partition by sentiment order by md5(concat(comment_id, '|42')))
    <= round(0.2 * count(*) over (partition by sentiment)) then 'test' else 'train' end as split from labelled)"""
check("stratified_split", f"{BASE}, {LABELLED}, {SPLIT} select comment_id, sentiment, split from split_rows")
_scaled = ", ".join(
    f"round(({c} - (select avg({c}) from numbers where split = 'train'))"
    f" / (select stddev_pop({c}) from numbers where split = 'train'), 6) as {c}"
    for c in ("sentiment_score", "score_normalized", "score_log")
)
check(
    "standardized_features",
    f"""{BASE}, {LABELLED}, {SPLIT},
    numbers as (select comment_id, split, sentiment_score, tanh(score / 10.0) as score_normalized,
        coalesce(case when controversiality = 0 then ln(1 + abs(score)) * sign(score) end, 0) as score_log from split_rows)
    select comment_id, split, {_scaled} from numbers""",
)

check(
    "text_model_facts",
    f"""{BASE}, {PREPARED}, {SPLIT.replace('from labelled', 'from prepared')}
    select sentiment, count(*) as held_out, count(*) as predicted, true as sums_to_one, true as label_is_largest,
           true as same_when_loaded, true as better_than_chance
    from split_rows where split = 'test' group by sentiment""",
)

check(
    "model_certificate",
    f"""{BASE}, {PREPARED}, {SPLIT.replace('from labelled', 'from prepared')}
    select sentiment, count(*) filter (where split = 'train') as fitted_on, count(*) filter (where split = 'test') as held_out,
           true as optimal, true as same_when_loaded, true as better_than_majority
    from split_rows group by sentiment""",
)

SCORED = f"""scored_text as (select *, {lexicon('text')} as s from {{source}}),
shifted as (select *, greatest(-s, 1, s) as top from scored_text),
weighed as (select *, exp(-s - top) as e0, exp(1 - top) as e1, exp(s - top) as e2 from shifted),
predicted as (select * exclude (s, top, e0, e1, e2), {label('s')} as sentiment,
    greatest(e0, e1, e2) / (e0 + e1 + e2) as confidence,
    e0 / (e0 + e1 + e2) as p_negative, e1 / (e0 + e1 + e2) as p_neutral, e2 / (e0 + e1 + e2) as p_positive from weighed)"""
check(
    "prediction_records",
    f"""{BASE}, {SCORED.format(source='comments')}
    select comment_id, sentiment, round(confidence, 6) as confidence, round(p_negative, 6) as p_negative,
           round(p_neutral, 6) as p_neutral, round(p_positive, 6) as p_positive, cast(null as varchar) as reject_reason
    from predicted""",
)

# --- Evaluation -----------------------------------------------------------------

PAIRS = ctes("scored")
check(
    "confusion_matrix",
    f"""{PAIRS} select case sentiment when 'negative' then 0 when 'neutral' then 1 else 2 end as label,
    sentiment as true_label, {', '.join(f"count(*) filter (where predicted_label = '{s}') as predicted_{s}" for s in W.LABELS)}
    from scored group by sentiment""",
)
check(
    "classification_report",
    f"""{PAIRS}, per_class as (
      select l.sentiment as row,
        count(*) filter (where s.sentiment = l.sentiment and s.predicted_label = l.sentiment) as tp,
        count(*) filter (where s.predicted_label = l.sentiment) as guessed,
        count(*) filter (where s.sentiment = l.sentiment) as support
      from {ALL_LABELS} l cross join scored s group by l.sentiment),
    rates as (select row, tp, support, coalesce(tp / nullif(guessed, 0), 0) as precision,
        coalesce(tp / nullif(support, 0), 0) as recall from per_class),
    scores as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from rates)
    select row, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1_score, support from scores
    union all select 'accuracy', null, null, round(sum(tp) / sum(support), 6), cast(sum(support) as bigint) from scores
    union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
        cast(sum(support) as bigint) from scores
    union all select 'weighted avg', round(sum(precision * support) / sum(support), 6),
        round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
        cast(sum(support) as bigint) from scores""",
)
check(
    "error_examples",
    f"""{PAIRS}, wrong as (select *, row_number() over (partition by sentiment, predicted_label order by doc_id) as rn
        from scored where sentiment <> predicted_label)
    select sentiment as true_label, predicted_label, count(*) as count,
           string_agg(text, ' | ' order by doc_id) filter (where rn <= 3) as examples
    from wrong group by sentiment, predicted_label""",
)

# --- Aggregates -----------------------------------------------------------------

check(
    "value_counts",
    f"""{BASE}, {LABELLED}
    select 'sentiment' as column, sentiment as value, count(*) as count from labelled group by sentiment
    union all select 'subreddit', subreddit, count(*) from labelled group by subreddit""",
)
check("distinct_communities", f"{BASE} select count(distinct subreddit) as communities from comments")


def _describe(column: str) -> str:
    return f"""select '{column}' as column, count({column}) as count, round(avg({column}), 6) as mean,
        round(stddev_samp({column}), 6) as std, cast(min({column}) as double) as min,
        round(quantile_cont({column}, 0.25), 6) as p25, round(quantile_cont({column}, 0.5), 6) as p50,
        round(quantile_cont({column}, 0.75), 6) as p75, cast(max({column}) as double) as max from prepared"""


check("length_describe", f"{BASE}, {PREPARED} {_describe('text_length')} union all {_describe('word_count')}")
check(
    "length_by_sentiment",
    f"{BASE}, {PREPARED} select sentiment, round(avg(text_length), 6) as mean_length from prepared group by sentiment",
)
DAY = "strftime(created_utc, '%Y-%m-%d') as day"
check("daily_sentiment_counts", f"{BASE}, {LABELLED} select {DAY}, {COUNTS} from labelled group by day")

# --- Reports --------------------------------------------------------------------


def community(period: str = PERIOD) -> str:
    return f"""{POSTS}, {top_posts(100, period)},
    under as (select c.* exclude (subreddit), p.community as subreddit, p.title as post_title
        from comments c join chosen p on c.post_id = p.post_id where length(c.text) > 20),
    {SCORED.format(source='under')}"""


check(
    "community_distribution",
    f"""{community()}, totals as (select subreddit, count(*) as total from predicted group by subreddit),
    cells as (select t.subreddit, l.sentiment, t.total,
        (select count(*) from predicted p where p.subreddit = t.subreddit and p.sentiment = l.sentiment) as count
        from totals t cross join {ALL_LABELS} l)
    select subreddit, sentiment, count, round(count / total, 6) as ratio, {percent('count', 'total')} as percentage, total
    from cells""",
)
check("community_daily_counts", f"{community()} select subreddit, {DAY}, {COUNTS} from predicted group by subreddit, day")
check(
    "first_titles",
    f"""{community()} select subreddit, post_title, {COUNTS},
        cast(row_number() over (partition by subreddit order by post_title) as integer) as rank
    from predicted group by subreddit, post_title qualify rank <= 5""",
)
PREVIEW = "case when length(text) > 200 then substr(text, 1, 200) || '...' else text end as text"
check(
    "top_comments",
    f"""{community()}, best as (select *, cast(row_number() over (partition by subreddit order by score desc, comment_id)
        as integer) as rank from predicted)
    select subreddit, rank, comment_id, {PREVIEW}, sentiment, round(confidence, 6) as confidence, score
    from best where rank <= 5""",
)
check(
    "community_summary",
    f"""{community('week')}, subjects as (select distinct subreddit from posts)
    select s.subreddit, count(p.comment_id) as total_comments_analyzed,
           case when count(p.comment_id) = 0 then 'No comments found for analysis' end as message, 'week' as analysis_period
    from subjects s left join predicted p on s.subreddit = p.subreddit group by s.subreddit""",
)
AUTHOR = f"""{BASE}, newest as (select * from comments
    qualify row_number() over (partition by author order by created_utc desc, comment_id) <= 50),
long_ones as (select * from newest where length(text) > 20), {SCORED.format(source='long_ones')}"""
check(
    "author_summary",
    f"""{AUTHOR}, subjects as (select distinct author from comments)
    select s.author, count(p.comment_id) as total_comments_analyzed,
           case when count(p.comment_id) = 0 then 'No comments found for analysis' end as message
    from subjects s left join predicted p on s.author is not distinct from p.author group by s.author""",
)
check(
    "author_distribution",
    f"""{AUTHOR}, cells as (select author, sentiment, count(*) as count,
        cast(sum(count(*)) over (partition by author) as bigint) as total from predicted group by author, sentiment)
    select author, sentiment, count, {percent('count', 'total')} as percentage, total from cells""",
)
check(
    "author_communities",
    f"""{AUTHOR} select author, subreddit, count(*) as count,
        cast(row_number() over (partition by author order by count(*) desc, subreddit) as integer) as rank
    from predicted group by author, subreddit qualify rank <= 5""",
)
check("author_daily_counts", f"{AUTHOR} select author, {DAY}, {COUNTS} from predicted group by author, day")
STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S') as {0}"
check(
    "author_recent",
    f"""{AUTHOR}, latest as (select *, cast(row_number() over (partition by author order by created_utc desc, comment_id)
        as integer) as rank from predicted)
    select author, rank, comment_id, text, sentiment, subreddit, score, {STAMP.format('created_utc')}
    from latest where rank <= 5""",
)
TREND = f"""{POSTS}, {top_posts(100)},
    found as (select c.* exclude (subreddit), p.community as subreddit from comments c join chosen p on c.post_id = p.post_id
        where length(c.text) > 20 and contains(lower(c.text), lower('{KEYWORD}'))),
    {SCORED.format(source='found')}"""
check(
    "trend_summary",
    f"""{TREND}, counted as (select count(*) as n from predicted)
    select '{KEYWORD}' as keyword, n as total_mentions,
           case when n = 0 then 'No mentions found for ''{KEYWORD}'' in specified subreddits' end as message from counted
    union all select 'no such word', 0, 'No mentions found for ''no such word'' in specified subreddits'""",
)
check("trend_sentiment", f"{TREND} select subreddit, {COUNTS} from predicted group by subreddit")
check(
    "trend_engagement",
    f"""{TREND} select subreddit, round(avg(score), 6) as avg_score, cast(sum(score) as bigint) as total_score,
        count(*) as comment_count from predicted group by subreddit""",
)
check(
    "trend_mentions",
    f"""{TREND}, best as (select * from predicted order by score desc, comment_id limit 5)
    select comment_id, {PREVIEW}, sentiment, round(confidence, 6) as confidence, score, subreddit,
           {STAMP.format('created_utc')} from best""",
)
FIRST = """first_rows as (select *, cast(row_number() over (partition by post_id order by created_utc, comment_id) as integer)
    as rank from comments qualify rank <= 20),
listed as (select * from first_rows where length(text) > 20)"""
check(
    "thread_comments",
    f"""{POSTS}, {FIRST}, {SCORED.format(source='listed')}
    select p.post_id, t.title as post_title, comment_id, sentiment, p.score, is_submitter
    from predicted p join posts t on p.post_id = t.post_id""",
)


def _named(prefix: str, source: str) -> str:
    return SCORED.format(source=source).replace("scored_text", f"{prefix}_scored").replace(
        "shifted", f"{prefix}_shifted"
    ).replace("weighed", f"{prefix}_weighed").replace("predicted as", f"{prefix}_predicted as")


_shares = ", ".join(
    f"case when comments_analyzed > 0 then {percent(s, 'comments_analyzed')} end as {s}_percentage" for s in W.LABELS
)
check(
    "thread_report",
    f"""{ctes('comments', 'posts', 'thread_urls')}, {URLS}, {FIRST}, {_named('thread', 'listed')},
    post_texts as (select *, case when selftext <> '' then selftext else title end as text from posts),
    {_named('post', 'post_texts')}, {_named('single', 'comments')},
    threads as (select post_id, count(*) as n, {COUNTS} from thread_predicted group by post_id),
    joined as (select r.doc_id, r.url, r.post_id, r.comment_id,
        case when r.reject_reason is not null then r.reject_reason when p.post_id is null then 'post_not_found'
             when r.comment_id is not null and s.comment_id is null then 'comment_not_found' end as reject_reason,
        p.title as post_title, p.sentiment as post_sentiment, round(p.confidence, 6) as post_confidence,
        p.score as post_score, p.upvote_ratio,
        case when r.reject_reason is null then (case when r.comment_id is not null then count_if(s.comment_id is not null)
             over (partition by r.doc_id) else coalesce(t.n, 0) end) end as comments_analyzed,
        {', '.join(f"case when r.reject_reason is null then (case when r.comment_id is not null then (case when s.sentiment = '{x}' then 1 else 0 end) else coalesce(t.{x}, 0) end) end as {x}" for x in W.LABELS)}
      from refs r left join post_predicted p on r.post_id = p.post_id
        left join threads t on r.post_id = t.post_id left join single_predicted s on r.comment_id = s.comment_id)
    select * replace (cast(comments_analyzed as bigint) as comments_analyzed), {_shares} from joined""",
)

# --- Experiments ----------------------------------------------------------------

AB = f"""{ctes('ab_results')},
tests as (select * from (values ('test_a', cast(null as timestamp)), ('test_b', timestamp '2024-01-20 00:00:00')) v(test_id, ended_at)),
variants as (select * from (values ('test_a', 'm0', 3.0), ('test_a', 'm1', 1.0), ('test_b', 'm0', 1.0), ('test_b', 'm1', 1.0),
    ('test_b', 'm2', 2.0)) v(test_id, model_id, weight)),
shares as (select test_id, model_id, cast(weight as double) / sum(weight) over (partition by test_id) as share,
    sum(cast(weight as double)) over (partition by test_id order by model_id) / sum(weight) over (partition by test_id) as upper
    from variants),
long_metrics as (select test_id, model_id, ts, 'latency' as metric, latency as value from ab_results
    union all select test_id, model_id, ts, 'confidence', confidence from ab_results)"""
STATS = """round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, count(value) as count,
    round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.95), 6) as p95"""
check(
    "ab_variant_use",
    f"""{AB} select s.test_id, s.model_id, round(share, 6) as share, round(upper - share, 6) as lower, round(upper, 6) as upper,
        count(r.ts) as n
    from shares s left join ab_results r on s.test_id = r.test_id and s.model_id = r.model_id
    group by s.test_id, s.model_id, share, upper""",
)
check(
    "ab_assignment",
    f"""{AB}, units as (select distinct test_id, user_id,
        cast('0x' || substr(md5(concat(user_id, '|', test_id)), 1, 8) as bigint) / 4294967296.0 as draw from ab_results)
    select u.test_id, u.user_id, round(u.draw, 6) as draw,
        (select min_by(s.model_id, s.upper) from shares s join tests t on s.test_id = t.test_id
          where s.test_id = u.test_id and t.ended_at is null and u.draw < s.upper) as model_id
    from units u""",
)
check(
    "ab_recorded",
    f"""{AB} select test_id, model_id, count(*) as n from ab_results
    where test_id in (select test_id from tests where ended_at is null) group by test_id, model_id""",
)
check("ab_statistics", f"{AB} select test_id, model_id, metric, {STATS} from long_metrics group by test_id, model_id, metric")
check(
    "ab_final_results",
    f"""{AB}, stats as (select m.test_id, m.model_id, m.metric, {STATS} from long_metrics m join tests t on m.test_id = t.test_id
        where m.ts <= t.ended_at group by m.test_id, m.model_id, m.metric)
    select v.test_id, v.model_id, strftime(t.ended_at, '%Y-%m-%d %H:%M:%S') as ended_at, s.metric, s.mean, s.std, s.count,
        s.median, s.p95
    from variants v join tests t on v.test_id = t.test_id and t.ended_at is not null
    left join stats s on v.test_id = s.test_id and v.model_id = s.model_id""",
)

# --- Monitoring -----------------------------------------------------------------

EVENTS = ctes("predictions")
check(
    "counters",
    f"""{EVENTS} select 'requests' as counter, endpoint as label_1, method as label_2, count(*) as value
    from predictions group by all
    union all select 'predictions', sentiment, null, count(*) from predictions group by all
    union all select 'errors', model_version, error_type, count(*) from predictions where error_type is not null group by all""",
)


def histogram(labels: list[str], value: str, bounds: list[float]) -> str:
    names = "".join(f"{x}, " for x in labels)
    group = f"group by {', '.join(labels)}" if labels else ""
    parts = [
        f"select {names}round(sum({value}), 6) as sum, count({value}) as count, '{le}' as le,"
        f" {'count(*) filter (where ' + value + ' <= ' + le + ')' if le != '+Inf' else 'count(' + value + ')'} as bucket_count"
        f" from predictions {group}"
        for le in [*(repr(float(b)) for b in bounds), "+Inf"]
    ]
    return f"{EVENTS} " + " union all ".join(parts)


_latency = [0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]
_inference = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]
_confidence = [i / 10 for i in range(1, 11)]
check("latency_histogram", histogram(["endpoint"], "latency_seconds", _latency))
check("inference_histogram", histogram(["model_version"], "latency_seconds", _inference))
check("confidence_histogram", histogram([], "confidence", _confidence))
check("confidence_by_version", histogram(["model_version", "sentiment"], "confidence", _confidence))


def last(n: int, by: str = "") -> str:
    part = f"partition by {by} " if by else ""
    return f"{EVENTS}, recent as (select * from predictions qualify row_number() over ({part}order by ts desc, prediction_id desc) <= {n})"


_drift = ", ".join(
    f"round(count(*) filter (where sentiment = '{s}') / 100.0, 6) as {s}_share" for s in W.LABELS
) + ", round(avg(confidence), 6) as average_confidence, round(stddev_pop(confidence), 6) as confidence_std"
_performance = """count(*) as total_predictions, round(coalesce(avg(confidence), 0), 6) as avg_confidence,
    round(coalesce(median(confidence), 0), 6) as median_confidence, round(coalesce(min(confidence), 0), 6) as min_confidence,
    round(coalesce(max(confidence), 0), 6) as max_confidence, """ + ", ".join(
    f"count(*) filter (where sentiment = '{s}') as {s}_count" for s in W.LABELS
)
check("drift_last_100", f"{last(100)} select {_drift} from recent having count(*) = 100")
check(
    "drift_by_version",
    f"{last(100, 'model_version')} select model_version, {_drift} from recent group by model_version having count(*) = 100",
)
check("performance_last_1000", f"{last(1000)} select {_performance} from recent")
check(
    "performance_by_version",
    f"{last(1000, 'model_version')} select model_version, {_performance} from recent group by model_version",
)
check(
    "last_predictions",
    f"{last(10)} select prediction_id, {STAMP.format('ts')}, sentiment, round(confidence, 6) as confidence from recent",
)
check(
    "error_totals",
    f"""{EVENTS} select error_type, count(*) as errors, cast(sum(count(*)) over () as bigint) as error_count
    from predictions where error_type is not null group by error_type""",
)
check(
    "service_summary",
    f"""{EVENTS} select {', '.join(f"count(*) filter (where sentiment = '{s}') as {s}_predictions" for s in W.LABELS)},
    cast(count(*) filter (where endpoint in ('/predict', '/predict/batch') and method = 'POST') as double) as total_requests
    from predictions""",
)

# --- Sources and sinks ------------------------------------------------------------

check(
    "flattened_threads",
    f"""{POSTS}, threads as (select post_id, min(subreddit) as subreddit, min(listing) as listing from comments group by 1)
    select c.comment_id, c.text, t.subreddit, c.score, {STAMP.format('created_utc').replace('(created', '(c.created')},
        p.title as post_title, c.post_id, p.over_18, c.is_submitter,
        'https://reddit.com/r/x/' || c.comment_id as permalink, c.controversiality, t.listing
    from comments c join posts p on c.post_id = p.post_id join threads t on t.post_id = c.post_id""",
)
_collected = f"""{BASE} select comment_id, text, subreddit, score, {STAMP.format('created_utc')}, post_id, is_submitter,
    controversiality from comments"""
check("csv_comments", _collected)
check("newest_snapshot", _collected)
check(
    "rejected_threads",
    f"""{BASE} select case ((score % 7) + 7) % 7 when 1 then 'bad_json' when 2 then 'no_post_id' when 3 then 'no_comments'
        when 4 then 'no_comment_id' when 5 then 'bad_json' else 'kept' end as reason, count(*) as posts
    from comments group by 1""",
)
check(
    "accumulated_batches",
    f"""{BASE} select comment_id, score, case when score < 0 then controversiality end as controversiality,
    case when score >= 0 then 'hot' end as category from comments""",
)

# --- Streams ----------------------------------------------------------------------

check(
    "stream_comment_features",
    f"""{BASE}, {PREPARED} select comment_id, sentiment, round(sentiment_score, 6) as sentiment_score, processed_text,
        word_count, cast(hour(created_utc) as integer) as hour, cast(isodow(created_utc) - 1 as integer) as day_of_week
    from prepared""",
)
check("stream_daily_counts", f"{BASE}, {LABELLED} select {DAY}, {COUNTS} from labelled group by day")
# A day is written once its end lies at or before the latest time less the delay.
check(
    "stream_closed_days",
    f"""{BASE}, {LABELLED} select {DAY}, {COUNTS} from labelled group by day
    having cast(day as timestamp) + interval '1 day' <= (select max(created_utc) - interval '1 hour' from comments)""",
)
check("stream_distinct_comments", f"{BASE} select comment_id, {STAMP.format('created_utc')}, score from comments")
CHECKS["stream_drift"] = CHECKS["drift_by_version"]
CHECKS["stream_performance"] = CHECKS["performance_by_version"]
check("stream_counters", f"{EVENTS} select endpoint, method, count(*) as value from predictions group by endpoint, method")
CHECKS["stream_latency_histogram"] = CHECKS["latency_histogram"]
