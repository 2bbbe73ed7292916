"""DuckDB SQL that the queries of this subpackage must agree with, where SQL can express them."""

from __future__ import annotations

from . import warc
from .quality_rules import STOP_WORDS

CHECKS: dict[str, str] = {}

CHECKS["op1_substring_dedup"] = r"""
    with words as (
        select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
    ), starts as (
        select doc_id, w, unnest(range(1, len(w) - 11)) as i from words
    ), windows as (
        select doc_id, i, array_to_string(w[i:i + 12], ' ') as s from starts
    ), later as (
        select doc_id, i from (select *, min(doc_id) over (partition by s) as first from windows) where first < doc_id
    ), gone as (
        select doc_id, list(distinct k) as ks from (select doc_id, unnest(range(i, i + 13)) as k from later) group by 1
    ), joined as (
        select words.doc_id, w, coalesce(ks, []) as ks from words left join gone using (doc_id)
    ), kept as (
        select doc_id, w, ks, [w[k] for k in range(1, len(w) + 1) if not list_contains(ks, k)] as rest
        from joined
    )
    select doc_id, cast(len(w) as bigint) as n_words, cast(len(ks) as bigint) as n_removed,
           sha256(coalesce(array_to_string(rest, ' '), '')) as kept_sha256
    from kept"""

# Strings as hexadecimal digits; texts are cut into blocks first, as a long text is slow to look into.
CHECKS["op2_suffix_dedup"] = r"""
    with bytes as (
        select doc_id, hex(encode(coalesce(text, ''))) as h from documents
    ), blocks as (
        select doc_id, start, substr(h, 2 * start + 1, 2 * (64 + 99)) as part
        from (select doc_id, h, unnest(range(0, strlen(h) // 2, 64)) as start from bytes)
    ), strings as (
        select doc_id, start + i as i, md5(substr(part, 2 * i - 1, 200)) as s
        from (select doc_id, start, part, unnest(range(1, least(64, strlen(part) // 2 - 99) + 1)) as i from blocks)
    ), later as (
        select doc_id, i from strings
        qualify row_number() over (partition by s order by doc_id, i) > 1
    ), ends as (
        select doc_id, i, lag(i) over (partition by doc_id order by i) as before from later
    ), runs as (
        select doc_id, i, sum(case when i <= before + 100 then 0 else 1 end)
               over (partition by doc_id order by i) as run from ends
    ), spans as (
        select doc_id, min(i) as first, max(i) + 100 as last from runs group by doc_id, run
    ), pieces as (
        select doc_id, first, last, coalesce(lag(last) over (partition by doc_id order by first), 1) as upto from spans
    ), cut as (
        select doc_id, count(*) as n_spans, cast(sum(last - first) as bigint) as n_removed, max(last) as last,
               string_agg(substr(h, 2 * upto - 1, 2 * (first - upto)), '' order by first) as kept
        from pieces join bytes using (doc_id) group by doc_id
    )
    select doc_id, cast(strlen(h) // 2 as bigint) as n_bytes, coalesce(n_removed, 0) as n_removed,
           coalesce(n_spans, 0) as n_spans,
           sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 1) - 1))) as kept_sha256
    from bytes left join cut using (doc_id)"""

# All pairs with a common shingle, and all that links lead to: for small tables.
CHECKS["op4_hyperminhash"] = r"""
    with recursive words as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
    ), shingles as (
        select distinct doc_id, array_to_string(w[i:i + 3], ' ') as s
        from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from words where len(w) > 0)
    ), sizes as (
        select doc_id, count(*) as n from shingles group by 1
    ), common as (
        select a.doc_id as a, b.doc_id as b, count(*) as c
        from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2
    ), links as (
        select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b
        where 100 * c >= 80 * (x.n + y.n - c)
    ), reached as (
        select doc_id, doc_id as other from documents
        union
        select doc_id, b from reached join links on a = other
    ), components as (
        select doc_id, min(other) as component_id from reached group by 1
    )
    select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
    from components left join sizes using (doc_id)"""

CHECKS["op7_decontamination"] = r"""
    with docs as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
    ), items as (
        select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
    ), item_windows as (
        select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as s
        from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0)
    ), lengths as (
        select distinct n from item_windows
    ), doc_windows as (
        select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as s
        from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, lengths)
    ), found as (
        select doc_id, d.n, i, item_id from doc_windows d join item_windows using (s)
    ), hit as (
        select doc_id, count(distinct k) as n_hit
        from (select doc_id, unnest(range(i, i + n)) as k from found) group by 1
    ), named as (
        select doc_id, list_sort(list(distinct cast(item_id as varchar))) as names from found group by 1
    )
    select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
           cast(coalesce(len(names), 0) as bigint) as n_items,
           sha256(coalesce(array_to_string(names, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from docs left join hit using (doc_id) left join named using (doc_id)"""

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

CHECKS["op10_quality_rules"] = rf"""
    with words as (
        select doc_id, coalesce(text, '') as text,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
    ), grams as (
        select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
        from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from words)
    ), again as (
        select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from grams) where c > 1
    ), covered as (
        select doc_id, count(distinct k) as n from (select doc_id, unnest(range(i, i + 3)) as k from again) group by 1
    ), measured as (
        select doc_id, len(w) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
               length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
               [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as lines,
               coalesce(covered.n, 0) as n_repeat_words,
               len([x for x in w if lower(trim(x, '.,;:!?')) in ({_STOPS})]) as stops
        from words left join covered using (doc_id)
    ), counted as (
        select *, len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
               n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed
        from measured
    )
    select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
           cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
           cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
           not base_failed
           and not (word_chars < 2.5::double * n_words or word_chars > 12.0::double * n_words)
           and not n_symbols > 0.05::double * word_chars and not stops < 0.05::double * n_words
           and not n_dup_lines > 0.5::double * n_lines as kept
    from counted"""

CHECKS["op11_collocations"] = r"""
    with texts as (
        select coalesce(lang, 'und') as lang, doc_id,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
    ), pieces as (
        select lang, regexp_extract_all(p, '[^\x20\x09]+') as w
        from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as p from texts)
    ), grams as (
        select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase
        from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from pieces, (select unnest([1, 2, 3, 4]) as m)
              where len(w) >= m)
    ), counted as (
        select lang, m, phrase, count(*) as f from grams group by lang, m, phrase
    ), totals as (
        select lang, cast(sum(f) as bigint) as n from counted where m = 1 group by lang
    ), candidates as (
        select lang, m, phrase, f as a, string_split(phrase, ' ') as w from counted where m > 1 and f >= 30
    ), cuts as (
        select lang, phrase, a, k, array_to_string(w[1:k], ' ') as first, array_to_string(w[k + 1:m], ' ') as rest
        from (select *, unnest(range(1, m)) as k from candidates)
    ), scored as (
        select c.lang, c.phrase, a, k, x.f as l, y.f as r,
               cast((2000000 * cast(a as hugeint)) // (cast(x.f as hugeint) + y.f) as bigint) as score
        from cuts c join counted x on x.lang = c.lang and x.phrase = c.first
        join counted y on y.lang = c.lang and y.phrase = c.rest
    ), lowest as (
        select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
    ), inside as (
        select lang, a, array_to_string(w[i:i + s - 1], ' ') as phrase
        from (select lang, a, w, m, s, unnest(range(1, m - s + 2)) as i
              from candidates, (select unnest([2, 3]) as s) where s < m)
    ), around as (
        select lang, phrase, max(a) as longer from inside group by lang, phrase
    ), kept as (
        select l.* from lowest l left join around o on o.lang = l.lang and o.phrase = l.phrase
        where not coalesce(100 * longer >= 80 * a, false)
    )
    select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank,
           phrase, a, l, r, n, score
    from kept join totals using (lang) qualify rank <= 2000"""

# The checksum is computed bit by bit; periods are distances of equal windows of 16 words,
# which every run has.
CHECKS["op12_periodic_runs"] = r"""
    with words as (
        select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
               xor(4294967295, list_reduce(
                   list_prepend(4294967295, [cast(ord(x) as bigint) for x in string_split(cast(doc_id as varchar), '')]),
                   lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]),
                                            lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))) as h from documents
    ), seeds as (
        select doc_id, w, h, len(w) as n, h // 10 as g from words
    ), places as (
        select doc_id, w, h, n, case when n > 0 then g % n else 0 end as a, 3 + g % 8 as k from seeds
    ), texts as (
        select doc_id, n, case when h % 10 = 0 and n > 0
               then [w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // k) end] for i in range(n)]
               else w end as w from places
    ), grams as (
        select doc_id, i, array_to_string(w[i + 1:i + 16], ' ') as s
        from (select doc_id, w, unnest(range(len(w) - 15)) as i from texts where len(w) >= 24)
    ), pairs as (
        select a.doc_id, a.i, b.i - a.i as q from grams a join grams b on a.doc_id = b.doc_id and a.s = b.s and a.i < b.i
    ), islands as (
        select doc_id, q, min(i) as start, max(i) - min(i) + 16 + q as length
        from (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as g from pairs)
        group by doc_id, q, g
    ), runs as (
        select doc_id, start, length, min(q) as period from islands where length >= greatest(24, 3 * q)
        group by doc_id, start, length
    ), dropped as (
        select doc_id, list(distinct k) as ks
        from (select doc_id, unnest(range(start + period, start + length)) as k from runs) group by doc_id
    ), found as (
        select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period)
               as lines, arg_min([start, length, period], [-(cast(length as double) / period), start, period]) as best
        from runs group by doc_id
    )
    select doc_id, coalesce(n_runs, 0) as n_runs, best[1] as start, best[2] as length, best[3] as period,
           1000 * best[2] // best[3] as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256,
           sha256(coalesce(array_to_string(
               [w[k + 1] for k in range(n) if not list_contains(coalesce(ks, []), k)], ' '), '')) as collapsed_sha256
    from texts left join found using (doc_id) left join dropped using (doc_id)"""


def _quoted(value: str) -> str:
    """A string for SQL; what is not printable as chr()."""
    parts = [f"chr({ord(c)})" if ord(c) < 32 else "'" + c.replace("'", "''") + "'" for c in value]
    return "(" + " || ".join(parts) + ")"


_TEXT = f"regexp_replace(body, '{warc.HIDDEN}', ' ', 'g')"
_TEXT = f"regexp_replace(regexp_replace({_TEXT}, '{warc.BLOCKS}', chr(10), 'g'), '{warc.TAGS}', '', 'g')"
for _entity, _character in warc.ENTITIES.items():
    _TEXT = f"replace({_TEXT}, {_quoted(_entity)}, {_quoted(_character)})"
_TEXT = rf"regexp_replace(regexp_replace({_TEXT}, '[\t\r\x0B\x0C\x{{A0}}]', ' ', 'g'), ' +', ' ', 'g')"
_TEXT = rf"trim(regexp_replace({_TEXT}, ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"
_ID = (
    "'<urn:uuid:' || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-'"
    " || substr(m, 17, 4) || '-' || substr(m, 21, 12) || '>'"
)

CHECKS["op3_warc_derivatives"] = rf"""
    with pages_ as (
        select page_id, url, coalesce(html, '') as body, chr(13) || chr(10) as nl,
               md5('response|' || coalesce(cast(page_id as varchar), '') || '|' || coalesce(url, '')) as m
        from pages
    ), responses as (
        select page_id, url, body, nl, {_ID} as refers_to, 'sha256:' || sha256(body) as payload_digest,
               trim(regexp_replace(regexp_extract(body, '{warc.TITLE}', 1), '\s+', ' ', 'g')) as title
        from pages_
    ), blocks as (
        select page_id, url, nl, refers_to, payload_digest, 'metadata' as record_type,
               'application/warc-fields' as content_type,
               'source-header: HTTP/1.1 200 OK' || nl || 'source-header: Content-Type: text/html; charset=utf-8' || nl
               || 'source-header: Content-Length: ' || strlen(body) || nl
               || 'source-payload-digest: ' || payload_digest || nl
               || case when title <> '' then 'title: ' || regexp_replace(title, '{warc.CONTROL}', '', 'g') || nl else '' end
               || array_to_string(['outlink: ' || regexp_replace(x, '{warc.CONTROL}', '', 'g') || nl for x in regexp_extract_all(body, '{warc.LINKS}', 1)], '')
               as block
        from responses
        union all
        select page_id, url, nl, refers_to, payload_digest, 'conversion', 'text/plain; charset=utf-8', {_TEXT}
        from responses
    ), named as (
        select *, md5(record_type || '|' || refers_to) as m, 'sha256:' || sha256(block) as block_digest from blocks
    ), records as (
        select *, {_ID} as record_id, cast(strlen(block) as bigint) as content_length from named
    )
    select page_id, record_type, record_id, refers_to, url as target_uri, content_type, content_length, block_digest,
           payload_digest,
           sha256('{warc.VERSION}' || nl || 'WARC-Type: ' || record_type || nl || 'WARC-Record-ID: ' || record_id || nl
                  || 'WARC-Refers-To: ' || refers_to || nl || coalesce('WARC-Target-URI: ' || regexp_replace(url, '{warc.CONTROL}', '', 'g') || nl, '')
                  || 'WARC-Date: {warc.DATE}' || nl || 'WARC-Block-Digest: ' || block_digest || nl
                  || 'Content-Type: ' || content_type || nl || 'Content-Length: ' || content_length || nl || nl
                  || block || nl || nl) as record_sha256
    from records"""
