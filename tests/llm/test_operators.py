"""Operators for training data against brute force, on small tables that hold the awkward cases."""

import base64
import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from agoralens.llm import hash_ring, hyperminhash, packing, quality_rules, queries, token_counts, warc
from agoralens.llm.bpe import Encoder, decode, encode
from agoralens.llm.components import components
from agoralens.llm.decontamination import decontaminate
from agoralens.llm.first_windows import first_windows
from agoralens.llm.identifiers import sliding, words_of
from agoralens.llm.substring_dedup import remove_repeated_windows
from agoralens.llm.suffix_dedup import remove_repeated_strings

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
# Columns whose names clash with those of results and of inner steps.
SCHEMA = "doc_id long, text string, kept string, n_words string, `row` string, chunk int, ids string, `a b` int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def awkward(seed):
    """Shared passages, copies, near copies, short, empty and null texts, repeated rows, rows without an id."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "ab éü" for b in "xyzw"]
    passage = [rng.choice(words) + str(i) for i in range(40)]
    rows = []
    for i in range(60):
        own = [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 12, 13, 14, 30, 120]))]
        at = rng.randint(0, len(own))
        own[at:at] = passage[rng.randint(0, 20) :][: rng.choice([0, 0, 5, 13, 16])]
        rows.append((i * 7 % 61, rng.choice([" ", "\t", "  \n"]).join(own)))
    base = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(200))
    rows += [(100 + i, base.replace(base.split()[20 * i], f"Other{i}")) for i in range(8)]
    rows += [(200, rows[5][1]), (201, rows[5][1]), (300, None), (301, ""), (302, " \n"), (303, "a" * 350), (304, "ab" * 150)]
    rows += [rows[7], rows[7], (rows[8][0], "another text of an id that is there " * 6), (None, base), (None, None)]
    rows.append((400, "x " * 3000 + base))
    return rows


@pytest.fixture
def table(spark):
    queries.settings(spark)

    def make(rows):
        return spark.createDataFrame([(i, t, "k", "n", "r", 1, "i", 2) for i, t in rows], SCHEMA)

    return make


def order(key):
    return 2**63 if key is None else key


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


# Substrings


def brute_windows(rows):
    first = {}
    words = [SPACED.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, words, strict=True):
        for j in range(len(w) - 12):
            s = tuple(w[j : j + 13])
            first[s] = min(first.get(s, 2**64), order(i))
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < order(i):
                gone[j : j + 13] = [True] * 13
        yield i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_against_brute_force(table, seed):
    rows = awkward(seed)
    found = remove_repeated_windows(table(rows)).select("row.doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted_rows(found) == sorted_rows(brute_windows(rows))


def brute_strings(rows):
    places = defaultdict(list)
    texts = [(t or "").encode() for _, t in rows]
    for k, data in enumerate(texts):
        for j in range(len(data) - 99):
            places[data[j : j + 100]].append((order(rows[k][0]), k, j))
    for k, data in enumerate(texts):
        mine, gone = order(rows[k][0]), [False] * len(data)
        for j in range(len(data) - 99):
            if any(i < mine or (m == k and p < j) for i, m, p in places[data[j : j + 100]]):
                gone[j : j + 100] = [True] * 100
        runs = sum(g for g, _ in itertools.groupby(gone))
        yield rows[k][0], len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone, strict=True) if not g)


@pytest.mark.parametrize("seed", [1, 2])
def test_strings_against_brute_force(table, seed):
    rows = awkward(seed)
    found = remove_repeated_strings(table(rows)).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    found = [(*r[:4], bytes(r[4])) for r in found.collect()]
    assert sorted_rows(found) == sorted_rows(brute_strings(rows))


def test_strings_do_not_depend_on_chunks(table):
    from agoralens.llm import suffix_dedup as S

    rows = awkward(3)
    result = "n_bytes long, n_removed long, n_spans long, kept binary, kept_text string"
    steps = (S._ask_anchors, S._ask_windows, S._verdict, result)
    small = first_windows(table(rows), "doc_id", "text", *steps, chunk_bytes=500)
    found = [(*r[:4], bytes(r[4])) for r in small.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()]
    assert sorted_rows(found) == sorted_rows(brute_strings(rows))


def test_kept_text_has_whole_characters(table):
    shared = "".join(chr(97 + i % 26) + str(i) for i in range(40))[:99]
    rows = [(1, shared + "è"), (2, shared + "é and more"), (3, None), (4, "é" * 60)]
    found = remove_repeated_strings(table(rows)).select(F.col("row.doc_id").alias("id"), "kept", "kept_text").collect()
    by = {r.id: r for r in found}
    assert bytes(by[2].kept) == b"\xa9 and more" and by[2].kept_text == " and more"
    assert by[1].kept_text == shared + "è" and by[3].kept_text is None and by[4].kept_text == "é"


def test_words_and_sliding():
    texts = ["", " a bb\tccc", "x", "\n", "a"]
    data = "".join(texts).encode()
    starts = np.cumsum([0, *map(len, texts)])
    at, ends, ids, counts = words_of(np.frombuffer(data, np.uint8), starts)
    assert [data[s:e] for s, e in zip(at, ends, strict=True)] == [b"a", b"bb", b"ccc", b"x", b"a"]
    assert counts.tolist() == [0, 3, 1, 0, 1] and ids[0] == ids[4] and len(set(ids.tolist())) == 4
    values = np.random.default_rng(0).integers(0, 99, 300)
    for width in (1, 2, 7, 69):
        expected = [values[i : i + width].min() for i in range(300 - width + 1)]
        assert sliding(values, width, np.minimum).tolist() == expected


# Near duplicates


def brute_components(rows):
    def shingles(text):
        w = SPACED.findall(lower(text))
        return frozenset(tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, _), (j, _), a, b in ((rows[x], rows[y], sets[x], sets[y]) for x in range(len(rows)) for y in range(x)):
        if None not in (i, j) and a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    for (i, _), s in zip(rows, sets, strict=True):
        found = None if i is None else root(i)
        yield i, len(s), found, i is None or i == found


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_brute_force(table, seed):
    rows = awkward(seed)
    assert sorted_rows(hyperminhash.near_duplicates(table(rows)).collect()) == sorted_rows(brute_components(rows))


def test_chains_and_torn_buckets(table):
    """Texts around one base, alike to some and not to others, so that a bucket's first key does not link them all."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        own = list(base)
        for j in rng.sample(range(150), rng.choice([2, 4, 6, 8])):
            own[j] = f"v{rng.randint(0, 10**9)}"
        rows.append((i, " ".join(own)))
    assert sorted_rows(hyperminhash.near_duplicates(table(rows)).collect()) == sorted_rows(brute_components(rows))


def test_register_estimate():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64)) for _ in range(2))
    both = np.concatenate([a[:2400], b[:200]])
    true = len(np.intersect1d(a, both)) / len(np.union1d(a, both))
    found = hyperminhash.similarity(hyperminhash.registers(a), hyperminhash.registers(both), len(a), len(both))
    assert abs(found - true) < 0.1
    assert abs(hyperminhash.similarity(hyperminhash.registers(a), hyperminhash.registers(b), 3000, 3000)) < 0.02


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(50)] + [(rng.randint(60, 200), rng.randint(60, 200)) for _ in range(60)]
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    linked = {x for a, b in links if a != b for x in (a, b)}
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert dict(map(tuple, found)) == {x: root(x) for x in linked} and len(found) == len(linked)


# Tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(queries.WORD_BPE))


def test_bpe_round_trip(table, library):
    rng = random.Random(6)
    letters = list("abcXYZ éÉßİŞşΣσ12½²'sStT\t\n\x0b\x1c\x85\xa0 —’…日本語🙂́ﬁͅǅ")
    letters += ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "the ", "don't", "‍", "Σ "]
    rows = [(i, "".join(rng.choices(letters, k=rng.randint(0, 30)))) for i in range(500)]
    rows += [(900, None), (901, "a" * 5000), (902, "<|endoftext|>"), (None, "x")]
    out = encode(table(rows), public_tokenizers.path(queries.WORD_BPE))
    again = decode(out.drop("decoded"), public_tokenizers.path(queries.WORD_BPE)).select("doc_id", "decoded")
    assert set(out.columns) == set(table(rows).columns) | {"decoded"}
    found = [(r.doc_id, bytes(r.ids), r.decoded) for r in out.collect()]
    expected = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((i, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert sorted_rows(found) == sorted_rows(expected)
    assert sorted_rows(again.collect()) == sorted_rows((i, d) for i, _, d in expected)


def test_fragments_are_cut_only_where_no_token_spans(library):
    with open(public_tokenizers.path(queries.WORD_BPE), encoding="utf-8") as file:
        encoder = Encoder(file.read())
    assert ("t", "h") in encoder.inside and not encoder.fragments
    word = "zqxjkvwqzé"
    ids = np.frombuffer(encoder[word], "<u4").tolist()
    assert ids == library.encode(word, add_special_tokens=False).ids and encoder.fragments


def test_token_counts_against_greedy(table):
    pieces = token_counts.sentencepiece_pieces(public_tokenizers.path(queries.PIECES))
    known, longest = set(pieces), max(map(len, pieces))

    def greedy(word):
        rest, n = token_counts.FIRST + word, 0
        while rest:
            size = next((k for k in range(min(longest, len(rest)), 0, -1) if rest[:k] in known), 0)
            if not size:
                return 0
            rest, n = rest[size:], n + 1
        return n

    rows = [*awkward(1), (500, "tokenization unbelievable ͸ internationalisation 日本語 x͸y"), (501, "ab" * 4000)]
    found = token_counts.count_tokens(table(rows), pieces).select("doc_id", "n_words", "n_tokens", "n_unknown")
    expected = []
    for i, text in rows:
        counts = [greedy(w) for w in SPACED.findall(text or "")]
        none = counts.count(0)
        expected.append((i, len(counts), sum(counts) + none, none))
    assert sorted_rows(found.collect()) == sorted_rows(expected)


def test_small_automaton_against_greedy():
    rng = random.Random(7)
    for _ in range(200):
        pieces = {"".join(rng.choices("ab", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 6))}
        pieces |= {token_counts.FIRST + p for p in rng.sample(sorted(pieces), 1)}
        automaton = token_counts.Automaton(pieces)
        for _ in range(20):
            word = "".join(rng.choices("ab", k=rng.randint(1, 8)))
            rest, n = token_counts.FIRST + word, 0
            while rest:
                size = max((len(p) for p in pieces if rest.startswith(p)), default=0)
                if not size:
                    n = 0
                    break
                rest, n = rest[size:], n + 1
            assert automaton.count(word) == n


def test_packing_is_lossless(table):
    rng = random.Random(8)
    rows = [(i, rng.randbytes(4 * rng.choice([0, 1, 5, 63, 64, 65, 200]))) for i in range(80)] + [(80, None), (None, b"\1\0\0\0")]
    df = table([]).sparkSession.createDataFrame(rows, "doc_id long, own binary")
    packed = packing.pack(df, packing.binary_ids, "own", (1 << 32) - 1, length=64, packed_tokens=2000).collect()
    assert len({(r["pack"], r["row"]) for r in packed}) == len(packed)
    parts = defaultdict(dict)
    for r in packed:
        ids, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(positions) == 64 and r.segments[0] == 0 and r.segments[-1] == r.n_tokens
        for d, o, s, e in zip(r.documents, r.offsets, r.segments, r.segments[1:], strict=False):
            assert positions[s:e].tolist() == list(range(e - s))
            parts[d][o] = ids[s:e].tobytes()
    back = {d: b"".join(p[o] for o in sorted(p)) for d, p in parts.items()}
    assert back == {i: t or b"" for i, t in rows}


def test_best_fit():
    rng = random.Random(9)
    sizes = [rng.randint(0, 50) for _ in range(300)]
    rows = packing.best_fit(sizes, 50)
    plain, free = [], []
    for item in sorted(range(300), key=lambda i: (-sizes[i], i)):
        fits = [k for k in range(len(free)) if free[k] >= sizes[item]]
        if not fits:
            plain.append([])
            free.append(50)
            fits = [len(free) - 1]
        best = min(fits, key=lambda k: free[k])
        plain[best].append(item)
        free[best] -= sizes[item]
    assert sorted(i for row in rows for i in row) == list(range(300))
    assert Counter(sum(sizes[i] for i in row) for row in rows) == Counter(50 - f for f in free)


# Benchmark passages, quality, shards, archives


def brute_hits(rows, items):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))

    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(len(w), 10)
        for j in range(len(w) - n + 1 if n and item is not None else 0):
            windows[tuple(w[j : j + n])].add(str(item))
    for i, text in rows:
        w = words(text)
        hit, names = set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (own := tuple(w[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    names |= windows[own]
        yield i, len(w), len(hit), sorted(names), bool(hit)


def test_decontamination_against_brute_force(table, spark):
    rows = awkward(1)
    rng = random.Random(10)
    base = SPACED.findall(rows[60][1])
    items = [(1, " ".join(base[5:25])), (2, " ".join(base[10:20])), (10, "One two, three"), (11, ""), (12, None), (13, "x")]
    items += [(None, " ".join(base[:12])), (14, "é-é"), (2, "zz top")]
    for k in range(12):
        own = base[rng.randint(0, 100) :][: rng.randint(8, 30)]
        rows.append((600 + k, "Noise, " + ("! ".join(own)).upper() + " one TWO three zz top é é"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate(table(rows), bench)
    assert set(table(rows).columns) < set(found.columns)
    names = ["benchmark_n_words", "benchmark_n_hit", "benchmark_items", "benchmark_contaminated"]
    assert sorted_rows(found.select("doc_id", *names).collect()) == sorted_rows(brute_hits(rows, items))
    none = decontaminate(table(rows).select("doc_id", "text"), bench.limit(0)).agg(F.sum("n_hit")).first()[0]
    assert none == 0


def test_quality_rules(table):
    prose = "the cat and the dog ran to a house by the sea where it was cold for all of us in march " * 3
    varied = " ".join(f"{w}{i} the" for i, w in enumerate(prose.split()))
    rows = [
        (1, varied), (2, None), (3, ""), (4, prose * 4), (5, varied.replace(" the", " ##&&")), (6, varied.replace(" the", " zz")),
        (7, "\n".join([*varied.split()[:60], *["one line of it"] * 70])), (8, "a b c a b c x a b c"), (9, "w" * 3000 + " the" * 60),
    ]
    found = quality_rules.apply_quality_rules(table(rows))
    by = {r.doc_id: r for r in found.collect()}
    assert by[1].quality_kept and by[1].n_words == "n"
    assert [i for i in by if by[i].quality_base_failed] == [2, 3, 4, 7, 8, 9]
    assert by[8].quality_n_repeat_words == 9 and by[2].quality_n_words == 0
    assert by[5].quality_failed_rules[0] == "symbols" and by[6].quality_failed_rules == ["stop_words"]
    for i, text in rows:
        w = SPACED.findall(text or "")
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        assert by[i].quality_n_repeat_words == len(again) and by[i].quality_word_chars == sum(map(len, w))


def test_shards(table):
    rows = [(i, "t" * (i % 50)) for i in range(1000)] + [(None, None)] * 40 + [(5, "same")] * 30
    found = hash_ring.shard_rows(table(rows), 24).collect()
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert len(found) == len(rows) and {len(s) for s in slots.values()} == {44, 45}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    expected = Counter((i, len(t or "") + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == expected


def test_walk_round_the_ring():
    """The same as offering single rows to the points, round by round."""
    rng = random.Random(11)
    owners = [rng.randint(0, 4) for _ in range(20)] + [0, 1, 2, 3, 4]
    arcs = {a: rng.choice([0, 1, 7, 40]) for a in range(25)}
    rows = sum(arcs.values())
    room = [rows // 5 + (s < rows % 5) for s in range(5)]
    place, waiting = {}, [[(a, k) for k in range(arcs[a])] for a in range(25)]
    while any(waiting):
        following = [[] for _ in owners]
        for point, offered in enumerate(waiting):
            for one in offered:
                if room[owners[point]]:
                    room[owners[point]] -= 1
                    place[one] = owners[point]
                else:
                    following[(point + 1) % 25].append(one)
        waiting = following
    found = {(a, k): s for a, lo, hi, s, _ in hash_ring.walk(arcs, owners, 5) for k in range(lo, hi)}
    assert found == place


def test_few_rows_move(table):
    df = table([(i, str(i)) for i in range(5000)])
    old, new = ({r.doc_id: r.shard for r in hash_ring.shard_rows(df, n).collect()} for n in (24, 25))
    moved = sum(old[i] != new[i] for i in old)
    assert sum(s == 24 for s in new.values()) == 200 and moved < 5000 * 0.1


def test_archive_records(table, spark):
    pages = spark.createDataFrame(
        [(1, "http://a", '<title> A  b </title><p>One &amp; <b>two</b><script>x="</p>"</script><br>three<a href="/l">l</a>'),
         (2, None, None), (None, "http://c", ""), (1, "http://a", "other")],
        "page_id long, url string, html string",
    )
    records = warc.derivatives(warc.page_responses(pages).withColumn("record_type", F.lit("response"))).collect()
    assert len(records) == 8 and Counter(r.record_type for r in records) == {"metadata": 4, "conversion": 4}
    text = next(r for r in records if r.record_type == "conversion" and r.block.startswith("A b"))
    assert text.block == "A b\nOne & two\nthreel"
    meta = next(r for r in records if r.record_type == "metadata" and "outlink" in r.block)
    assert meta.refers_to == text.refers_to and meta.record_id != text.record_id
    assert meta.block.splitlines()[0] == "source-header: HTTP/1.1 200 OK" and "title: A b" in meta.block
    for r in records:
        head, block = r.record.split("\r\n\r\n", 1)
        assert head.startswith("WARC/1.1\r\n") and f"WARC-Refers-To: {r.refers_to}" in head
        assert f"Content-Length: {len(r.block.encode())}" in head and block == r.block + "\r\n\r\n"
        assert r.block_digest == "sha256:" + sha(r.block) and ("Target-URI" in head) == (r.target_uri is not None)
    plain = spark.createDataFrame([("<r>", None, "d", None), ("<s>", "u", "d", "HTTP/1.1 204 No Content")],
                                  "record_id string, target_uri string, date string, block string")
    assert [r.content_length for r in warc.derivatives(plain).filter("record_type = 'conversion'").collect()] == [0, 0]


def test_thresholds_of_the_rules(table):
    """Values on a threshold pass, those one step beyond fail."""
    def text(words, symbols=0, stops=10, lines=()):
        own = [f"w{i:05d}" for i in range(words - stops)] + ["the"] * stops
        own = [w for pair in itertools.zip_longest(own[: words - stops], own[words - stops :]) for w in pair if w]
        return "\n".join([" ".join(own) + "#" * symbols, *lines])

    cases = {}
    for i, (words, stops) in enumerate([(49, 10), (50, 10), (200, 10), (200, 9), (200, 11)]):
        cases[i] = text(words, stops=stops)
    rows = list(cases.items())
    by = {r.doc_id: r for r in quality_rules.apply_quality_rules(table(rows)).collect()}
    assert [by[i].quality_base_failed for i in range(5)] == [True, False, False, False, False]
    assert [by[i].quality_kept for i in range(1, 5)] == [True, True, False, True]
    symbols = []
    for k in range(200):  # 5 % of the characters in words, which the symbols are part of, too
        t = text(60, symbols=k)
        chars, n = len("".join(t.split())), k
        symbols.append((1000 + k, t, n * 20 <= chars))
    by = {r.doc_id: r.quality_kept for r in quality_rules.apply_quality_rules(table([s[:2] for s in symbols])).collect()}
    assert by == {i: ok for i, _, ok in symbols} and {ok for _, _, ok in symbols} == {True, False}


def test_packed_rank_ids(table, spark):
    """What the query packs: ids of the rank file, lossless, repeated rows each time."""
    import tiktoken

    path = public_tokenizers.path(queries.RANKS)
    tokens = packing.RankIds(spark, path, public_tokenizers.PATTERN)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["word", "ünï", "😀", "x" * 30, "12 3"]) for _ in range(rng.choice([0, 1, 40, 900])))) for i in range(40)]
    rows += [rows[3], rows[3], (None, "no id"), (None, None), (7, "another text of the same id")]
    packed = packing.pack(table(rows), tokens, "text", tokens.vocabulary).collect()
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))})
    size = packing.LENGTH
    expected = Counter()
    for key, text in rows:
        own = library.encode_ordinary(text or "")
        expected.update((key, at, tuple(own[at : at + size])) for at in range(0, max(len(own), 1), size))
    found = Counter()
    for r in packed:
        ids = np.frombuffer(r.ids, "<u2").tolist()
        assert len(ids) == size and set(ids[r.segments[-1] :]) <= {tokens.vocabulary}
        for k, (document, at) in enumerate(zip(r.documents, r.offsets, strict=True)):
            found[document, at, tuple(ids[r.segments[k] : r.segments[k + 1]])] += 1
    assert found == expected


def test_values_can_not_forge_lines(spark):
    page = '<a href="http://x/\r\nWARC-Type: response\n">l</a><!-- never closed <b>t</b>' + "<!--" * 20_000
    pages = spark.createDataFrame([(1, "http://a\r\nWARC-Type: x", page)], "page_id long, url string, html string")
    start = time.perf_counter()
    meta, conversion = sorted(warc.derivatives(warc.page_responses(pages)).collect(), key=lambda r: r.record_type)[::-1]
    assert time.perf_counter() - start < 30 and conversion.block == "l"
    assert "outlink: http://x/WARC-Type: response\r\n" in meta.block
    assert meta.record.split("\r\n\r\n")[0].count("\r\nWARC-Type: ") == 1
    assert "WARC-Target-URI: http://aWARC-Type: x\r\n" in meta.record


def test_empty_tables(table, spark):
    none = table([])
    path = public_tokenizers.path(queries.WORD_BPE)
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    results = [
        remove_repeated_windows(none), remove_repeated_strings(none), warc.derivatives(warc.page_responses(pages)),
        hyperminhash.near_duplicates(none), token_counts.count_tokens(none, ["▁a"]), encode(none, path),
        decontaminate(none, bench), hash_ring.shard_rows(none, 24), packing.pack(none, packing.binary_ids, "text", 10),
        quality_rules.apply_quality_rules(none),
    ]
    assert [r.collect() for r in results] == [[]] * 10
