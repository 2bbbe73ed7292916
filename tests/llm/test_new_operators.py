"""Collocations, periodic runs, byte-level BPE and ranked merges against brute force and the tokenizers libraries."""

import hashlib
import random
import re
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from agoralens.llm import byte_bpe, collocations, hyperminhash, queries
from agoralens.llm.bpe import Encoder
from agoralens.llm.merges import merge_ranked
from agoralens.llm.periodic_runs import find_runs, repetitive, runs_of
from agoralens.llm.suffix_tree import SuffixTree

RANKS = public_tokenizers.path(queries.RANKS)
# Has to outlive what is allocated from it.
POOL = pa.proxy_memory_pool(pa.default_memory_pool())
# Columns whose names clash with those of results and of inner steps.
SCHEMA = "doc_id long, text string, lang string, n string, `row` string, runs int, ids string, `a b` int, words string"


@pytest.fixture
def table(spark):
    queries.settings(spark)

    def make(rows):
        return spark.createDataFrame([(i, t, g, "n", "r", 1, "i", 2, "w") for i, t, g in rows], SCHEMA)

    return make


# Collocations


def brute_collocations(rows, least, top):
    counts, words = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\v\f\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            words[lang] += len(w)
            for size in range(1, 5):
                for i in range(len(w) - size + 1):
                    counts[lang][tuple(w[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        for phrase, a in f.items():
            if len(phrase) == 1 or a < least:
                continue
            longer = [b for q, b in f.items() if len(q) > len(phrase) and b >= least
                      and any(q[i : i + len(phrase)] == phrase for i in range(len(q)))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            cuts = [(2000000 * a // (f[phrase[:k]] + f[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -s))
    return sorted(out)


def phrases(seed):
    rng = random.Random(seed)
    rows = []
    vocabulary = [f"{a}{b}" for a in ["new", "old", "é", "x-y", "İ"] for b in ["", "York", "s", "ü"]]
    for i in range(70):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", " \v"]) for _ in range(rng.choice([0, 1, 5, 60])))
        rows.append((i, text, rng.choice(["en", "de", None, "und"])))
    rows += [(100, None, "en"), (101, "", "fr"), (102, "a " * 500 + "b", "en"), (103, "...", "xx"), rows[5], rows[5], rows[5]]
    rows += [(None, "one two three four five. " * 12, "en"), (104, " ".join(["lorem ipsum"] * 40), None)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations_against_brute_force(table, seed):
    rows = phrases(seed)
    for part_bytes in (collocations.PART_BYTES, 200):
        found = collocations.collocations(table(rows), least=6, top=25, part_bytes=part_bytes)
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, found.collect())) == brute_collocations(rows, 6, 25)


def test_chunks_hold_each_phrase_once():
    import pyarrow as pa

    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randint(0, 200)}" for _ in range(300)).replace("7 ", "7. ") for _ in range(5)] + ["", None]
    chunks = list(collocations._chunks(pa.array(texts)))
    assert len(chunks) > 40 and {r for r, _ in chunks} == set(range(5))
    for row in range(5):
        own = b" ".join(re.split(rb"\v", c)[0].replace(b"\n", b" ") for r, c in chunks if r == row)
        assert own == texts[row].replace(".", "").encode()
    again = list(collocations._chunks(pa.array(["w5 w6 " + texts[0]])))
    assert len({c for _, c in again} & {c for r, c in chunks if r == 0}) >= len(again) - 2  # cut alike wherever it stands


def test_collocations_with_small_blocks(table, monkeypatch):
    rows = phrases(3)
    for size in (1, 40):
        monkeypatch.setattr(collocations, "BLOCK_BYTES", size)
        monkeypatch.setattr(collocations, "BLOCK_ROWS", size)
        chunks = pa.Table.from_batches(collocations._parsed(iter([pa.record_batch({
            "lang": [g or "und" for _, _, g in rows], "text": [t for _, t, _ in rows]})]), 1))
        part = collocations._Part(chunks, 1)
        answers = {0: collocations._frequent(part.ask(6), 6)["data"][0].as_py()}
        found = part.phrases(answers).to_pylist()
        df = table(rows).sparkSession.createDataFrame([tuple(r.values()) for r in found], collocations.COUNTED).filter("a >= 6 or size = 0")
        assert sorted(map(tuple, collocations._ranked(df, 80, 25).select(
            "lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == brute_collocations(rows, 6, 25)


def test_memory_of_a_part():
    """The words of a part take a few times its bytes, whatever is made of them on the way."""
    rng = random.Random(6)
    vocabulary = [f"word{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(400)) for _ in range(1500)]
    chunks = pa.Table.from_batches(collocations._parsed(iter([pa.record_batch({"lang": ["en"] * len(texts), "text": texts})]), 1))
    size = pc.sum(pc.binary_length(chunks["chunk"])).as_py()
    frequent = collocations._frequent(collocations._Part(chunks, 1).ask(30), 30)["data"][0].as_py()
    for run in (lambda p: p.ask(30), lambda p: p.phrases({0: frequent})):
        tracemalloc.start()
        run(collocations._Part(chunks, 1))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 13 * size, peak / size


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits."""
    big = 9 * 10**13
    rows = [("en", 2, "a b", big), ("en", 1, "a", big + 7), ("en", 1, "b", big + 1), ("en", 0, "", 5 * 10**15)]
    counted = spark.createDataFrame(rows, "lang string, size int, phrase string, a long")
    row = collocations._ranked(counted, 80, 10).first()
    assert (row.score, row.l, row.r, row.n) == (2000000 * big // (2 * big + 8), big + 7, big + 1, 5 * 10**15)


# Periodic runs


def brute_runs(w, least=24, times=3):
    out = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, times * p):
                out.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((start, length, p) for (start, length), p in out.items())


def periodic(rng):
    k, w = rng.randint(1, 5), []
    for _ in range(rng.randint(1, 8)):
        base = [rng.choice("abcdefgh"[:k]) for _ in range(rng.randint(1, 14))]
        w += [base[i % len(base)] for i in range(rng.randint(1, 60))] if rng.random() < 0.6 else base
    return w


def test_runs_against_brute_force(table):
    rng = random.Random(6)
    words = [periodic(rng) for _ in range(400)] + [[], ["a"] * 23, ["a"] * 24, ["x", "y"] * 5000, list("ab" * 12) + ["b"]]
    rows = [(i, "\n \t"[i % 3].join(w), "en") for i, w in enumerate(words)] + [(900, None, None), (901, " \n ", "x"), (None, "a " * 30, "x")]
    found = {r.doc_id: r for r in find_runs(table(rows + rows[:2])).collect()}
    assert len(found) == len(rows) and found[900].collapsed == found[901].collapsed == "" and found[901].n_words == 0
    for i, w in enumerate(words):
        expected = brute_runs(w)
        assert [tuple(r) for r in found[i].runs] == expected
        gone = {k for start, length, p in expected for k in range(start + p, start + length)}
        assert found[i].collapsed == " ".join(x for k, x in enumerate(w) if k not in gone) and found[i].n == "n"


def test_runs_with_other_bounds():
    rng = random.Random(8)
    for _ in range(300):
        w = np.array([ord(c) for c in periodic(rng)], np.uint64)
        assert runs_of(w, 4, 2) == brute_runs(w.tolist(), 4, 2)
        for start, length, _ in brute_runs(w.tolist()):
            assert any(a <= start and start + length <= b for _, a, b in repetitive(w, np.array([len(w)]), 16))


def test_suffix_tree_against_sorting():
    rng = random.Random(9)
    for _ in range(200):
        s = [rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(1, 60))]
        tree, n = SuffixTree(np.array(s)), len(s)
        assert tree.sorted.tolist() == sorted(range(n + 1), key=lambda i: s[i:])
        assert np.argsort(tree.ranks(True)).tolist() == sorted(range(n + 1), key=lambda i: [-x for x in s[i:]])
        i, j = np.triu_indices(n + 1, 1)
        common = [next((k for k in range(n - b + 1) if b + k == n or s[a + k] != s[b + k])) for a, b in zip(i, j, strict=True)]
        assert tree.extension(i, j).tolist() == common


def test_planted_runs_are_found(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: r for r in queries.with_planted_runs(documents).collect()}
    import zlib

    for r in documents.collect():
        h = zlib.crc32(str(r.doc_id).encode())
        words, n = (r.text or "").encode().split(), len((r.text or "").encode().split())
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            assert rows[r.doc_id].text.encode().split() == [words[i if i < a else a + (i - a) % p] for i in range(n)]
        else:
            assert rows[r.doc_id].text == r.text


# Byte pairs


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_byte_bpe_against_the_library(table, reference):
    rng = random.Random(1)
    alphabet = ["a", "e", "the", " ", "  ", "\n", "\t", "é", "ß", "'s", "'t", "1", "２", "½", "漢", "字", "😀", "　", "\x85", "\xa0", "‍",
                "_", "-", "...", "\U00010570", "\U000116d0", "ǅ", "\x1c", "q", "<|endoftext|>", "\x00", "�"]
    texts = [None, "", " ", "a" * 300, "acgt" * 200, "x" * 129, "é" * 70, " " * 500 + "b", "ab" * 5000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(500)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "the cat", None), (5, "the cat", "x"), (5, "the cat", "x")]
    coded = byte_bpe.encode(table(rows), RANKS, public_tokenizers.PATTERN, ids="tokens")
    found = byte_bpe.decode(coded, RANKS, ids="tokens").collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter((i, t) for i, t, _ in rows) and found[0].ids == "i"
    for r in found:
        expected = reference.encode_ordinary(r.text or "")
        assert r.tokens == expected and bytes(r.packed_ids) == b"".join(i.to_bytes(4, "little") for i in expected)
        assert bytes(r.decoded) == (r.text or "").encode() == reference.decode_bytes(expected)


def test_byte_bpe_without_frequent_words(table, reference, monkeypatch):
    rows = [(i, f"words word{i % 7} again wordsandwords{i} " * 3, "en") for i in range(40)]
    for limit in (0, 3):
        monkeypatch.setattr(byte_bpe, "FREQUENT", limit)
        for r in byte_bpe.encode(table(rows), RANKS, public_tokenizers.PATTERN, ids="t", keep=["text"]).collect():
            assert r.t == reference.encode_ordinary(r.text)


def test_blocks_hold_no_table_of_the_frequent_words():
    """A worker has the frequent words as they were sent; what a block adds to them is smaller."""
    known = pa.array([f" frequent{i}" for i in range(200_000)])
    texts = [[" frequent7", " rare", " frequent199999", " rare"], [], [" frequent7", " rarer"]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([{"_": i} for i in range(3)]), pa.array([sum(map(len, t)) for t in texts], pa.int32()), pa.array(texts, pa.list_(pa.string()))],
        names=["row", "size", "words"],
    )
    default = pa.default_memory_pool()
    pa.set_memory_pool(POOL)
    try:
        (block,) = byte_bpe._blocks([batch], known)
    finally:
        pa.set_memory_pool(default)
    assert 0 < POOL.max_memory() < known.nbytes
    words = block["words"][0].as_py()
    assert words == [" rare", " rarer"] and block["sizes"][0].as_py() == [4, 0, 2] and len(block["rows"][0]) == 3
    listed = [known[at].as_py() if at < len(known) else words[at - len(known)] for at in block["at"][0].as_py()]
    assert listed == [w for t in texts for w in t]


def test_plans_without_the_vocabulary(table, capsys):
    """The session keeps the text of each plan; it doesn't hold the vocabulary."""
    coded = byte_bpe.encode(table([(1, "the cat", "en")]).withColumn("table", F.lit(1)).withColumn("_", F.lit(2)), RANKS, public_tokenizers.PATTERN)
    found = byte_bpe.decode(coded, RANKS)
    assert found.columns == [*coded.columns, "decoded"] and found.select("table", "_", "decoded").first() == (1, 2, b"the cat")
    for frame in (coded, found):
        frame.explain(True)
        assert 0 < len(capsys.readouterr().out) < 200_000


def test_classes_of_the_pattern(spark):
    """The Java classes are those of the library, whatever the version of Unicode that the runtime has."""
    characters = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    df = spark.createDataFrame([(characters,)], "t string")
    single = {bytes([i]): i for i in range(256)}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        library = tiktoken.Encoding("x", pat_str=name, mergeable_ranks=single, special_tokens={})
        expected = library.decode_bytes(library.encode_ordinary(characters)).decode()
        pattern = byte_bpe.java_pattern(name)
        assert "".join(df.select(F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).first()[0]) == expected


def test_unknown_ids_are_errors(spark):
    df = spark.createDataFrame([(None,), ([],), ([0, 1],)], "ids array<int>")
    assert [bytes(r.decoded) for r in byte_bpe.decode(df, RANKS).collect()] == [b"", b"", b'!"']
    with pytest.raises(Exception, match="no token has the id"):
        byte_bpe.decode(spark.createDataFrame([([10**6],)], "ids array<int>"), RANKS).collect()


def test_ranked_merges():
    rng = random.Random(3)
    for _ in range(300):
        ranks = {a + b: rng.randint(0, 9) for a in ("a", "b", "ab", "ba", "aa") for b in ("a", "b", "ab", "aa") if rng.random() < 0.5}
        parts = [rng.choice("ab") for _ in range(rng.randint(0, 30))]
        found = merge_ranked(parts, lambda a, b: ranks.get(a + b))
        while True:
            known = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not known:
                break
            i = min(known)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert found == parts


def test_long_words_take_seconds():
    with open(public_tokenizers.path(queries.WORD_BPE), encoding="utf-8") as file:
        definition = file.read()
    rng = random.Random(2)
    encoder, library = Encoder(definition), Tokenizer.from_str(definition)
    for word in ("a" * 200_000, "".join(rng.choice("acgt") for _ in range(200_000))):
        start = time.perf_counter()
        found = encoder.encode(word)
        assert time.perf_counter() - start < 20 and not encoder
        assert found == np.array(library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
    coded = byte_bpe._by_heap(b"a" * 200_000, byte_bpe.read_ranks(RANKS))
    assert sum(coded) > 0


# Near duplicates


def test_pages_of_one_template(table, spark, monkeypatch):
    """Pages that share a third of their words are no near-duplicates and make few candidates; those that are, are linked."""
    rng = random.Random(12)
    template = [f"t{i}" for i in range(110)]
    rows = []
    for i in range(800):
        own = [f"w{rng.randint(0, 10**9)}" for _ in range(45)]
        rows.append((i, " ".join(own[:20] + template[:60] + own[20:] + template[60:]), "en"))
    for i in range(40):
        rows.append((1000 + i, rows[i * 3][1].replace("t50 ", f"other{i} "), "en"))
    sizes = []
    confirmed = hyperminhash._confirmed
    monkeypatch.setattr(hyperminhash, "_confirmed", lambda sets, pairs: sizes.append(pairs.count()) or confirmed(sets, pairs))
    found = {r.doc_id: r.component_id for r in hyperminhash.near_duplicates(table(rows)).collect()}
    assert found == {i: (i - 1000) * 3 if i >= 1000 else i for i, _, _ in rows}
    assert sum(sizes) < 20 * len(rows)


def test_empty_tables(table):
    none = table([])
    coded = byte_bpe.encode(none, RANKS, public_tokenizers.PATTERN)
    results = [collocations.collocations(none), find_runs(none), coded, byte_bpe.decode(none.selectExpr("array(1) as ids"), RANKS)]
    assert [r.collect() for r in results] == [[]] * 4


def test_digests_of_the_queries(spark, sf_dir, reference):
    documents = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.QUERIES["op13_byte_bpe"](spark, sf_dir).collect():
        ids = reference.encode_ordinary(documents[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(documents[r.doc_id].encode()).hexdigest()
