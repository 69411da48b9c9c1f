"""WARC, suffix dedup, packing, Jaccard join, neighbours, URL rules and the pipeline against brute force, with odd inputs."""

import gzip
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from siltstone.llm import components, graph, jaccard, packing, queries, suffix, urls, warc

WORDS = P.path("word_bpe_49k.json")
WORD = re.compile("[^\x20\x09-\x0d]+")


def clash(frame, *names):
    for name in names:
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


# ------------------------------------------------------------------ WARC


def test_warc_round_trip(spark):
    rng = random.Random(1)
    html = ["", None, "small é", "x" * 1000, "WARC/1.1\r\n\r\n" * 300, "漢" * 9000, "".join(rng.choice("ab\r\n<é") for _ in range(30_000))]
    rows = [(k, f"http://a/{k}\r\nX: y" if k % 3 else None, h) for k, h in enumerate(html + html + html[3:5])] + [(None, "http://null", "q" * 50)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(clash(frame, "digest", "ordinal", "refers"), segment_bytes=3000).collect()
    assert len(got) == len(rows) and {r.status for r in got} == {"ok"}
    payload = {k: (h or "").encode() for k, _, h in rows}
    last = {}
    for k, data in payload.items():
        if k is not None and len(data) >= 1000:
            last[data] = max(last.get(data, -1), k)
    for r in got:
        data = payload[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        owner = last.get(data, r.page_id)
        assert (r.record_type, r.refers_to) == (("response", None) if owner == r.page_id else ("revisit", owner))


def test_warc_repeated_and_empty(spark):
    frame = spark.createDataFrame([(5, "u", "y" * 2000), (5, "u", "y" * 2000), (4, "u", "y" * 2000)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(frame).select("page_id", "record_type", F.coalesce("refers_to", F.lit(-1)).alias("refers_to")).collect())
    assert got == [(4, "revisit", 5), (5, "response", -1), (5, "revisit", 5)]
    assert warc.round_trip(frame.limit(0)).count() == 0


def archive(spark, tmp_path, records):
    path = tmp_path / "w"
    path.mkdir()
    (path / "a.txt.gz").write_bytes(b"".join(gzip.compress(r.encode() + b"\r\n\r\n") for r in records))
    return {r.page_id: r for r in warc.read(spark, f"file://{path}").collect()}


def test_warc_damage_is_told(spark, tmp_path):
    def page(k, text):
        data = text.encode()
        return list(warc.records((k, "http://x", data, hashlib.sha1(data).hexdigest(), k, None), 2000))

    whole, gap, cut, framed = page(1, "a" * 7000), page(2, "b" * 7000), page(3, "c" * 7000), page(4, "d" * 100)
    del gap[1]
    cut[-1] = re.sub("Total-Length: [0-9]+", "Total-Length: 9", cut[-1])
    framed[0] = framed[0].replace("\r\n64\r\n", "\r\nzz\r\n")
    random.Random(2).shuffle(whole)
    lost = list(warc.records((5, "http://x", b"", "0" * 40, 5, 77), 2000))
    got = archive(spark, tmp_path, [*whole, *gap, *cut, *framed, *lost])
    assert {k: r.status for k, r in got.items()} == {1: "ok", 2: "missing segment", 3: "other length", 4: "broken chunks", 5: "no response"}
    assert got[1].payload_bytes == 7000 and got[2].payload_bytes is None


def test_chunked_framing():
    for data in (b"", b"x", "é漢".encode() * 4000):
        assert warc.unchunked(warc.chunked(data, 7)) == data
    assert warc.unchunked(b"5;ext=1\r\nhello\r\n0\r\n\r\n") == b"hello"
    assert warc.unchunked(b"5\r\nhell") is None and warc.unchunked(b"") is None


# ------------------------------------------------------------------ suffix dedup


def test_transform_against_windows():
    rng = random.Random(3)
    for _ in range(60):
        base = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(3)]
        strings = [b"".join(rng.choice(base)[rng.randint(0, 20) : rng.randint(30, 60)] for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 12))]
        length = rng.randint(2, 25)
        count = Counter(x[i : i + length] for x in strings for i in range(len(x) - length + 1))
        expected = [[i for i in range(len(x) - length + 1) if count[x[i : i + length]] > 1] for x in strings]
        assert [g.tolist() for g in suffix.recurring(strings, length)] == expected


def test_common_prefixes():
    codes = np.array([1, 2, 1, 2, 1, 0]) + 0
    order = np.array(sorted(range(6), key=lambda i: codes[i:].tolist()))
    assert (suffix.suffix_array(codes, 1, 10) == order).all()
    assert suffix.common_prefixes(codes, order, 10).tolist() == [0, 0, 1, 3, 0, 2]


def plain_dedup(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        yield len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0, kept


@pytest.mark.parametrize("cap", [1500, 15, 2])
def test_dedup_against_windows(spark, monkeypatch, cap):
    monkeypatch.setattr(suffix, "BLOCK_NEIGHBOURS", cap)
    monkeypatch.setattr(suffix, "SEGMENT", 5000)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefg é") for _ in range(n))
    passage, base = text(150), text(900)
    texts = [text(200) + passage + text(200) for _ in range(40)] + [base] * 3
    for _ in range(10):
        edited = list(base)
        for _ in range(5):
            edited[rng.randrange(900)] = "Z"
        texts.append("".join(edited))
    texts += [None, "", "a" * 700, "ab" * 400, "c" * 9000, "c" * 101, text(99), text(12_000), "x" * 99, "x" * 99, "y" * 100, "y" * 100]
    frame = spark.createDataFrame([(k if k != 5 else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    frame = frame.unionByName(frame.limit(1)).repartition(4)
    given = [t for _, t in ((r.doc_id, r.text) for r in frame.collect())]
    expected = defaultdict(list)
    for t, e in zip(given, plain_dedup(given, 100), strict=True):
        expected[t].append(e)
    for r in suffix.deduplicate(clash(frame, "key", "anchor", "start", "n_bytes", "kept"), length=100, stretch=24).collect():
        n, removed, runs, kept = expected[r.text][0]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.kept_sha256) == (n, removed, runs, kept, hashlib.sha256(kept).hexdigest())
    replaced = suffix.deduplicate(frame, length=100, stretch=24, replace=True).collect()
    assert sum(r.text is None for r in replaced) == 1
    assert suffix.deduplicate(frame.limit(0)).count() == 0


def test_long_uniform_text_is_cut(spark):
    """One neighbourhood for many equal anchors: few rows, whatever the length."""
    data = np.full(300_000, 97, np.uint8)
    with np.errstate(over="ignore"):
        anchor, places, first, last = suffix.anchors(data, np.array([len(data)]), 400, 64)
    assert len(anchor) <= 300_000 // suffix.MOST_STARTS + 1 and (places > 1).all()
    assert first[0] == 0 and last[-1] == len(data) - 400 and (first[1:] == last[:-1] + 1).all()
    frame = spark.createDataFrame([(1, "a" * 5_000_000), (2, "ab" * 100_000 + "q" * 400)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.deduplicate(frame).collect()}
    assert got == {1: (5_000_000, 1, b""), 2: (200_000, 1, b"q" * 400)}


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test data here")
def test_dedup_of_documents_against_windows(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    expected = {k: e for (k, _), e in zip(rows, plain_dedup([t for _, t in rows], 400), strict=True)}
    got = suffix.deduplicate(frame).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == expected


@pytest.mark.parametrize("cap", [1500, 2])
def test_shorter_passages_against_windows(spark, monkeypatch, cap):
    monkeypatch.setattr(suffix, "BLOCK_NEIGHBOURS", cap)
    monkeypatch.setattr(suffix, "PASSAGE_WORDS", 12)
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefg é") for _ in range(n))
    short, long = [text(70) for _ in range(3)], text(260)
    texts = [text(90) + rng.choice(short) + text(rng.randint(0, 60)) + rng.choice([long, long[40:180], ""]) + text(50) for _ in range(40)]
    texts += [None, "", "a b " * 200, long, long, long + long, text(5000), text(39), " ".join("é" * 12), "w " * 13 + text(70)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in suffix.deduplicate(clash(frame, "n_repeated", "spans"), length=100, stretch=24, passages=(40, 16)).collect()}
    raw = [(t or "").encode() for t in texts]
    again = Counter(b[i : i + 40] for b in raw for i in range(len(b) - 39))
    for k, (b, (n, removed, runs, kept)) in enumerate(zip(raw, plain_dedup(texts, 100), strict=True)):
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.kept_sha256) == (n, removed, runs, kept, hashlib.sha256(kept).hexdigest())
        covered = np.zeros(len(b), bool)
        for i in range(len(b) - 39):
            if again[b[i : i + 40]] > 1:
                covered[i : i + 40] = True
        words = [sum(m.start() >= x.start() and m.end() <= x.end() for m in re.finditer(rb"[^\x20\x09-\x0d]+", b)) for x in re.finditer(rb"\x01+", covered.tobytes())]
        assert (r.n_repeated, r.n_passages) == (covered.sum(), sum(w > 12 for w in words)), k
    assert suffix.deduplicate(frame.limit(0), passages=(200, 48)).count() == 0


def test_passages_of_over_fifty_words_show(spark, tmp_path):
    """51 short words are fewer bytes than a string that goes: they stay, but the query counts them. 50 words are no passage."""
    rng = random.Random(13)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 6))) for _ in range(n))
    passage, less = text(51), text(50)
    assert 200 <= len(passage) < 400
    texts = [f"{text(80)} {passage} {text(30)}", f"{text(9)}\n{passage}\n{text(70)}", f"{text(60)} 1{less}2 {text(60)}", f"{text(20)} 3{less}4 {text(20)}", text(200), passage[: len(passage) // 3]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op6_suffix_dedup(spark, f"file://{tmp_path}").collect()}
    assert [got[k].n_passages for k in range(6)] == [1, 1, 0, 0, 0, 0]
    assert [got[k].n_repeated >= n for k, n in enumerate((len(passage), len(passage), len(less) - 2, len(less) - 2, 1, 1))] == [True] * 4 + [False] * 2
    assert all((got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (0, 0, hashlib.sha256(t.encode()).hexdigest()) for k, t in enumerate(texts))


# ------------------------------------------------------------------ packing


def test_words_as_the_tokenizer():
    rng = random.Random(5)
    letters = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "āĀ", "word", "Straße.", "x²", *"_#0aAbZé́ÉßΣσİ \x1c\t\r\n   .,'s'T12<|>漢字٣èK-"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + [None, "a <|endoftext|> b<|startoftext|>", "ab" * 3000 + "'", "é" * 500 + "漢"]
    plain, as_text = Tokenizer.from_file(WORDS), Tokenizer.from_file(WORDS)
    as_text.encode_special_tokens = True
    for words, library in ((packing.WordIds(WORDS), plain), (packing.WordIds(WORDS, special_as_text=True), as_text)):
        for text, ids in zip(texts, words.of(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_words_of_other_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError):
        packing.WordIds(P.path("byte_bpe_50k.json"))
    given = json.loads(Path(WORDS).read_text())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}, {"normalizer": None}):
        (tmp_path / "other.json").write_text(json.dumps(given | change))
        with pytest.raises(ValueError):
            packing.WordIds(str(tmp_path / "other.json"))


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_BYTES", 40_000)
    words, plain, rng = packing.WordIds(WORDS), Tokenizer.from_file(WORDS), random.Random(6)
    for _ in range(60):
        text = " ".join(rng.choice("abcdef") * rng.randint(1, 3) + str(rng.randint(0, 999)) for _ in range(50))
        assert np.frombuffer(next(words.of([text])), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
        assert len(words.memo) + len(words.memo.before) < 40_000 / packing.ENTRY_BYTES + 200


def test_best_fit_and_bounds():
    rng = np.random.default_rng(6)
    for _ in range(40):
        sizes = rng.integers(1, 101, rng.integers(1, 60))
        bins = packing.best_fit_decreasing(sizes, 100)
        loads = np.bincount(bins, sizes)
        assert loads.max() <= 100 and packing.lower_bound(sizes, 100) <= len(loads)
    assert packing.lower_bound(np.array([51] * 7), 100) == 7  # sums alone say 4
    assert packing.lower_bound(np.array([34] * 6), 100) == 3
    assert packing.lower_bound(np.zeros(0, np.int64), 100) == 0
    # brute force on small cases: the bound never passes the optimum

    def least(sizes, room):
        if not sizes:
            return len(room)
        best = 99
        for k in range(len(room)):
            if room[k] >= sizes[0]:
                best = min(best, least(sizes[1:], room[:k] + [room[k] - sizes[0]] + room[k + 1 :]))
        return min(best, least(sizes[1:], [*room, 20 - sizes[0]]))

    for _ in range(60):
        sizes = sorted(rng.integers(1, 21, 6).tolist(), reverse=True)
        assert packing.lower_bound(np.array(sizes), 20) <= least(sizes, [])


def test_pack_documents(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["word", "Longer", "éa", "x,"]) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", "many " * 300]
    frame = spark.createDataFrame([(k if k != 9 else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    frame = clash(frame.unionByName(frame.limit(2)), "piece", "length", "grp", "bin")
    pieces = packing.tokenized(frame, WORDS, capacity=64)
    plain = Tokenizer.from_file(WORDS)
    for settings in ({}, {"group_pieces": 20, "fan_in": 3}):
        got = packing.pack(pieces, 64, **settings).collect()
        by_sequence = defaultdict(list)
        for r in got:
            by_sequence[r.sequence_id].append(r)
        for rows in by_sequence.values():
            at = 0
            for r in sorted(rows, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 64
        total = sum(r.length for r in got)
        assert len(by_sequence) <= -(-total // 64) + (1 if not settings else 16)
        for doc, text in enumerate(texts):
            if doc in (0, 1, 9):
                continue
            ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
            own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == doc)
            assert own == [(k, s, len(part := ids[s : s + 64]), zlib.crc32(np.array(part, "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
        assert sum(r.doc_id == 0 for r in got) % 2 == 0
    assert packing.pack_documents(frame.limit(0), WORDS).count() == 0


# ------------------------------------------------------------------ Jaccard join


def plain_join(rows, rule):
    sets = {}
    for k, t in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(words[i : i + rule.words]) for i in range(len(words) - rule.words + 1)} if len(words) >= rule.words else {tuple(words)} if words else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and rule.den * len(sets[a] & sets[b]) >= rule.num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def near_texts():
    rng = random.Random(8)
    base = [f"w{k}" for k in range(400)]
    texts = []
    for size in (3, 4, 5, 6, 8, 9, 10, 11, 12, 13, 15, 18, 20, 22, 25, 30, 40, 60, 100, 200):
        for _ in range(9):
            words = base[:size]
            for _ in range(rng.randint(0, max(1, size // 15))):
                k, how = rng.randrange(len(words)), rng.random()
                words = words[:k] + ([f"x{rng.randint(0, 9)}"] + words[k + 1 :] if how < 0.4 else words[k + 1 :] if how < 0.7 else ["new", *words[k:]])
            texts.append(" ".join(words))
    return [*texts, None, "", " \n", "one", "One", "one two", "é É", "é é"]


@pytest.mark.parametrize(("rule", "block"), [(jaccard.Rule(3, 90, 100), 256), (jaccard.Rule(5, 80, 100), 256), (jaccard.Rule(3, 90, 100), 4), (jaccard.Rule(1, 60, 100), 4)])
def test_join_against_all_pairs(spark, monkeypatch, rule, block):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard, "BITMAP_SETS", 2 * block)
    monkeypatch.setattr(jaccard, "BITMAP_BLOCK", 3 * block)
    rows = list(enumerate(near_texts()))
    frame = clash(spark.createDataFrame(rows, "doc_id long, text string"), "class", "key", "n", "cluster", "of_text", "component")
    for count_links in (True, False):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame.repartition(3), rule, count_links=count_links).collect()}
        assert got == plain_join(rows, rule)


def test_join_odd_rows(spark):
    rule = jaccard.Rule(3, 90, 100)
    frame = spark.createDataFrame([(7, "a b c d"), (7, "a b c d"), (None, "A b c d"), (None, None), (8, ""), (9, "q r s")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard.join(frame, rule).collect())
    assert got == [(-1, 0, -1), (-1, 2, 7), (7, 2, 7), (7, 2, 7), (8, 0, 8), (9, 1, 9)]
    assert jaccard.join(frame.limit(0), rule).count() == 0
    left = jaccard.one_of_each(frame, rule).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in left) == [(-1, ""), (7, "a b c d"), (8, ""), (9, "q r s")]


def test_join_with_many_copies_of_one_text(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(400)}" for _ in range(80)]
    one, near = " ".join(words), " ".join([*words, "more"])
    texts = [one] * 4000 + [near] * 3 + [f"other {k} text of its own" for k in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    rows = {r.doc_id: r for r in jaccard.join(df, jaccard.Rule(3, 90, 100)).collect()}
    assert all(rows[k].component_id == 0 and rows[k].n_links == 1 for k in range(4003))
    assert {rows[k].class_id for k in range(4000)} == {0} and {rows[k].class_id for k in range(4000, 4003)} == {4000}
    assert all(rows[k].component_id == k for k in range(4003, len(texts)))
    assert jaccard.one_of_each(df, jaccard.Rule(3, 90, 100)).count() == 51


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in root}


def test_bitmaps_bound_differences():
    rng = np.random.default_rng(1)
    for size in (120, 120, 900, 5000):
        for _ in range(10):
            a, b = (np.unique(rng.integers(0, 3 * size, k * size).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in (1, 2))
            maps = jaccard._same_width([jaccard._bitmap(a), jaccard._bitmap(b)])
            assert int(np.bitwise_count(maps[0] ^ maps[1]).sum()) <= len(np.setxor1d(a, b))


# ------------------------------------------------------------------ neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(10)
    vectors = rng.normal(size=(1500, 16)).astype(np.float32)
    vectors[300:700] = vectors[300]  # copies of one vector
    vectors[700:900] = vectors[700] + rng.normal(size=(200, 16)).astype(np.float32) * 0.01
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    bad = [(5000, None), (5100, []), (5200, [0.0] * 16), (5300, [float("nan")] * 16), (5400, [float("inf")] + [1.0] * 15), (5500, [1.0] * 4), (5600, [2.0] * 4), (None, [1.0] * 16), (5700, [1.0, None] + [1.0] * 14)]
    frame = clash(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>"), "shard", "vector", "rank", "block")
    got = defaultdict(list)
    for r in graph.nearest(frame, shard_bytes=80_000).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    exact, hit, total = vectors.astype(np.float64), 0, 0
    for q in range(0, 1500, 100):
        far = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        best = [int(i) for i in np.lexsort((np.arange(1500), far)) if i != q][:10]
        assert len(got[q]) == 10 and all(s == pytest.approx(far[i], abs=1e-12) for i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda x: (x[1], x[0]))
        hit += len(set(best) & {i for i, _ in got[q]})
        total += 10
    assert hit / total >= 0.9
    assert [i for i, _ in got[300]] == list(range(301, 311))
    assert got[5500] == [(5600, 2.0)] and set(got) == {*range(0, 1500, 100), 5500, 5600}
    assert graph.nearest(frame.limit(0)).count() == 0
    wide = spark.createDataFrame([(0, [0.1, 0.0]), (1, [0.2, 0.0]), (2, [0.1, 1e30])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in graph.nearest(wide).orderBy("rank").collect()] == [(1, 0.1), (2, 1e30)]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (0, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in graph.nearest(few).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_pruning_keeps_diverse_edges():
    points = np.array([[0, 0], [1, 0], [1.1, 0], [0, 1.5], [5, 5]], np.float32)
    kept = graph.robust_prune(points, np.array([0]), np.array([[1, 2, 3, 4, 0, -1, 1]]), 3, 1.2)[0].tolist()
    assert kept == [1, 3, 4]  # the third point is much nearer to the second than to the first


# ------------------------------------------------------------------ URL rules


def plain_verdict(url, rules):
    host, path = "", ""
    if url and "://" in url:
        m = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
    best = None
    for verdict, rule in rules:
        own, _, rest = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best and best[1], best[0] if best else "allow"


def test_url_rules(spark):
    rng = random.Random(11)
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"), ("block", "a.b.c.d/x/y/z/")]
    made = [rng.choice(["http://", "https://", "://", ""]) + ".".join(rng.choices(["www", "Example", "com", "net", "a", "b", "c", "d", ""], k=rng.randint(0, 5))) + rng.choice(["", ":80", "/"]) + "/".join(rng.choices(["en", "es", "fr", "x", "y", "z", ""], k=rng.randint(0, 5))) + rng.choice(["", "?q=/en/", "#/es/"]) for _ in range(800)]
    given = [*made, None, "", "://", "http://com", "http://com/", "HTTP://WWW.EXAMPLE.COM/en/x", "http://example.com/en", "a://b://com/x", "http://x.net/es/\n?", "http://a.b.c.d/x/y/z/w", "http://com/" + "é/" * 3000]
    frame = spark.createDataFrame([(k if k % 11 else None, u) for k, u in enumerate(given)], "page_id long, url string").unionByName(spark.createDataFrame([(1, given[1])] * 3, "page_id long, url string"))
    got = urls.judge(clash(frame, "host", "path", "rule", "digest", "id", "near"), urls.rule_table(spark, rules)).collect()
    expected = Counter((r.page_id, *plain_verdict(r.url, rules)) for r in frame.collect())
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == expected
    assert urls.judge(frame.limit(0), urls.rule_table(spark, rules)).count() == 0
    assert {r.verdict for r in urls.judge(frame, urls.rule_table(spark, [])).collect()} == {"allow"}
    with pytest.raises(ValueError, match="slash"):
        urls.rule_table(spark, [("block", "a/b")])


# ------------------------------------------------------------------ queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    frame = queries.QUERIES[name](spark, str(DATA))
    got = frame.collect()
    if name not in queries.ORACLES:
        assert got
        return
    duck = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        duck.execute(f"create view {path.stem} as select * from '{path}'")
    result = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted(repr(tuple(r[n] for n in names)) for r in got) == sorted(map(repr, result.fetchall()))


# ------------------------------------------------------------------ pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    clean = [" ".join(word() for _ in range(120)) for _ in range(40)]
    passage = " ".join(word() for _ in range(60))
    near = clean[0].split()
    near[50] = "changed"
    rows = [(k, t) for k, t in enumerate(clean)] + [(100, " ".join(near)), (101, clean[1]), (102, "too short"), (103, "same words " * 60), (104, None)]
    rows += [(200 + k, " ".join(word() for _ in range(80)) + " " + passage + " " + " ".join(word() for _ in range(80))) for k in range(3)]
    rows += [(300, " ".join(word() for _ in range(40)) + " mail jo.e@mail.example.com or +1 (555) 123-4567 " + " ".join(word() for _ in range(40)))]
    docs = spark.createDataFrame([(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    texts = {}
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, function in corpus_pipeline.STAGES[:-1]:
        now = function(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == docs.columns
        texts[name] = {r.doc_id: r.text for r in now.collect()}
        assert all(r.n_chars == len(r.text) for r in now.collect())
    ids = set(range(40))
    assert set(texts["quality_rules"]) == ids | {100, 101, 200, 201, 202, 300}
    assert set(texts["near_duplicates"]) == ids | {200, 201, 202, 300}
    assert all(texts["repeated_passages"][k] == clean[k] for k in ids)
    assert all(passage[5:-5] not in texts["repeated_passages"][200 + k] and len(texts["repeated_passages"][200 + k]) > 400 for k in range(3))
    assert all(texts["personal_data"][k] == clean[k] for k in ids)
    assert " <EMAIL> or <PHONE> " in texts["personal_data"][300]
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in whole} == ids | {200, 201, 202, 300}
    none = docs.limit(0)
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, none, str(tmp_path)).count() == 0


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Clashing extra columns, repeated rows, nulls in every column and a very long text: no stage loses a clean document."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))
    long = " ".join(word() for _ in range(60_000))
    rows = [(k, " ".join(word() for _ in range(60)), "en", f"s{k % 2}", 1) for k in range(12)] + [(50, long, "en", "s0", 2), (None, " ".join(word() for _ in range(40)), None, None, None)]
    rows += [rows[0], rows[0], (51, None, "en", None, None), (52, "", None, "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = clash(docs, "key", "class", "cluster", "spans", "kept", "n", "host", "masked", "anchor", "sets", "of_text", "bits")
    now = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        now = function(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == docs.columns
        got = Counter(r.doc_id for r in now.collect())
        assert set(got) == {*range(12), 50, None}, name
        assert got[0] == (3 if name == "quality_rules" else 1)
    assert len(now.where("doc_id = 50").first().text) == len(long)
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {*range(12), 50, None} and sum(r.doc_id == 50 for r in pieces) > 10
