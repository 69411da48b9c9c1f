"""Look-ups by containment and similarity, and the chunk pipeline, against plain Python over all pairs and all lines."""

import random
import re
from collections import defaultdict
from difflib import SequenceMatcher
from pathlib import Path

import pytest

from siltstone.config import Settings
from siltstone.operators import catalog, models
from siltstone.plans import queries

DATA = Path("/root/testdata/sf0.001")


def names_and_catalog(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abAc 甲乙丙") for _ in range(rng.randint(0, 9))).strip()
    entries = list({w: (w, word() if k % 2 else "", k) for k in range(80) if (w := word())}.values())
    asked = [(k, word() if k % 4 else rng.choice(entries)[0][1:]) for k in range(60)] + [(100, None), (101, " ")]
    built = spark.createDataFrame([(c, e, {"culture": "x"}, o) for c, e, o in entries], "cn_name string, en_name string, lab_level map<string,string>, ord long")
    return asked, entries, spark.createDataFrame(asked, "query_id int, name string"), built


def plain_contains(name, entries):
    best = None
    for cn, en, _ in sorted(entries, key=lambda x: x[2]):
        size = len(cn) if cn in name or name in cn else len(en) if en and (en.lower() in name.lower() or name.lower() in en.lower()) else 0
        if size and (best is None or size > best[0]):
            best = size, cn
    return best and best[1]


def plain_similar(name, entries, least):
    best = None
    for cn, en, _ in sorted(entries, key=lambda x: x[2]):
        score = max(SequenceMatcher(None, name, cn).ratio(), SequenceMatcher(None, name.lower(), en.lower()).ratio() if en else 0)
        if score >= least and (best is None or score > best[0]):
            best = score, cn
    return best and best[1]


@pytest.mark.parametrize("seed", [1, 2])
def test_lookups_against_all_pairs(spark, seed):
    asked, entries, names, built = names_and_catalog(spark, seed)
    stripped = {k: (n or "").strip() for k, n in asked}
    got = {r.query_id: r.cn_name for r in catalog.lookup_contains(names, built).collect()}
    assert got == {k: found for k, n in stripped.items() if n and (found := plain_contains(n, entries))}
    for least in (0.3, 0.6, 0.85):
        got = {r.query_id: r.cn_name for r in catalog.lookup_similar(names, built, Settings(similarity_min=least)).collect()}
        assert got == {k: found for k, n in stripped.items() if n and (found := plain_similar(n, entries, least))}
    first, second = {c for c, _, _ in entries}, {}
    for c, e, _ in entries:
        if e:
            second[e.lower()] = c
    expected = {}
    for k, n in stripped.items():
        if n:
            exact = n if n in first else second.get(n.lower())
            near = None if exact else plain_contains(n, entries)
            like = None if exact or near else plain_similar(n, entries, 0.6)
            if found := exact or near or like:
                expected[k] = found, "exact" if exact else "contains" if near else "similar"
    assert {r.query_id: (r.cn_name, r.found_by) for r in catalog.lookup(names, built).collect()} == expected


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
@pytest.mark.parametrize("name", ["lookup_similarity", "lookup_cascade"])
def test_lookup_queries_against_all_pairs(spark, name):
    entries = [(r.cn_name, "", r.ord) for r in queries._catalog(spark, str(DATA)).collect()]
    for r in queries.QUERIES[name](spark, str(DATA)).collect():
        if name == "lookup_similarity":
            asked = queries.read(spark, str(DATA), "nation").where(f"n_nationkey = {r.query_id}").first().n_name.lower()
            assert r.cn_name == plain_similar(asked, entries, 0.3)
        elif r.found_by == "exact":
            assert r.cn_name == r.query_id
        else:
            assert r.cn_name == (plain_contains(r.query_id, entries) if r.found_by == "contains" else plain_similar(r.query_id, entries, 0.6))


def half(text):
    return 3 * len(re.findall("[一-鿿]", text)) + 2 * len(re.findall("[a-zA-Z]+", text)) + len(re.findall("[0-9]+", text))


def tokens(text):
    return half(text) // 2 + 1


def level_of(line):
    return len(re.match("#*", line)[0])


def body_of(rows):
    return "\n".join(rows)


def plain_blocks(rows):
    """(start, end, title, level, trail, lines) of each block after both merges."""
    blocks, trail = [], []
    for k, line in enumerate(rows, 1):
        if level_of(line) in (1, 2):
            trail = [x for x in trail if x[0] < level_of(line)] + [(level_of(line), line.lstrip("# "))]
            blocks.append({"start": k, "title": line.lstrip("# "), "level": level_of(line), "trail": [x[1] for x in trail], "rows": []})
        blocks[-1]["rows"].append(line)
    merged, held = [], None
    for b in blocks:
        shell = len(b["rows"]) <= 3 and all(level_of(x) for x in b["rows"])
        if held and shell:
            if b["level"] > held["level"]:
                held["rows"] += b["rows"]
                continue
            merged.append(held)
            held = b
        elif shell:
            held = b
        elif held:
            if held["level"] < b["level"] or (held["level"] == b["level"] and len(held["title"]) <= 30):
                if held["title"] not in b["trail"]:
                    b["trail"] = held["trail"] + [t for t in b["trail"] if t not in held["trail"]]
                merged.append(b | {"start": held["start"], "rows": held["rows"] + b["rows"]})
            else:
                merged += [held, b]
            held = None
        else:
            merged.append(b)
    merged += [held] if held else []
    small = lambda b: tokens(body_of(b["rows"])) < 100
    out = []
    for b in merged:
        if out and small(out[-1]) and out[-1]["trail"][0] == b["trail"][0]:
            before = out.pop()
            b = b | {"start": before["start"], "rows": before["rows"] + b["rows"]}
        out.append(b)
    for k in range(len(out) - 1, 0, -1):
        if small(out[k]) and out[k - 1]["trail"][0] == out[k]["trail"][0]:
            out[k - 1]["rows"] += out.pop(k)["rows"]
    return out


def plain_chunks(rows):
    """(lines from, to, text) after merge, split and merge."""
    pieces = []
    for k, line in enumerate(rows):
        if k == 0 or level_of(line):
            pieces.append([k, k, ""])
        pieces[-1][1] = k
    pieces = [[a, b, body_of(rows[a : b + 1])] for a, b, _ in pieces]

    def merge(parts):
        out = []
        for p in parts:
            if out and tokens(out[-1][2]) < 128:
                out[-1] = [out[-1][0], p[1], out[-1][2] + "\n\n" + p[2]]
            else:
                out.append(list(p))
        return out

    split = []
    for a, b, text in merge(pieces):
        if tokens(text) <= 384:
            split.append([a, b, text])
            continue
        own = []
        for paragraph in re.split("\n\n+", text):
            if own and tokens(own[-1] + "\n\n" + paragraph) <= 384:
                own[-1] += "\n\n" + paragraph
            else:
                own.append(paragraph)
        split += [[a, b, t] for t in own]
    return merge(split)


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
def test_chunk_pipeline_against_plain_python(spark):
    import hashlib

    docs = defaultdict(list)
    for r in queries._outline(spark, str(DATA)).orderBy("doc", "line_no").collect():
        docs[r.doc].append(r.raw)
    expected = set()
    for doc, rows in docs.items():
        for no, block in enumerate(plain_blocks(rows)):
            for idx, (a, b, text) in enumerate(plain_chunks(block["rows"])):
                content = " > ".join(block["trail"]) + "\n" + text
                expected.add((doc, no, idx, block["start"] + a, block["start"] + b, tokens(content), hashlib.sha256(content.encode()).hexdigest()))
    got = {tuple(r) for r in queries.QUERIES["chunk_pipeline"](spark, str(DATA)).collect()}
    assert got == expected


def test_one_failing_item_costs_only_itself(spark):
    class Picky(models.Echo):
        def answer(self, prompts):
            if any("bad" in p for p in prompts):
                raise ValueError("bad")
            return super().answer(prompts)

    frame = spark.createDataFrame([(k, f"line\n{w}") for k, w in enumerate(["one", "bad", "two", None])], "k int, prompt string").coalesce(1)
    assert [r.answer for r in models.with_answers(frame, Picky(), "prompt").orderBy("k").collect()] == ["one", "", "two", "None"]
