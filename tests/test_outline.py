import random

from pyspark.sql import functions as F

from siltstone.config import Settings
from siltstone.operators import chunks, lines, outline
from siltstone.plans import ingest
from siltstone.operators import roles


def parsed(spark, *texts):
    docs = spark.createDataFrame([(f"d{k}.md", t) for k, t in enumerate(texts)], "source_file string, text string")
    return lines.parse(lines.explode_lines(docs))


def flags(frame):
    return {(r.source_file, r.line_no): r for r in frame.collect()}


def test_noise_tail_and_images(spark):
    rows = flags(parsed(spark, "Tel: 1\nbody\n# 参考文献\nmore", "![a](b)\n\n![a](b)\n![c](d)\ntext\n![a](b)\n![a](b)", "版本号：3\n<table><tr>\nx@y.com z"))
    assert [rows["d0.md", n].is_noise for n in (1, 2, 3, 4)] == [True, False, True, True]
    assert rows["d0.md", 3].heading_level == 1  # a tail heading keeps its level
    assert [rows["d1.md", n].is_noise for n in range(1, 8)] == [True, False, True, True, False, False, False]
    assert [rows["d2.md", n].is_noise for n in (1, 2, 3)] == [True, False, True]
    assert rows["d2.md", 2].is_table


def test_blocks_and_breadcrumbs(spark):
    got = outline.blocks(parsed(spark, "intro\n# A\nx\n## B\ny\n### C\nz\n# D\nw", "no heading", "\n\n# only"))
    rows = {(r.source_file, r.title): r for r in got.collect()}
    assert rows["d0.md", "intro"].heading_level == 0
    assert rows["d0.md", "B"].breadcrumb == ["intro", "A", "B"] and (rows["d0.md", "B"].start_line, rows["d0.md", "B"].end_line) == (4, 7)
    assert rows["d0.md", "D"].breadcrumb == ["intro", "D"]
    assert rows["d1.md", "d1.md"].heading_level == 1
    assert ("d2.md", "only") in rows and len([k for k in rows if k[0] == "d2.md"]) == 1


def merged(spark, text, how, settings=Settings()):
    lined = parsed(spark, text)
    found = outline.measured(lined, outline.blocks(lined))
    return how(lined, found, settings)


def spans(frame):
    return [(r.title, r.start_line, r.last_line, r.breadcrumb) for r in frame.orderBy("first_line").collect()]


def test_shells(spark):
    shells = lambda lined, found, s: outline.merge_shells(found, settings=s)
    assert spans(merged(spark, "# A\n## B\nx", shells)) == [("B", 1, 3, ["A", "B"])]
    assert spans(merged(spark, "## Short\n## B\nx", shells)) == [("B", 1, 3, ["Short", "B"])]
    long = "y" * 31
    assert spans(merged(spark, f"## {long}\n## B\nx", shells)) == [(long, 1, 1, [long]), ("B", 2, 3, ["B"])]
    assert spans(merged(spark, "# A\n# B\n# C", shells)) == [("A", 1, 1, ["A"]), ("B", 2, 2, ["B"]), ("C", 3, 3, ["C"])]


def test_tiny(spark):
    tiny = lambda lined, found, s: outline.merge_tiny(found, settings=s)
    big = " ".join(["word"] * 120)
    assert spans(merged(spark, f"# A\nx\n## B\n{big}\n## C\ny", tiny)) == [("B", 1, 6, ["A", "B"])]
    assert spans(merged(spark, f"# A\nx\n# B\n{big}", tiny)) == [("A", 1, 2, ["A"]), ("B", 3, 4, ["B"])]


def test_oversized(spark):
    cut = lambda lined, found, s: outline.split_oversized(lined, found, settings=s)
    body = " ".join(["word"] * 60)
    text = f"## A\n{body}\n### B\n{body}\n#### C\n{body}\n### D\n{body}"
    got = spans(merged(spark, text, cut, Settings(block_max=100)))
    assert got == [("A", 1, 2, ["A"]), ("B", 3, 4, ["A", "B"]), ("C", 5, 6, ["A", "B", "C"]), ("D", 7, 8, ["A", "D"])]
    assert spans(merged(spark, text, cut, Settings(block_max=150))) == [("A", 1, 2, ["A"]), ("B", 3, 6, ["A", "B"]), ("D", 7, 8, ["A", "D"])]
    assert len(spans(merged(spark, f"# A\n{body}", cut, Settings(block_max=10)))) == 1


def test_chunk_sizes_on_random_documents(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        rows = []
        for _ in range(rng.randint(1, 60)):
            kind = rng.random()
            rows.append("" if kind < 0.15 else f"### {rng.randint(1, 9)}.{rng.randint(1, 9)} head" if kind < 0.25 else " ".join(["word"] * rng.randint(1, 90)))
        texts.append("\n".join(rows))
    docs = spark.createDataFrame([(f"d{k}.md", t) for k, t in enumerate(texts)], "source_file string, text string")
    blocks, got = ingest.text_chunks(docs)
    rows = got.collect()
    for r in rows:
        last = max(x.chunk_idx for x in rows if (x.source_file, x.block_no) == (r.source_file, r.block_no))
        if r.chunk_idx < last:
            assert r.token_estimate >= 128
    words = sum(t.count("word") for t in texts)
    assert sum(r.content.partition("\n")[2].count("word") for r in rows) == words
    tagged = ingest.tagged(blocks, got, roles.lexicon())
    assert tagged.count() == len(rows) == tagged.select("chunk_id").distinct().count()


def test_levels_of_chunks(spark):
    settings = Settings(block_level=1)
    lined = outline.with_blocks(parsed(spark, "plain\n## deep\nx", "plain only", "# A\ny\n## deep\nz"), settings=settings)
    got = chunks.raw_chunks(lined, ["source_file", "block_no"], settings).collect()
    # a first stretch without a heading is like a numbered item, unless it is all there is
    assert {(r.source_file, r.chunk.title): r.chunk.heading_level for r in got} == {("d0.md", "plain"): 99, ("d0.md", "deep"): 2, ("d1.md", "plain only"): 0, ("d2.md", "A"): 1, ("d2.md", "deep"): 2}


def test_blocks_with_their_measures_in_one_pass(spark, capsys):
    lined = parsed(spark, "intro\n# A\n## B\nx 12\n# C", "no heading", "", "\n\n# only\n<table><tr><td>1</td></tr></table>")
    apart = outline.measured(lined, outline.blocks(lined))
    one = outline.measured_blocks(lined).select(*apart.columns)
    one.explain()  # before it runs: afterwards the first plan is shown beside the last
    assert capsys.readouterr().out.count("Exchange hashpartitioning(source_file") == 1
    assert sorted(map(str, one.collect())) == sorted(map(str, apart.collect()))


def test_split_and_merge(spark):
    para = lambda n: " ".join(["w"] * n)
    raw = spark.createDataFrame([(1, "\n\n".join([para(200), para(200), para(500), para(10)]))], "k int, content string")
    one = raw.select("k", F.array(chunks._chunk(F.lit("t"), F.col("content"), F.lit(1), F.lit(9), F.lit(1), F.lit(2 * 910))).alias("chunks"))
    got = chunks.exploded(one.withColumn("chunks", chunks.split_large(F.col("chunks"))), ["k"]).orderBy("chunk_idx").collect()
    assert [(r.title, r.token_estimate) for r in got] == [("t", 201), ("t(续1)", 201), ("t(续2)", 501), ("t(续3)", 11)]
    merged_ = chunks.exploded(one.withColumn("chunks", chunks.split_large(F.col("chunks"))).withColumn("chunks", chunks.merge_small(F.col("chunks"))), ["k"]).collect()
    assert len(merged_) == 4  # the last one may stay small
