import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siltstone.config import Settings
from siltstone.operators import catalog, tables
from siltstone.plans import ingest, whole_queries

GROUPED = """before
Prices

<div>
<table><tr><td rowspan="2">No</td><td colspan="2">Name</td><td>Level</td></tr><tr><td>A&amp;B</td><td>C</td><td>x</td></tr>
<tr><td rowspan="2">1</td><td>p</td><td>q</td><td>BSL-2</td></tr><tr><td>p</td><td>q</td><td>BSL-3</td></tr>
<tr><td rowspan="2">2</td><td>r</td><td>s</td><td>t</td></tr><tr><td>u</td><td>s</td><td>v</td></tr>
<tr><td>3</td><td>m</td><td></td><td></td></tr><tr><td></td><td>more</td><td></td><td></td></tr></table>
"""
SIDEWAYS = "<table><tr><td>项目</td><td>1</td><td>2</td><td>3</td></tr><tr><td>数量</td><td>4</td><td>5</td><td>6</td></tr></table>"


def frames(spark, *texts):
    docs = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)], "source_file string, text string")
    found = tables.find_tables(docs)
    keys = ["source_file", "table_index"]
    return docs, found, tables.parse_tables(found, keys), keys


def test_spans_headers_names_and_groups(spark):
    _, found, parsed, keys = frames(spark, GROUPED)
    row = parsed.first()
    assert row.table_name == "Prices" and found.first().start_char == GROUPED.index("<table")
    assert row.columns == ["No", "Name/A&B", "Name/C", "Level/x"] and row.header_rows == 2 and row.data_row_spans
    got = tables.group_spans(tables.records(parsed, keys), keys).orderBy("record_no").collect()
    assert got[0].record == {"No": "1", "Name/A&B": "p", "Name/C": "q", "Level/x": "BSL-2 | BSL-3"} and got[0].sub_items == []
    assert got[1].record == {"No": "2", "Name/C": "s"} and got[1].sub_items == [{"Name/A&B": "r", "Level/x": "t"}, {"Name/A&B": "u", "Level/x": "v"}]
    assert got[2].record["Name/A&B"] == "m\nmore"


def test_sideways_repeated_and_empty(spark):
    _, _, parsed, keys = frames(spark, SIDEWAYS, "<table><tr><th>a</th><th>a</th><th></th></tr><tr><td>x</td><td>y</td><td>z</td></tr></table>", "<table></table>")
    rows = {r.source_file: r for r in parsed.collect()}
    assert rows["d0"].is_transposed and rows["d0"].columns == ["项目", "数量"] and rows["d0"].rows == [["1", "4"], ["2", "5"], ["3", "6"]]
    assert rows["d1"].columns == ["a", "a__2", "col_3"] and rows["d1"].rows == [["x", "y", "z"]]
    assert rows["d2"].rows == [] and rows["d2"].columns == []


def test_table_chunks(spark):
    docs = spark.createDataFrame([("d", "# Top\ntext\n" + GROUPED)], "source_file string, text string")
    blocks, _ = ingest.text_chunks(docs)
    got = ingest.table_chunks(docs, blocks).collect()
    assert got and got[0].breadcrumb == ["Top", "Prices"] and "No: 1" in got[0].content and "子项1: " in "".join(r.content for r in got)


def test_parts_order_and_tree(spark):
    rows = "".join(f"<tr><td>{k}</td><td>{'word ' * 150}</td></tr>" for k in range(1, 6))
    docs = spark.createDataFrame([("d", f"# Top\ntext before\nNames\n<table><tr><td>No</td><td>Text</td></tr>{rows}</table>\n## Next\n" + "more " * 120)], "source_file string, text string")
    blocks, text = ingest.text_chunks(docs)
    table = ingest.table_chunks(docs, blocks, Settings(block_max=320))
    titles = [r.block_title for r in table.orderBy("table_block", "chunk_idx").collect()]
    assert titles == ["Names(第1部分)"] * 2 + ["Names(第2部分)"] * 2 + ["Names(第3部分)"]
    kinds = [r.is_table for r in ingest.all_chunks(text, blocks, table).orderBy("chunk_no").collect()]
    assert kinds[0] is False and kinds.count(True) == 5
    assert "- Next [1-" in ingest.tree(blocks).first().outline


def test_store(spark, tmp_path):
    from siltstone.operators import store

    store.drop(spark, "chunk_store")
    assert store.count(spark, "chunk_store") == 0
    assert store.ensure(spark, "chunk_store") and not store.ensure(spark, "chunk_store")
    chunks = spark.createDataFrame([(f"c{k}", "text", "sop" if k % 2 else "notice", 1, "b", "it's \"f\"", ["a"], "a", 1, 2, 3, "rule") for k in range(6)], "chunk_id string, content string, role string, role_confidence long, block_id string, source_file string, breadcrumb array<string>, heading_path string, start_line long, end_line long, token_estimate long, tagged_by string")
    vectors = chunks.select("chunk_id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    assert store.insert(store.with_vectors(chunks, vectors), "chunk_store") == 6 == store.count(spark, "chunk_store")
    assert store.scan(spark, "chunk_store", {"role": "sop", "source_file": "it's \"f\""}, ("chunk_id",)).count() == 3
    assert store.scan(spark, "chunk_store", {"chunk_id": ["c0", "c1"]}, limit=1).count() == 1
    plan = store.scan(spark, "chunk_store", {"role": "sop"})._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*role", plan)
    with pytest.raises(Exception, match="no vector for c"):
        store.insert(store.with_vectors(chunks, vectors.limit(0)), "chunk_store")
    store.drop(spark, "chunk_store")


def test_catalog(spark):
    rows = [
        ({"病毒名称/中文名": "甲病毒a", "病毒名称/英文名": "Alpha virus", "实验活动所需实验室等级/病毒培养a": "BSL-3", "实验活动所需实验室等级/灭活材料的操作": "BSL-2f", "运输/A/B": "A", "UN编号": "2814", "危害程度分类": "第二类"}, 0),
        ({"疾病中文名": "乙病", "实验活动所需实验室等级/组织培养": "BSL-1"}, 1),
        ({"病毒名称/中文名": "甲病毒", "实验活动所需实验室等级/病毒培养a": "BSL-4", "实验活动所需实验室等级/灭活材料的操作": "BSL-2f"}, 2),
        ({"x": "y"}, 3),
    ]
    built = catalog.build(spark.createDataFrame(rows, "record map<string,string>, ord long")).cache()
    got = {r.cn_name: r for r in built.collect()}
    assert set(got) == {"甲病毒", "乙病"} and got["甲病毒"].ord == 0 and got["甲病毒"].lab_level == {"culture": "BSL-4", "inactivated": "BSL-2f"}
    names = spark.createDataFrame([(1, "甲病毒"), (2, "新甲病毒株"), (3, "甲病"), (4, "申病毒"), (5, "nothing like it"), (6, " "), (7, None)], "query_id int, name string")
    found = {r.query_id: (r.cn_name, r.found_by) for r in catalog.lookup(names, built).collect()}
    assert found == {1: ("甲病毒", "exact"), 2: ("甲病毒", "contains"), 3: ("甲病毒", "contains"), 4: ("甲病毒", "similar")}
    slots = spark.createDataFrame([(1, "甲病毒", "culture", ["sop"], "q"), (2, "甲病毒", None, ["sop"], "q"), (3, "甲病毒", "culture", ["directory"], "q"), (4, None, None, ["sop"], "q"), (5, "乙病", None, ["sop"], None)], "query_id int, pathogen string, activity string, roles array<string>, query string")
    text = {r.query_id: r.search_query for r in catalog.enrich(slots, built).collect()}
    assert text == {1: "甲病毒 BSL-4 q", 2: "甲病毒 BSL-2 BSL-4 q", 3: "甲病毒 q", 4: "q", 5: "乙病"}


def test_second_name_in_lower_case(spark):
    built = spark.createDataFrame([("甲", "Alpha Virus", {"culture": "x"}, 0)], "cn_name string, en_name string, lab_level map<string,string>, ord long")
    names = spark.createDataFrame([(1, "alpha VIRUS"), (2, "the alpha virus strain")], "query_id int, name string")
    assert {r.query_id: r.found_by for r in catalog.lookup(names, built).collect()} == {1: "exact", 2: "contains"}
    assert built.select(catalog.level_of(F.col("lab_level"), F.lit("culture")).alias("x")).first().x == "x"


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data here")
def test_tables_are_parsed_once(spark):
    """The plan of grouped records with their names works out each table's grid once."""
    out = whole_queries.table_records(spark, "/root/testdata/sf0.001")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_names_and_cells(spark):
    """Names that repeat, cells with white space around them, rows of other lengths."""
    text = "T\n<table><tr><td>a</td><td> a </td><td>b</td></tr><tr><td>1</td><td>　x&nbsp;</td></tr><tr><td></td></tr><tr><td>2</td><td>y</td><td>z</td></tr></table>"
    docs = spark.createDataFrame([("d", text)], "source_file string, text string")
    keys = ["source_file", "table_index"]
    parsed = tables.parse_tables(tables.find_tables(docs), keys)
    row = parsed.first()
    assert (row["columns"], row["rows"]) == (["a", "a__2", "b"], [["1", "x", ""], ["2", "y", "z"]])


def test_rows_get_to_python_instead_of_tables(spark):
    """What spans rows is carried over batches of rows, tables begin anew, rows without cells don't count; no function sees a table or a line whole that needs no formula."""
    long = "<table>" + "".join(f"<tr><td rowspan='3'>{k}</td><td>x</td></tr><tr><td>y</td></tr><tr></tr><tr><td>z</td></tr>" for k in range(600)) + "</table>"
    texts = [long, "<table><tr><td>a</td><td rowspan='9'>b</td></tr></table>", "<table><tr><td>c</td></tr></table>", "<table></table>"]
    docs = spark.createDataFrame([("d", "\n".join(texts))], "source_file string, text string").coalesce(1)
    keys = ["source_file", "table_index"]
    found = tables.grids(tables.find_tables(docs), keys)
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.table_index: (r["__g"]["cells"], r["__g"]["row_spans"]) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
    rows = [[str(k), x] for k in range(600) for x in "xyz"]
    assert got == {1: (rows, [r[1] == "x" for r in rows]), 2: ([["a", "b"]], [True]), 3: ([["c"]], [False]), 4: ([], [])}
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "table_rows(__row" in plan(tables.parse_tables(tables.find_tables(docs), keys))
    from siltstone.operators import lines
    assert "latex_clean(CASE WHEN" in plan(lines.parse(lines.explode_lines(docs)))
