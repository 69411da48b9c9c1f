import json

from pyspark.sql import functions as F

from siltstone.operators import models, prompts, roles, routing
from siltstone.sources import files


def test_router_order_and_excludes(spark):
    table = [
        {"command": "steps", "triggers": ["(show|open).*step"], "excludes": ["if"]},
        {"command": "scene", "triggers": ["open.*scene", "step"], "excludes": []},
    ]
    asked = ["show the step", "show if step", "open scene", "nothing", "  ", None, "sh　ow step"]
    frame = spark.createDataFrame([(k, q) for k, q in enumerate(asked)], "k int, query string")
    got = [r.command for r in routing.router(frame, table).orderBy("k").collect()]
    assert got == ["steps", "scene", "scene", None, None, None, "steps"]


def test_slots(spark):
    rows = [
        ("[NEED_RAG:sop, Emergency,bad]\nPATHOGEN: x\nACTIVITY：培养\nQUERY: how", "q"),
        ("[NEED_RAG:equipment]\nEQUIPMENT: hood", "q"),
        (" plain answer ", "q"),
        ("我不确定", "q"),
        ("[NEED_RAG:nothing]", "q"),
        ("[NEED_RAG:sop]\nACTIVITY: unknown", "q"),
    ]
    got = routing.slots(spark.createDataFrame(rows, "output string, query string")).collect()
    assert (got[0].roles, got[0].pathogen, got[0].activity, got[0].slot_query) == (["sop", "emergency"], "x", "culture", "how")
    assert (got[1].roles, got[1].equipment, got[1].slot_query) == (["equipment"], "hood", "q")
    assert (got[2].needs_rag, got[2].answer, got[2].hedging, got[2].roles) == (False, "plain answer", False, [])
    assert got[3].hedging and got[4].roles == [] and got[5].activity is None


def test_scores_margin_and_junk(spark):
    words = [("sop", "body", "step", 3), ("emergency", "body", "spill", 4), ("emergency", "heading", "Danger", 2)]
    rows = [("a", "path\n\n# h\nstep step step step and more words here", "x"), ("b", "one line about nothing in particular at all", "Danger"), ("c", "x", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, content string, heading_path string")
    got = {(r.chunk_id, r.role): r.score for r in roles.scores(chunks, words).collect()}
    assert got["a", "sop"] == 9 and got["b", "emergency"] == 4 and got["c", "junk"] == 20 and len(got) == 27
    best = {r.chunk_id: (r.role, r.confidence) for r in roles.argmax(roles.scored(chunks, words)).collect()}
    assert best == {"a": ("sop", 9), "b": ("emergency", 4), "c": ("junk", 20)}


def test_ties_go_to_the_first_role(spark):
    words = [("sop", "body", "zzz", 1)]
    chunks = spark.createDataFrame([("a", "long enough text without any keyword", "")], "chunk_id string, content string, heading_path string")
    assert tuple(roles.argmax(roles.scored(chunks, words)).first()) == ("a", "sop", 0)


def test_junk_reasons(spark):
    texts = ["", "  \n ", "![a](b)\n![c](d)", "short", "[1] aaaaaaaaaaaaaaaa\n[2] bbbbbbbbbbbbbbbbbbb", "a text that is long enough to be kept"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.x for r in frame.orderBy("k").select(roles.junk_reason(F.col("t")).alias("x")).collect()]
    assert got == ["empty", "empty", "image_only", "too_short", "reference_section", None]


def test_backfill(spark):
    tagged = spark.createDataFrame([("a", "sop", 9), ("b", "sop", 1), ("c", "notice", 0), ("d", "sop", 2)], "chunk_id string, role string, confidence int")
    low = roles.low_margin(tagged)
    assert {r.chunk_id: r.custom_id for r in low.collect()} == {"b": 0, "c": 1, "d": 2}
    answers = spark.createDataFrame([(0, "Role: Emergency."), (1, "?"), (7, "sop")], "custom_id long, answer string")
    got = {r.chunk_id: (r.role, r.tagged_by) for r in roles.backfill(tagged, low, answers).collect()}
    assert got == {"a": ("sop", "rule"), "b": ("emergency", "llm"), "c": ("notice", "rule"), "d": ("sop", "rule")}


def test_sources(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/1.md").write_text('title: "T"\ncontext: `"experiment_supplies": ["a"], "experiment_steps": ["s1", "s2"]', encoding="utf-8")
    (tmp_path / "m/2.md").write_text('title: "U"\ncontext: `{"experiment_supplies": ["b"], "experiment_steps": ["s"], "knowledge_points_list": ["k"]}`', encoding="utf-8")
    (tmp_path / "m/3.md").write_text('context: `{"experiment_steps": ["s", "cut sho', encoding="utf-8")
    (tmp_path / "m/4.md").write_text("nothing", encoding="utf-8")
    got = {r.id: r for r in files.scenarios(spark, str(tmp_path / "m")).collect()}
    assert set(got) == {"1", "2", "3"} and got["1"].steps == ["s1", "s2"] and got["2"].knowledge_points == ["k"] and got["3"].steps == ["s"]
    assert files.markdown(spark, str(tmp_path / "m"), skip=("4.md",)).count() == 3
    lines = [json.dumps({"custom_id": "3", "response": {"body": {"choices": [{"message": {"content": "sop"}}]}}}), "{broken", "", json.dumps({"custom_id": "x", "response": None}), json.dumps({"custom_id": "4", "response": None})]
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    assert {r.custom_id: r.answer for r in files.batch_answers(spark, str(tmp_path / "r.jsonl")).collect()} == {3: "sop", 4: ""}
    assert files.env("# c\nA=1=2\n\nB = 'x'\nnoise") == {"A": "1=2", "B": "x"}
    (tmp_path / "t.json").write_text(json.dumps([{"chunk_id": "a", "content": "c", "role": "sop", "role_confidence": "5"}, {"chunk_id": "b"}]))
    rows = {r.chunk_id: r for r in files.tagged(spark, str(tmp_path / "t.json")).collect()}
    assert rows["a"].role_confidence == 5 and rows["b"].tagged_by == "rule" and rows["b"].breadcrumb == []
    (tmp_path / "c.json").write_text(json.dumps([{"table_name": "n", "columns": ["x", "y"], "records": [{"x": "1", "y": ["a", "b"]}]}]))
    assert files.catalog_tables(spark, str(tmp_path / "c.json")).first().record == {"x": "1", "y": "a | b"}
    (tmp_path / "b.json").write_text(json.dumps([{"title": "t", "chunks": [{"title": "c", "content": "x"}]}]))
    block = files.blocks(spark, str(tmp_path / "b.json")).first()
    assert block.title == "t" and block.source_file == "" and block.chunks[0].content == "x"


def test_models_and_prompts(spark):
    chunks = spark.createDataFrame([(0, "path", "content")], "custom_id long, heading_path string, content string")
    asked = prompts.tagging(chunks).select("custom_id", F.col("messages")[0]["content"].alias("prompt"))
    assert models.with_answers(asked, models.Echo(), "prompt").first().answer == "content"
    assert len(models.with_embeddings(asked, models.Echo(4), "prompt").first().embedding) == 4
    requests = files.chat_requests(prompts.tagging(chunks), "m", 32, 0.0).first().value
    assert json.loads(requests)["body"]["messages"][0]["role"] == "user"
    assert chunks.select(prompts.question(F.lit("q"), F.lit("")).alias("x")).first().x == "q"
