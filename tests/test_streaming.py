from siltstone.operators.lines import explode_lines, parse
from siltstone.streaming.ingest import watch


def test_each_file_once(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for k, text in enumerate(("# A\nx", "plain")):
        (folder / f"{k}.md").write_text(text)
        query = watch(spark, str(folder), lambda docs: parse(explode_lines(docs)).select("source_file", "line_no", "heading_level"), target, str(tmp_path / "state"), once=True)
        query.awaitTermination()
    got = {(r.source_file, r.line_no, r.heading_level) for r in spark.read.parquet(target).collect()}
    assert got == {("0.md", 1, 1), ("0.md", 2, 0), ("1.md", 1, 0)}
