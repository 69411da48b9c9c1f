"""JSON arrays that are cut by bytes, against the whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from siltstone.sources import arrays


@pytest.mark.parametrize("cut", [61, 1 << 20])
def test_records_of_arrays_cut_anywhere(spark, tmp_path, cut):
    rng = random.Random(cut)
    word = lambda: "".join(rng.choice('ab{}[]"\\,: \n\té漢') for _ in range(rng.randrange(0, 40)))
    rows = [{"k": k, "a": word(), "b": {"x": [word(), {"y": word()}], "z": []}} for k in range(30)]
    rows[7]["a"] = "}" * 500 + '"' * 50  # longer than several stretches
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text(json.dumps(rows, ensure_ascii=False, indent=2))
    (tmp_path / "in" / "two.json").write_text("\n" + json.dumps(rows[:3]) + "\n")
    (tmp_path / "in" / "none.json").write_text("[]")
    (tmp_path / "in" / "odd.json").write_text('[1, "}{", null, [{"k": 5}, {"long": "' + "]" * 200 + '"}], {"k": 900}]')
    spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        found = arrays.records(spark, str(tmp_path / "in"))
        texts = [(r.file.rsplit("/", 1)[1], json.loads(r.value)) for r in found.orderBy("file", "start", "seq").collect()]
        stretches = arrays._pieces(spark, str(tmp_path / "in")).select("file", "start").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [x for f, x in texts if f == "one.json"] == rows and [x for f, x in texts if f == "two.json"] == rows[:3]
    assert [x for f, x in texts if f == "odd.json"] == [{"k": 900}] and not [f for f, _ in texts if f == "none.json"]
    assert stretches > 40 if cut == 61 else stretches >= 4


def test_broken_records_are_told_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"k": 1}, {"k": "x"}, {"k" 3}, {"k": 4, "more": true}, {"k": 5')
    good, bad = arrays.read(spark, str(tmp_path / "a.json"), "k int")
    assert sorted(r.k for r in good.collect()) == [1, 4]
    assert sorted(r.value for r in bad.collect()) == ['{"k" 3}', '{"k": "x"}', '{"k": 5']


def test_written_arrays_are_read_back(spark, tmp_path):
    df = spark.range(0, 1000, 1, 5).select("id", F.concat(F.lit("x}\n\""), F.col("id")).alias("text"), F.array(F.struct("id")).alias("list"))
    arrays.save_array(df.where("id < 100 or id > 400"), str(tmp_path / "out"))
    files = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part")]
    assert len(files) > 2 and sum(len(json.loads(p.read_text())) for p in files) == 699
    good, bad = arrays.read(spark, str(tmp_path / "out"), "id bigint, text string, list array<struct<id:bigint>>")
    assert sorted(map(tuple, good.select("id", "text").collect())) == sorted(map(tuple, df.where("id < 100 or id > 400").select("id", "text").collect())) and bad.count() == 0
