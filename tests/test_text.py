import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as tx


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("line", "level", "title"),
    [
        ("# Title", 1, "Title"),
        ("### 3.1 Deep", 3, "3.1 Deep"),
        ("# 6.3.1 Deeper", 3, "6.3.1 Deeper"),
        ("# 2016.6 x", 2, "2016.6 x"),
        ("###### 1.2.3.4.5.6 x", 5, "1.2.3.4.5.6 x"),
        ("一、总则", 1, "一、总则"),
        ("（二）范围", 2, "（二）范围"),
        ("3.1 气溶胶", 2, "3.1 气溶胶"),
        ("6.3.2.1", 4, "6.3.2.1"),
        ("0.25% 溶液", 0, ""),
        ("2016.6 年", 0, ""),
        ("3.5%", 0, ""),
        ("plain", 0, ""),
        ("#hash", 0, ""),
    ],
)
def test_heading(spark, line, level, title):
    assert tuple(one(spark, tx.heading, line)) == (level, title)


@pytest.mark.parametrize(("text", "tokens"), [("", 1), ("中文", 4), ("two words", 3), ("a1b22", 4), ("１２", 1), ("𠀀 x", 2), ("3", 1), ("3 4", 2)])
def test_token_estimate(spark, text, tokens):
    assert one(spark, tx.token_estimate, text) == tokens


def test_trim_takes_all_white_space(spark):
    assert one(spark, tx.utrim, "　  x \n") == "x"


def test_latex():
    clean = tx.latex_clean.func(pd.Series(["$0 . 5 \\mathsf { m l }$ of", "a $\\sim 3$ $x", None, "$$"]))
    assert clean.tolist() == ["0.5 m l of", "a ~ 3 $x", None, "$$"]


def test_clean_html(spark):
    assert one(spark, tx.clean_html, " <b>a</b>&amp;b<br/><br>c\t\td&nbsp;e ") == "a&b\nc d e"


def test_numbered_item(spark):
    assert one(spark, tx.is_numbered_item, "1、" + "x" * 50) is True
    assert one(spark, tx.is_numbered_item, "1. " + "x" * 49) is False
