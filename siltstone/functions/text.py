"""Text as columns: trims, token estimates, line patterns, headings."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, Settings

# --- fixed values: line patterns of the documents this engine reads ---
NOISE = (r"Tel[:：].*$", r"www\..*\.com.*$", r"\S+@\S+\.com.*$", r"德泰生物.*$", r"DETAIBIO\s*$", r"活性蛋白整体方案.*$", r"Active Protein Solutions\s*$")
TAIL = (r"#+\s*【?参考文献】?", r"#+\s*【?基本信息】?", r"#+\s*【?标识的解释】?", r"参考文献\s*$")
BOILERPLATE = (r"产品使用说明书\s*$", r".+Biotech\s+Co\.,?\s*Ltd\.?\s*$", r"版本号[:：].*$", r".+备案凭证编号.*$", r".+说明书核准日期.*$", r".+生产日期及失效日期.*$", r"第\s*\d+\s*页\s*共\s*\d+\s*页\s*$", r"售后服务电话[:：].*$")
#: What becomes of formulas, in this order: wrappers, the sign for about, braces, other commands, points between digits, runs of white space.
LATEX = (
    (r"\\(?:mathsf|mathrm|textrm|mathord|scriptscriptstyle|substack)\s*", ""),
    (r"\\(?:sim|~)", "~"),
    (r"[{}]", ""),
    (r"\\[a-zA-Z]+", ""),
    (r"(\d)\s*\.\s*(\d)", r"\1.\2"),
    (r"\s{2,}", " "),
)
ORDINAL = "[一二三四五六七八九十]+"
# --- end of fixed values ---


#: Unicode white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def utrim(text: Column) -> Column:
    """Trims all Unicode white space."""
    return F.trim(text, F.lit(WHITE))


def is_blank(text: Column) -> Column:
    """Whether there is nothing but white space."""
    return ~text.rlike(r"(?U)\S")


def starts_like(text: Column, patterns: tuple[str, ...], ignore_case: bool = False) -> Column:
    """Whether a text begins like one of the patterns. Those that begin with anything share one walk over the text instead of one each."""
    inner = [p[2:] for p in patterns if p.startswith(".+")]
    every = [p for p in patterns if not p.startswith(".+")] + ([".+(?:" + "|".join(inner) + ")"] if inner else [])
    return text.rlike(("(?iuU)" if ignore_case else "(?U)") + "^(?:" + "|".join(every) + ")")


def token_half(text: Column) -> Column:
    """Twice the token estimate without its final one: 3 for a CJK character, 2 for a Latin word, 1 for a number. Adds up over pieces that line ends separate."""
    cjk = F.length(text) - F.length(F.regexp_replace(text, "[\u4e00-\u9fff]", ""))
    return (3 * cjk + 2 * F.regexp_count(text, F.lit("[a-zA-Z]+")) + F.regexp_count(text, F.lit(r"(?U)\d+"))).cast("long")


def tokens_of(half: Column) -> Column:
    return F.floor(half / 2) + 1


def token_estimate(text: Column) -> Column:
    return tokens_of(token_half(text))


def is_image(text: Column) -> Column:
    return utrim(text).rlike(r"(?U)^!\[.*?\]\(.*?\)\s*$")


def is_table(text: Column) -> Column:
    return text.rlike(r"(?iU)^\s*<table")


def numbering_depth(text: Column) -> Column:
    """Depth of the numbering that a title begins with: parts of a dotted number, 1 for a CJK ordinal, 2 for one in brackets, else 0."""
    dotted = F.regexp_extract(text, r"(?U)^(\d+(?:[.．]\d+)*)", 1)
    return F.when(dotted != "", F.regexp_count(dotted, F.lit("[.．]")) + 1).when(text.rlike(f"^{ORDINAL}[、．.]"), 1).when(text.rlike(f"^[（(]{ORDINAL}[)）]"), 2).otherwise(0)


def _heading(text: Column, settings: Settings) -> Column:
    """struct(level, title) of a text that may be a heading."""
    hashes = F.regexp_extract(text, r"(?U)^(#{1,6})\s+(.*)", 1)
    title = utrim(F.regexp_extract(text, r"(?U)^(#{1,6})\s+(.*)", 2))
    depth = F.when(text.rlike(rf"(?U)^#{{1,6}}\s+[\d（({ORDINAL[1:-2]}]"), numbering_depth(title)).otherwise(0)
    marked = F.least(F.greatest(F.length(hashes), depth), F.lit(settings.heading_cap))
    numbers = F.regexp_extract(text, r"(?U)^(\d+(?:[.．]\d+)+)\s*(.*)", 1)
    rest = F.regexp_extract(text, r"(?U)^(\d+(?:[.．]\d+)+)\s*(.*)", 2)
    first = F.regexp_extract(numbers, r"(?U)^0*(\d+)", 1)
    chapter = (numbers != "") & (first != "0") & (F.length(first) <= 3) & ((rest == "") | rest.rlike(r"^[\u4e00-\u9fffA-Za-z(（]"))
    dotted = F.least(F.regexp_count(numbers, F.lit("[.．]")) + 1, F.lit(settings.heading_cap))
    level = F.when(text.rlike(f"^{ORDINAL}[、．.]"), 1).when(chapter, dotted).when(text.rlike(f"^[（(]{ORDINAL}[)）]"), 2).otherwise(0).cast("int")
    unmarked = F.transform(F.array(level), lambda n: F.struct(n.alias("level"), F.when(n > 0, text).otherwise("").alias("title")))
    return F.when(F.startswith(text, F.lit("#")), F.struct(marked.cast("int").alias("level"), title.alias("title"))).otherwise(F.get(unmarked, F.lit(0)))


def heading(text: Column, settings: Settings = DEFAULT) -> Column:
    """struct(level, title) of a cleaned line; level 0 for no heading. Hashes first, then CJK ordinals, dotted numbers, ordinals in brackets.

    Most lines begin like no heading, which one look tells. What the others need stands in a lambda, so that it doesn't make
    the code for all lines too large to be compiled."""
    maybe = text.rlike(rf"(?U)^(?:#{{1,6}}\s|\d+[.．]\d|{ORDINAL}[、．.]|[（(]{ORDINAL}[)）])")
    return F.when(maybe, F.get(F.transform(F.array(text), lambda t: _heading(t, settings)), F.lit(0))).otherwise(F.struct(F.lit(0).alias("level"), F.lit("").alias("title")))


def is_numbered_item(text: Column, settings: Settings = DEFAULT) -> Column:
    """A numbered paragraph with a long body."""
    return F.length(F.regexp_extract(utrim(text), r"(?U)^(\d+)[、.．]\s*(.+)", 2)) >= settings.numbered_item_min


def _plain(fragment: str) -> str:
    for pattern, by in LATEX:
        fragment = re.sub(pattern, by, fragment)
    return fragment.strip()


@F.pandas_udf(T.StringType())
def latex_clean(lines: pd.Series) -> pd.Series:
    """Formulas between dollar signs become plain text."""
    return lines.map(lambda x: x if x is None or "$" not in x else re.sub(r"\$([^$]+)\$", lambda m: _plain(m[1]), x))


def without_formulas(text: Column) -> Column:
    """latex_clean; texts without a dollar sign, which may be a whole table in a line, don't get to Python."""
    given = F.contains(text, F.lit("$"))
    return F.when(given, latex_clean(F.when(given, text))).otherwise(text)


@F.pandas_udf(T.StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None or "&" not in x else html.unescape(x))


def clean_html(fragment: Column, entities: bool = True) -> Column:
    """Line breaks for <br>, no tags, entities resolved, runs of line ends and of blanks as one."""
    text = F.regexp_replace(F.regexp_replace(fragment, "<br(?: ?/)?>", "\n"), "<[^>]+>", "")
    text = F.translate(html_unescape(text) if entities else text, "\u00a0", " ")
    for run, one in (("[\t\r\f\x0b]+", " "), ("\n+", "\n"), (" +", " ")):
        text = F.regexp_replace(text, run, one)
    return utrim(text)


def ordered_join(order: str, value: str, separator: str) -> Column:
    """Aggregate: the values in order, joined."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return F.array_join(F.transform(rows, lambda x: x["v"]), separator)
