"""Rule routing of queries, slots from a model's answer, and the branch that each query takes."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.text import utrim

# --- fixed values: markers and words of the model's answers ---
MARKER = r"\[NEED_RAG:([^\]]+)\]"
SLOT = r"[:：](?U)\s*(.+)"
HEDGES = ("我不确定", "我不太清楚", "可能需要", "建议查阅", "具体请参考", "不在我的知识范围", "无法确定")
ACTIVITY_NAMES = {
    "culture": "culture",
    "animal": "animal",
    "sample": "sample",
    "inactivated": "inactivated",
    "noninfectious": "noninfectious",
    "培养": "culture",
    "分离": "culture",
    "扩增": "culture",
    "动物": "animal",
    "攻毒": "animal",
    "样本": "sample",
    "检测": "sample",
    "灭活": "inactivated",
}
#: Rules in order: a command, what sets it off and what keeps it from being set off.
RULES = [
    {
        "command": "ShowProcedurePanel",
        "triggers": [r"(查看|显示|打开).*(步骤|流程|进度)", r"(做到哪|到哪一步|第几步)(了|啦|呢)?$", r"(当前|现在).*(步骤|进度)"],
        "excludes": [r"(如果|万一|假如|遇到|发生)", r"(怎么做|怎么处理|怎么操作|怎么配|如何).{4,}"],
    },
    {
        "command": "CurrentExperimentOperation",
        "triggers": [r"(当前|这一?步|现在).*(怎么[做操]|该[做干]什么)", r"(这步|这一步).*(是什么|做什么)"],
        "excludes": [r"(如果|万一|假如|遇到|发生)", r".{6,}(怎么做|下一步)"],
    },
    {
        "command": "ShowEquipmentName",
        "triggers": [r"(这个?|那个?)(设备|仪器|器材|东西).*(叫什么|是什么|名[字称])", r"(显示|查看).*(仪器|设备).*(名[字称]|标签)"],
        "excludes": [],
    },
    {
        "command": "SwitchExperimentScene",
        "triggers": [r"(切换|换|跳转|转到|进入).*(实验|场景|项目)", r"(我要?做|开始做?|打开).*实验"],
        "excludes": [],
    },
]
# --- end of fixed values ---


def rules(path: str | Path | None = None) -> list[dict]:
    """Rules in order, those of a JSON file if named: command, triggers and excludes (patterns)."""
    return json.loads(Path(path).read_text(encoding="utf-8")) if path else RULES


def route(query: Column, table: list[dict]) -> Column:
    """The command of the first rule of which a trigger and no exclude is in the query without its white space; null if none."""
    text = F.regexp_replace(query, r"(?U)\s+", "")
    any_of = lambda patterns: text.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)
    out = None
    for rule in table:
        hit = ~any_of(rule["excludes"]) & any_of(rule["triggers"])
        out = F.when(hit, rule["command"]) if out is None else out.when(hit, rule["command"])
    return F.when(text != "", out)


def router(queries: DataFrame, table: list[dict], settings: Settings = DEFAULT) -> DataFrame:
    """Adds command and confidence (both null where no rule fits)."""
    return queries.withColumn("command", route(F.col("query"), table)).withColumn("confidence", F.when(F.col("command").isNotNull(), settings.router_confidence))


def slots(outputs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Adds needs_rag, answer, roles, pathogen, activity, equipment, slot_query, hedging to (output, query). Roles are empty where the marker names none that is known (take query_roles then)."""
    marker = F.regexp_extract("output", MARKER, 1)
    needs = F.col("output").rlike(MARKER)
    known = [r for r in settings.roles if r != "junk"]
    roles = F.filter(F.transform(F.split(marker, ","), lambda r: F.lower(utrim(r))), lambda r: r.isin(*known))
    slot = lambda tag: F.when(needs, F.nullif(utrim(F.regexp_extract("output", tag + SLOT, 1)), F.lit("")))
    names = F.create_map(*(F.lit(x) for pair in ACTIVITY_NAMES.items() for x in pair))
    hedge = F.exists(F.array(*map(F.lit, HEDGES)), lambda h: F.contains("output", h))
    return outputs.select(
        "*",
        needs.alias("needs_rag"),
        F.when(~needs, utrim("output")).alias("answer"),
        F.when(needs, roles).otherwise(F.array().cast("array<string>")).alias("roles"),
        slot("PATHOGEN").alias("pathogen"),
        F.try_element_at(names, F.lower(F.coalesce(slot("ACTIVITY"), F.lit("")))).alias("activity"),
        slot("EQUIPMENT").alias("equipment"),
        F.when(needs, F.coalesce(slot("QUERY"), "query")).alias("slot_query"),
        (~needs & hedge).alias("hedging"),
    )


def branch(command: Column, needs_rag: Column, hedging: Column, has_retriever: Column, hits: Column, has_synthesizer: Column) -> Column:
    """Where a query's answer comes from."""
    return F.when(command.isNotNull(), "funcall").when(~needs_rag & ~hedging, "direct").when(~has_retriever, "need_rag").when(hits == 0, "direct_fallback").when(~has_synthesizer, "rag_raw").otherwise("rag")
