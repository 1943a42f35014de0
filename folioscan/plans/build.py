"""Word banks and rules that a reviewer makes of wishes, pasted texts and documents, many at a time, in two stages for documents.

A document is first asked for its points, within a budget of characters, and the points for banks and rules; a document with hardly any points is asked directly.
Every stage keeps its answers (``plans.answers``), so a run that is broken off and begun again asks only what is still open. Answers that
hold nothing are asked for once more.

Requests are told apart by id, which has to be unique and not null. Null texts are empty. What fails is told with a reason; it never stops the others.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions.text import clip, strip
from folioscan.plans import answers, review
from folioscan.staging import stage
from folioscan.store import Store

#: Most characters of a request by its kind, and of the points; what stands before a text; what is said of requests that fail, and of documents without points.
BUDGETS, POINTS = {"dialogue": 2000, "text": 6000, "doc": 2500}, 2000
LEADS = {"dialogue": "用户需求：\n", "text": "用户粘贴的准则/规范/范本文本：\n", "doc": "上传文档内容：\n"}
FROM_POINTS = "以下是根据上传文档提取的检测要点，请据此生成词库与规则：\n"
EMPTY = {"dialogue": "需求不能为空", "text": "粘贴内容不能为空", "doc": "文档有效文本过少，无法提取"}
LEAST = {"dialogue": 1, "text": 1, "doc": 20}
NO_POINTS, DIRECT = "要点提取为空（本地模型思考过长被截断）", "生成完成（要点提取为空，已直接生成）"
NO_JSON, BAD_JSON, UNKNOWN, DONE = "模型未返回 JSON 对象", "模型返回的 JSON 无法解析：", "不支持的创建方式", "生成完成"


@dataclass
class Built:
    """``banks`` and ``rules`` as ``review.generated`` gives them; ``outcome``: id, ok, message."""

    banks: DataFrame
    rules: DataFrame
    outcome: DataFrame


def _by_kind(values: Mapping[str, object]) -> Column:
    return F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in values.items()))


def _read(asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Banks, rules, failures (id, error) and the ids of answers that hold neither, of asked requests (id, content, error)."""
    no_json = F.when(F.contains("content", F.lit("{")) & F.contains("content", F.lit("}")), F.concat(F.lit(BAD_JSON), clip(strip(F.col("content")), 80))).otherwise(NO_JSON)
    told = stage(asked.select("id", F.coalesce("error", no_json).alias("error"), review.repair_json("content").alias("json")), "told")
    banks, rules, broken = (stage(x, "made") for x in review.generated(told.where("json is not null").select("id", "json")))
    missing = told.where("json is null").select("id", "error")
    failed = broken.select("id", "error").unionByName(missing)
    full = banks.select("id").union(rules.select("id")).distinct()
    return banks, rules, failed, told.select("id").join(full.union(failed.select("id")), "id", "left_anti")


def build(requests: DataFrame, reviewer: Callable[[str], str], kept: Store, prompts: Mapping[str, str], **how) -> Built:
    """Banks, rules and outcomes of ``requests`` (id, kind: dialogue, text or doc, text).

    ``prompts``: what the reviewer is told before a text: ``points`` (documents, first), ``doc`` (documents and texts) and ``dialogue``. ``how`` goes to ``answers.ask``.
    """
    text = strip(F.coalesce("text", F.lit("")))
    rows = stage(requests.select("id", "kind", text.alias("text")), "builds")
    refused = F.when(_by_kind(LEAST).isNull(), UNKNOWN).when(F.length("text") < _by_kind(LEAST), _by_kind(EMPTY))
    rows = rows.withColumn("refused", refused)
    body = F.when(F.length("text") > _by_kind(BUDGETS), F.concat(F.expr("left(text, " + "case kind " + " ".join(f"when '{k}' then {n}" for k, n in BUDGETS.items()) + " end)"), F.lit("…"))).otherwise(F.col("text"))
    good = rows.where("refused is null").select("id", "kind", body.alias("text"))
    ask = lambda found, mode: answers.ask(found, reviewer, kept, **{**how, "mode": f"{how.get('mode', 'local')}/{mode}"})

    documents = good.where("kind = 'doc'").select("id", "kind", "text", F.concat_ws("\n\n", F.lit(prompts["points"]), "text").alias("prompt"))
    first = stage(ask(documents, "points").withColumn("points", strip(F.coalesce("content", F.lit("")))), "points")
    no_points = first.where("error is not null or length(points) < 5").select("id", F.coalesce("error", F.lit(NO_POINTS)).alias("error"))
    direct = F.length("points") < 10
    second = first.join(no_points, "id", "left_anti").select("id", "kind", F.when(direct, F.concat(F.lit(LEADS["doc"]), "text")).otherwise(F.concat(F.lit(FROM_POINTS), clip(F.col("points"), POINTS))).alias("text"), direct.alias("direct"))
    others = good.where("kind <> 'doc'").select("id", "kind", F.concat(_by_kind(LEADS), "text").alias("text"), F.lit(False).alias("direct"))
    told = F.when(F.col("kind") == "dialogue", F.lit(prompts["dialogue"])).otherwise(F.lit(prompts["doc"]))
    final = stage(second.unionByName(others).withColumn("prompt", F.concat_ws("\n\n", told, "text")), "final")

    banks, rules, failed, empty = _read(ask(final, "build"))
    again = stage(final.join(empty, "id", "left_semi"), "again")
    more = _read(ask(again, "again"))
    banks, rules = banks.unionByName(more[0]), rules.unionByName(more[1])
    failed = rows.where("refused is not null").select("id", F.col("refused").alias("error")).unionByName(no_points).unionByName(failed).unionByName(more[2])
    done = final.join(failed, "id", "left_anti").select("id", F.lit(True).alias("ok"), F.when(F.col("direct"), DIRECT).otherwise(DONE).alias("message"))
    return Built(banks, rules, done.unionByName(failed.select("id", F.lit(False).alias("ok"), F.col("error").alias("message"))))
