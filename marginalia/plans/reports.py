"""Registered jobs on whole reports: adjustments, revisions and texts, written from numbers that the extraction must find again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators import documents

from .domain import Domain, sql
from .registry import query


def whole_reports(d: Domain) -> DataFrame:
    """A report for each record: id % 4 = 0 states no score, id % 3 + 1 revisions, id % 2 + 1 points against, two quoted strengths, texts of the id."""
    i = F.col("id").cast("string")
    score = F.when(F.col("id") % 4 == 0, "").otherwise(F.concat(F.lit("最终得分："), F.col("total_score").cast("string"), F.lit("分\n")))
    dimension = F.concat(F.lit("#### 思辨深度（12/20分）\n- 有见地\n\n- [如为亮点] 原文引用：“句"), i, F.lit("” —— 好\n- 原文引用：“另句” —— 也好\n- **扣分原因**：浅\n"))
    minus = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("id") % 2 + 1).cast("int")), lambda k: F.concat(F.lit("- 缺点"), k.cast("string"), F.lit("（-"), (k + 2).cast("string"), F.lit("分）\n"))), "")
    one = lambda k: F.concat(F.lit("#### 修改 "), k.cast("string"), F.lit("：类"), k.cast("string"), F.lit("\n**位置**：第"), i, F.lit("段\n**原文**：“旧"), i, F.lit("”\n**问题分析**：因\n**修改建议**：“新"), k.cast("string"), F.lit("”\n**修改理由**：更好\n\n"))
    revisions = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("id") % 3 + 1).cast("int")), one), "")
    parts = [
        F.lit("# 报告\n"), score, F.lit("一句话总结\n“立意"), i, F.lit("”清楚\n\n### 定档理由\n理由"), i, F.lit("\n---\n"), dimension, F.lit("\n**加分项：**\n- 亮点（+2分）\n\n**扣分项：**\n"), minus,
        F.lit("---\n**分数计算**\n\n"), revisions, F.lit("### 整体评价\n总评"), i, F.lit("\n---\n要进入二类卷，先，需要：改"), i, F.lit("\n要进入一类卷（更难），需要：练\n"),
    ]
    return d.records().select("id", "total_score", F.concat(*parts).alias("content"))


def read(d: Domain) -> DataFrame:
    return documents.reports(whole_reports(d).drop("total_score"))


@query(sql("""SELECT id, 'plus' AS side, '亮点' AS reason, CAST(2 AS BIGINT) AS points FROM records UNION ALL SELECT id, 'minus', '缺点1', -3 FROM records UNION ALL SELECT id, 'minus', '缺点2', -4 FROM records WHERE id % 2 = 1"""))
def report_adjustments(d: Domain) -> DataFrame:
    side = lambda name: F.transform(f"adjustments.{name}", lambda x: F.struct(F.lit(name).alias("side"), x["reason"].alias("reason"), x["points"].alias("points")))
    return read(d).select("id", F.inline(F.concat(side("plus"), side("minus"))))


@query(sql("""SELECT id, CAST(k AS BIGINT) AS k, '类' || k AS category, '第' || id || '段' AS location, '旧' || id AS original, '新' || k AS suggested, '更好' AS reason FROM records, (SELECT unnest([1, 2, 3]) AS k) WHERE k <= id % 3 + 1"""))
def report_revisions(d: Domain) -> DataFrame:
    rows = read(d).select("id", F.posexplode("revisions").alias("i", "r"))
    return rows.select("id", (F.col("i") + 1).cast("long").alias("k"), "r.category", "r.location", "r.original", "r.suggested", "r.reason")


@query(sql("""SELECT id, CASE WHEN id % 4 = 0 THEN 0 ELSE total_score END AS total_score, '立意' || id || '清楚' AS summary, '理由' || id AS grading_reason, '总评' || id AS overall, '句' || id || ' —— 好/另句 —— 也好' AS strengths, '改' || id AS to_class2, '练' AS to_class1,
    CASE WHEN id % 4 = 0 OR total_score = 0 THEN '自动解析失败' ELSE '' END AS parse_error, CASE WHEN id % 4 = 0 OR total_score = 0 THEN '解析中' ELSE '' END AS grade FROM records"""))
def report_texts(d: Domain) -> DataFrame:
    strengths = F.array_join(F.col("dimensions")["思辨深度"]["strengths"], "/")
    return read(d).select(
        "id", "total_score", F.col("one_sentence_summary").alias("summary"), "grading_reason", "overall", strengths.alias("strengths"), "upgrade_path.to_class2", "upgrade_path.to_class1",
        F.coalesce("parse_error", F.lit("")).alias("parse_error"), "grade",
    )


def broken_reports(d: Domain) -> DataFrame:
    """A report for each record, by id % 6: whole, a section missing, one twice, half-width marks, labels without values, a full score of 0."""
    i, v, n = F.col("id").cast("string"), F.col("id") % 6, (F.col("n_chars") % 19 + 1).cast("string")
    by = lambda plain, **other: F.when(v == 3, other["half"]).when(v == 4, other.get("empty", plain)).otherwise(plain)
    score = by(F.concat(F.lit("最终得分："), F.col("total_score").cast("string"), F.lit("分\n")), half=F.concat(F.lit("最终得分: "), F.col("total_score").cast("string"), F.lit("分\n")), empty=F.lit("最终得分：\n"))
    head = lambda name, n: by(F.concat(F.lit(f"#### {name}（"), n, F.lit("/"), F.when(v == 5, "0").otherwise("25"), F.lit("分）\n")), half=F.concat(F.lit(f"#### {name}("), n, F.lit("/25)\n")))
    body = lambda word: by(F.concat(F.lit(f"- {word}"), i, F.lit("\n- **扣分原因**：因"), i, F.lit("\n")), half=F.concat(F.lit(f"- {word}"), i, F.lit("\n- **扣分原因**: 因"), i, F.lit("\n")), empty=F.concat(F.lit(f"- {word}"), i, F.lit("\n- **扣分原因**：\n")))
    first = F.concat(head("审题立意", n), body("切题"))
    twice = F.when(v == 2, F.concat(head("审题立意", F.lit("3")), body("再评"))).otherwise("")
    second = F.when(v == 1, "").otherwise(F.concat(head("结构布局", F.lit("9")), F.lit("\n")))
    revision = F.concat(F.lit("#### 修改 1：语言\n**位置**：首段\n**原文**：旧\n"), by(F.lit("**问题分析**：因\n"), half=F.lit("**问题分析**: 因\n"), empty=F.lit("**问题分析**：\n")), F.lit("**修改建议**：新\n**修改理由**：好\n"))
    return d.records().select("id", F.concat(score, F.lit("\n"), first, second, twice, revision).alias("content"))


@query(sql("""SELECT id, v = 4 OR total_score = 0 AS unscored, CASE WHEN v = 4 THEN 0 ELSE total_score END AS total_score, n_chars % 19 + 1 AS score, CAST(CASE WHEN v = 5 THEN 20 ELSE 25 END AS BIGINT) AS "full", '切题' || id || chr(10) || CASE v WHEN 3 THEN '扣分原因**: 因' || id WHEN 4 THEN '扣分原因**：' ELSE '扣分原因**：因' || id END AS evaluation,
    CASE WHEN v = 4 THEN '' ELSE '因' || id END AS reason, CAST(CASE WHEN v = 1 THEN 1 ELSE 2 END AS BIGINT) AS dimensions, CASE WHEN v = 1 THEN '' ELSE '暂无评价' END AS bare, CAST(CASE WHEN v = 4 THEN 0 ELSE 1 END AS BIGINT) AS revisions FROM (SELECT *, id % 6 AS v FROM records)"""))
def report_sections(d: Domain) -> DataFrame:
    """Reports with missing, repeated, half-width and empty parts; a repeated section counts where it stands first."""
    r, dim = documents.reports(broken_reports(d)), F.col("dimensions")["审题立意"]
    return r.select(
        "id", (F.coalesce("parse_error", F.lit("")) != "").alias("unscored"), "total_score", dim["score"].alias("score"), dim["full"].alias("full"), dim["evaluation"].alias("evaluation"), dim["deduction_reason"].alias("reason"),
        F.size("dimensions").cast("long").alias("dimensions"), F.coalesce(F.col("dimensions")["结构布局"]["evaluation"], F.lit("")).alias("bare"), F.size("revisions").cast("long").alias("revisions"),
    )


@query(sql("""SELECT id, heading, label, CAST(count(*) AS BIGINT) AS n, max(value) AS value FROM (
    SELECT id, '' AS heading, '最终得分' AS label, CASE WHEN v = 4 THEN '' ELSE total_score || '分' END AS value FROM b
    UNION ALL SELECT id, CASE WHEN v = 3 THEN '审题立意(' || s || '/25)' WHEN v = 5 THEN '审题立意（' || s || '/0分）' ELSE '审题立意（' || s || '/25分）' END, '扣分原因', CASE WHEN v = 4 THEN '' ELSE '因' || id END FROM b
    UNION ALL SELECT id, '审题立意（3/25分）', '扣分原因', '因' || id FROM b WHERE v = 2
    UNION ALL SELECT id, '修改 1：语言', unnest(['位置', '原文', '问题分析', '修改建议', '修改理由']), unnest(['首段', '旧', CASE WHEN v = 4 THEN '' ELSE '因' END, '新', '好']) FROM b) GROUP BY ALL""",
    "b AS (SELECT id, id % 6 AS v, total_score, n_chars % 19 + 1 AS s FROM records)"))
def report_labels(d: Domain) -> DataFrame:
    """The same reports as rows of heading, label and value, counted: what is missing has no row, what is repeated has two."""
    rows = documents.report_rows(broken_reports(d))
    return rows.groupBy("id", "heading", "label").agg(F.count("*").alias("n"), F.max("value").alias("value"))
