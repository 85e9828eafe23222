"""Registered jobs on exam papers, graded reports, damaged JSON and the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import columns as C
from marginalia.operators import documents, papers
from marginalia.sources import tables

from .domain import SQL_FMT, Domain, said, sql
from .registry import query

ANSWERS, LETTERS, GIVEN = ("A", "b", "C. x", "", "D"), ("A", "B", "C", "D"), ("B", "", None)
OPTIONS = ("A. one", "B. two", "C. three", "D. four")
#: Blocks after a question's own: by part % 4, a letter alone, a text, two letters, a letter not alone.
LATER = (("note", " C "), ("note",), ("B", "D"), ("B or C",))


def _pick(values, index):
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def _sql_pick(values, index: str) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values)) + " END"


def questions(d: Domain) -> DataFrame:
    text = F.when(F.col("part") % 3 == 0, F.concat(F.lit("12. 、"), F.substring("p_name", 1, 4))).otherwise(F.concat(F.lit("3. "), F.col("p_name"), F.lit(" question")))
    rows = d.errors().join(d.read("part").select(F.col("p_partkey").alias("part"), "p_name"), "part")
    later = F.get(F.array(*[F.array(*map(F.lit, x)) for x in LATER]), (F.col("part") % 4).cast("int"))
    return rows.select(
        F.col("session_id").alias("paper"), "number", (F.col("supplier") % 3 + 1).alias("page"), text.alias("question_text"), F.when(F.col("part") % 2 == 0, "选择题").otherwise("填空题").alias("question_type"),
        _pick(ANSWERS, F.col("part") % 5).alias("student_answer"), _pick(LETTERS, F.col("supplier") % 4).alias("correct_answer"), F.array(*map(F.lit, OPTIONS)).alias("options"),
        F.concat(F.array(F.lit("D")), later).alias("blocks"),
    )


def marks(d: Domain) -> DataFrame:
    mark = F.when(F.col("l_discount") >= 0.08, "-2").when(F.col("l_quantity") > 45, "?").when(F.col("l_returnflag") == "A", "✗").when(F.col("l_returnflag") == "R", "✓")
    return d.read("lineitem").select(
        F.col("l_orderkey").alias("paper"), F.col("l_linenumber").cast("long").alias("number"), F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"),
        mark.alias("mark"), _pick(GIVEN, F.col("l_partkey") % 3).alias("answer"), F.when(F.col("l_suppkey") % 2 == 0, "note").otherwise("").alias("extra"),
    ).where("mark is not null")


_Q = f"""q AS (SELECT session_id AS paper, number, supplier % 3 + 1 AS page, CASE WHEN part % 3 = 0 THEN '12. 、' || substr(p_name, 1, 4) ELSE '3. ' || p_name || ' question' END AS question_text,
    CASE WHEN part % 2 = 0 THEN '选择题' ELSE '填空题' END AS question_type, {_sql_pick(ANSWERS, "part % 5")} AS student_answer, {_sql_pick(LETTERS, "supplier % 4")} AS correct_answer, CASE part % 4 WHEN 0 THEN 'C' WHEN 2 THEN 'B' ELSE '' END AS shown
    FROM errors JOIN part ON p_partkey = part)"""
_M = f"""m AS (SELECT paper, number, mark, answer, extra FROM (SELECT l_orderkey AS paper, l_linenumber AS number, CASE WHEN l_discount >= 0.08 THEN '-2' WHEN l_quantity > 45 THEN '?' WHEN l_returnflag = 'A' THEN '✗'
    WHEN l_returnflag = 'R' THEN '✓' END AS mark, {_sql_pick(GIVEN, "l_partkey % 3")} AS answer, CASE WHEN l_suppkey % 2 = 0 THEN 'note' ELSE '' END AS extra, l_shipdate, l_partkey, l_suppkey, l_extendedprice FROM lineitem)
    WHERE mark IS NOT NULL QUALIFY row_number() OVER (PARTITION BY paper, number ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1)"""
_MERGED = """g AS (SELECT q.* EXCLUDE (student_answer), CASE WHEN q.student_answer = '' AND m.mark IS NOT NULL THEN shown ELSE q.student_answer END AS student_answer, m.mark IS NULL OR m.mark = '✓' AS is_correct, CASE WHEN m.mark IS NULL THEN 'medium' WHEN m.mark = '?' THEN 'low' ELSE 'high' END AS confidence, coalesce(m.mark, '无标记') AS grading_mark,
    m.mark IS NOT NULL AS has_red_ink, CASE WHEN m.mark IS NULL THEN '' ELSE concat_ws(' ', m.mark, nullif(m.answer, ''), nullif(m.extra, '')) END AS red_ink,
    CASE WHEN m.mark IN ('-2', '✗') AND m.answer = 'B' THEN 'B. two' ELSE q.correct_answer END AS fixed_answer, q.student_answer = '' AND shown = '' AND NOT (m.mark IS NULL OR m.mark = '✓') AS is_unanswered FROM q LEFT JOIN m USING (paper, number))"""


def merged(d: Domain) -> DataFrame:
    return papers.merge_marks(questions(d), marks(d), ["paper"])


@query(sql("SELECT paper, number, is_correct, confidence, grading_mark, has_red_ink, red_ink, fixed_answer AS correct_answer, student_answer, is_unanswered FROM g", _Q, _M, _MERGED))
def mark_merge(d: Domain) -> DataFrame:
    return merged(d).select("paper", "number", "is_correct", "confidence", "grading_mark", "has_red_ink", "red_ink", "correct_answer", "student_answer", "is_unanswered")


@query(sql("""SELECT paper, count(*) FILTER (is_correct) AS correct, count(*) FILTER (NOT is_correct) AS wrong, count(*) FILTER (is_unanswered) AS unanswered, count(*) FILTER (student_answer <> '') AS answered FROM g GROUP BY 1""", _Q, _M, _MERGED))
def merge_counts(d: Domain) -> DataFrame:
    return papers.merge_counts(merged(d), ["paper"])


_VALID = """v AS (SELECT *, red_ink <> '' AND answer <> '' AND answer <> fixed_answer AND is_correct AS r3, grading_mark LIKE '%-2%' AND is_correct AS r4 FROM
    (SELECT *, CASE WHEN question_type = '选择题' AND upper(substr(trim(student_answer), 1, 1)) IN ('A', 'B', 'C', 'D') THEN upper(substr(trim(student_answer), 1, 1)) ELSE student_answer END AS answer FROM g))"""


@query(sql("""SELECT paper, count(*) AS total, count(*) FILTER (NOT r3 AND NOT r4) AS valid, count(*) FILTER (r3 OR r4) AS flagged, count(*) FILTER (NOT (is_correct AND NOT r3 AND NOT r4) AND NOT is_unanswered) AS wrong,
    count(*) FILTER (is_unanswered) AS unanswered FROM v GROUP BY 1""", _Q, _M, _MERGED, _VALID))
def scan_validation(d: Domain) -> DataFrame:
    return papers.validation_counts(papers.validated(merged(d)), ["paper"])


_WRONG = "w AS (SELECT *, length(regexp_replace(question_text, '[0-9.、\\s]', '', 'g')) >= 8 AS stem FROM g WHERE NOT is_correct)"


@query(sql("""SELECT paper, number, stem AS kept, CASE WHEN stem THEN question_text ELSE '(无题干，听力题)' END AS question_text, CASE WHEN stem THEN '' ELSE '第' || number || '题（' || question_type || '）' END AS topic,
    CASE WHEN stem THEN 0 ELSE 3 END AS difficulty FROM w""", _Q, _M, _MERGED, _WRONG))
def keep_skip_split(d: Domain) -> DataFrame:
    kept, skipped = papers.kept_and_skipped(merged(d).where(~F.col("is_correct")))
    kept = kept.select("paper", "number", F.lit(True).alias("kept"), "question_text", F.lit("").alias("topic"), F.lit(0).alias("difficulty"))
    return kept.unionByName(skipped.select("paper", "number", F.lit(False).alias("kept"), "question_text", "topic", "difficulty"))


_BLOCK = """'【错题 ' || place || '】原题号第' || number || '题（' || question_type || '）' || chr(10) || '  题目：' || question_text || chr(10) || '  选项：A. one | B. two | C. three | D. four' || chr(10) || '  学生作答：'
    || CASE WHEN student_answer = '' THEN '（未作答）' ELSE student_answer END || chr(10) || '  正确答案：' || fixed_answer || chr(10) || '  批改标记：' || grading_mark || chr(10) || '  红笔批注：' || CASE WHEN red_ink = '' THEN '无' ELSE red_ink END
    || chr(10) || '  置信度：' || confidence"""


@query(sql(f"""SELECT paper, batch, count(*) AS n, string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY place) AS text
    FROM (SELECT *, (row_number() OVER o - 1) // 4 AS batch, (row_number() OVER o - 1) % 4 + 1 AS place FROM w WHERE stem WINDOW o AS (PARTITION BY paper ORDER BY number)) GROUP BY 1, 2""", _Q, _M, _MERGED, _WRONG))
def question_batches(d: Domain) -> DataFrame:
    kept, _ = papers.kept_and_skipped(merged(d).where(~F.col("is_correct")))
    return papers.rendered(papers.batched(kept, ["paper"], [F.col("number")], size=4), ["paper"])


_A = """a AS (SELECT session_id AS paper, number, error_type AS a_type, difficulty AS a_difficulty FROM versions QUALIFY row_number() OVER (PARTITION BY session_id, number ORDER BY created_at, part, supplier, price) = 1)"""


def attached(d: Domain) -> DataFrame:
    analyses = d.versions().withColumnRenamed("session_id", "paper").where("part % 4 <> 1")
    return papers.with_analysis(merged(d).where(~F.col("is_correct")), analyses, ["paper"], [F.col("created_at"), F.col("part"), F.col("supplier"), F.col("price")])


_ATTACHED = _A.replace("FROM versions", "FROM versions WHERE part % 4 <> 1") + """, t AS (SELECT g.*, a.paper IS NOT NULL AS analysed, CASE WHEN student_answer = '' THEN '知识盲区' WHEN coalesce(a_type, '') = '' THEN '未知' ELSE a_type END AS error_type,
    CAST(CASE WHEN coalesce(a_difficulty, 0) = 0 THEN 3 ELSE least(5, a_difficulty) END AS BIGINT) AS difficulty FROM g LEFT JOIN a USING (paper, number) WHERE NOT is_correct)"""


@query(sql("SELECT paper, number, page, analysed, error_type, difficulty FROM t", _Q, _M, _MERGED, _ATTACHED))
def paper_rows(d: Domain) -> DataFrame:
    return attached(d).select("paper", "number", "page", "analysed", "error_type", "difficulty")


@query(sql("SELECT s.id, s.status, coalesce(n, 0) AS error_count, coalesce(saved, 0) AS saved, coalesce(skipped, 0) AS skipped FROM sessions s LEFT JOIN (SELECT paper, count(*) AS n, count(*) FILTER (analysed) AS saved, count(*) FILTER (NOT analysed) AS skipped FROM t GROUP BY 1) ON paper = s.id", _Q, _M, _MERGED, _ATTACHED))
def session_rollup(d: Domain) -> DataFrame:
    """Counters of each session written back by the patch of the store."""
    counts = attached(d).groupBy(F.col("paper").alias("id")).agg(F.count("*").alias("error_count"), F.count_if("analysed").alias("saved"), F.count_if(~F.col("analysed")).alias("skipped"))
    zero = {c: F.lit(0).cast("long") for c in ("error_count", "saved", "skipped")}
    base = tables.evolve(d.sessions(), zero | {"updated_at": F.col("created_at")})
    return tables.patch(base, counts, "id", ["error_count", "saved", "skipped"], F.current_timestamp()).select("id", "status", "error_count", "saved", "skipped")


@query(sql("""SELECT paper, number, CASE correct_answer WHEN 'A' THEN 'A. one' WHEN 'B' THEN 'B. two' WHEN 'C' THEN 'C. three' ELSE 'D. four' END AS full_option, CASE WHEN upper(substr(trim(student_answer), 1, 1)) IN ('A', 'B', 'C', 'D')
    THEN upper(substr(trim(student_answer), 1, 1)) ELSE student_answer END AS letter, CASE correct_answer WHEN 'A' THEN 'one' WHEN 'B' THEN 'two' WHEN 'C' THEN 'three' ELSE 'four' END AS body FROM q""", _Q))
def question_fields(d: Domain) -> DataFrame:
    full = C.option_of(F.col("options"), F.col("correct_answer"))
    return questions(d).select("paper", "number", full.alias("full_option"), C.answer_letter(F.col("student_answer")).alias("letter"), C.option_body(full).alias("body"))


@query(sql("""SELECT id, total_score, CASE WHEN total_score >= 49 THEN 'high' WHEN total_score >= 35 THEN 'middle' ELSE 'low' END AS ratio, CASE WHEN total_score >= 56 THEN 'high' WHEN total_score >= 42 THEN 'middle' ELSE 'low' END AS band,
    CASE WHEN total_score >= 63 THEN 1 WHEN total_score >= 52 THEN 2 WHEN total_score >= 39 THEN 3 WHEN total_score >= 21 THEN 4 ELSE 5 END AS tier, CAST(round(100.0 * total_score / 70) AS BIGINT) AS percent FROM records"""))
def result_bands(d: Domain) -> DataFrame:
    s = F.col("total_score")
    return d.records().select("id", "total_score", C.ratio_band(s, F.lit(70)).alias("ratio"), C.score_band(s).alias("band"), C.grade_tier(C.grade_band(s)).alias("tier"), C.percent(s, F.lit(70)).cast("long").alias("percent"))


@query(sql("""SELECT id, CASE WHEN n_chars >= 500 THEN 0 WHEN n_chars >= 400 THEN 1 ELSE ceil((400 - n_chars) / 50.0) END::BIGINT AS deduction, CASE WHEN n_chars < 400 THEN 45 ELSE 70 END AS cap, least(n_chars % 13 // 3, 3)::BIGINT AS typos,
    CAST(round(total_score * 70 / 100.0) AS BIGINT) AS scaled, CASE WHEN total_score >= 68 THEN '一类上' WHEN total_score >= 65 THEN '一类中' WHEN total_score >= 63 THEN '一类下' WHEN total_score >= 59 THEN '二类上' WHEN total_score >= 55 THEN '二类中'
    WHEN total_score >= 52 THEN '二类下' WHEN total_score >= 39 THEN '三类' WHEN total_score >= 21 THEN '四类' WHEN total_score >= 17 THEN '五类上' WHEN total_score >= 10 THEN '五类中' ELSE '五类下' END AS band FROM records"""))
def rubric_bands(d: Domain) -> DataFrame:
    n, s = F.col("n_chars"), F.col("total_score")
    return d.records().select("id", C.length_deduction(n).cast("long").alias("deduction"), C.length_cap(n).alias("cap"), C.typo_deduction(n % 13).cast("long").alias("typos"), C.scaled(s).cast("long").alias("scaled"), C.grade_band(s).alias("band"))


def reports(d: Domain) -> DataFrame:
    """Reports in Markdown, written from numbers that the extraction must find again."""
    num = lambda c: c.cast("string")
    dims = [F.col("n_chars") % (7 + i) + 5 for i in range(5)]
    raw = dims[0] + dims[1] + dims[2] + dims[3] + dims[4]
    parts = [F.lit("# 批改报告\n最终评分：**"), F.lit("\n最终得分："), num(F.col("total_score")), F.lit("分\n档位："), F.when(F.col("total_score") > 30, "二").otherwise("三"), F.lit("\n**字数统计**："), num(F.col("n_chars")), F.lit("\n")]
    for name, v in zip(documents.DIMENSIONS, dims):
        parts += [F.lit(f"\n#### {name}（"), num(v), F.lit("/20分）\n- 评价文字\n- **扣分原因**："), F.lit("理由"), num(v), F.lit("\n")]
    parts += [F.lit("\n**加分项：**\n- 思辨锐度（+3分）\n\n**扣分项：**\n- 套作痕迹（-5分）\n- 语言空洞（-"), num(F.col("n_chars") % 4), F.lit("分）\n---\n**分数计算**\n**维度得分之和**："), num(raw), F.lit("\n**调整后100分制**："), num(raw - 2 - F.col("n_chars") % 4)]
    parts += [F.lit("\n\n#### 修改 1：语言\n**位置**：第"), num(F.col("id") % 9), F.lit("段\n**原文**：“旧句”\n**问题分析**：重复\n**修改建议**：“新句"), num(F.col("id")), F.lit("”\n**修改理由**：更准\n\n**对该学生的建议：**\n1. 多读\n2. 多写"), num(F.col("id") % 5), F.lit("\n")]
    return d.records().select("id", "total_score", F.concat(*parts).alias("content"))


_RAW = " + ".join(f"n_chars % {7 + i} + 5" for i in range(5))


@query(sql(f"""SELECT id, total_score, CASE WHEN total_score > 30 THEN '二类卷' ELSE '三类卷' END AS grade, n_chars AS word_count, {_RAW} AS raw_score, {_RAW} - 2 - n_chars % 4 AS adjusted_score, {", ".join(f"n_chars % {7 + i} + 5 AS d{i}" for i in range(5))},
    '理由' || (n_chars % 7 + 5) AS reason, CAST(1 AS BIGINT) AS n_plus, CAST(2 AS BIGINT) AS n_minus, -5 - n_chars % 4 AS minus, '新句' || id AS suggested, '多写' || id % 5 AS advice FROM records"""))
def report_extract(d: Domain) -> DataFrame:
    r = documents.reports(reports(d).drop("total_score"))
    dims = [F.col("dimensions")[n]["score"].alias(f"d{i}") for i, n in enumerate(documents.DIMENSIONS)]
    minus = F.aggregate("adjustments.minus", F.lit(0).cast("long"), lambda a, x: a + x["points"])
    return r.select(
        "id", "total_score", "grade", "word_count", "raw_score", "adjusted_score", *dims, F.col("dimensions")[documents.DIMENSIONS[0]]["deduction_reason"].alias("reason"), F.size("adjustments.plus").cast("long").alias("n_plus"),
        F.size("adjustments.minus").cast("long").alias("n_minus"), minus.alias("minus"), F.col("revisions")[0]["suggested"].alias("suggested"), F.get("suggestions", F.lit(1)).alias("advice"),
    )


@query(sql(f"SELECT id, id % 3 <> 0 AS dims_agree, id % 3 <> 0 AS adjusted_agree, round(({_RAW} - 2 - n_chars % 4) * 70 / 100.0) = total_score AS total_agree FROM records"))
def report_audit(d: Domain) -> DataFrame:
    """Every third report states a sum of dimensions that is not theirs."""
    wrong = F.regexp_replace("content", r"(维度得分之和\*\*：)\d+", "维度得分之和**：9")
    rows = reports(d).select("id", F.when(F.col("id") % 3 == 0, wrong).otherwise(F.col("content")).alias("content"))
    return documents.audited(documents.reports(rows)).select("id", "dims_agree", "adjusted_agree", "total_agree")


@query(sql("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 5 END AS level, CASE event_id % 5 WHEN 4 THEN 0 ELSE 1 END AS n, CASE event_id % 5 WHEN 4 THEN -1 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
    CASE event_id % 2 WHEN 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE -1 END AS object_k FROM events"""))
def json_repair(d: Domain) -> DataFrame:
    p, k = F.col("props"), F.col("event_id") % 5
    text = F.when(k == 0, F.concat(F.lit("["), p, F.lit("]"))).when(k == 1, F.concat(F.lit("```json\n["), p, F.lit("]\n```"))).when(k == 2, F.concat(F.lit("["), p, F.lit(","))).when(k == 3, F.concat(F.lit("结果：["), p, F.lit("] 完"))).otherwise("garbage")
    got, level = documents.repaired_array(F.col("text"), "struct<k:bigint>")
    lone = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("好的 "), F.regexp_replace(p, r"\}", ",}"))).otherwise("none")
    rows = d.read("events").withColumns({"text": text, "lone": lone})
    return rows.select("event_id", level.alias("level"), F.size(got).alias("n"), F.coalesce(F.get(got, F.lit(0))["k"], F.lit(-1)).alias("k"), F.coalesce(documents.repaired_object(F.col("lone"), "struct<k:bigint>")["k"], F.lit(-1)).alias("object_k"))


def blocks(d: Domain) -> DataFrame:
    lines = d.read("documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    i = F.col("i")
    text = F.when(i % 4 == 0, F.concat(i.cast("string"), F.lit(". "), F.col("line"))).otherwise(F.col("line"))
    return lines.select("page", (20 * i + 15 * (i % 3) + 60 * F.floor(i / 11)).cast("long").alias("y"), ((7 * F.col("page") + 53 * i) % 300).cast("long").alias("x"), F.lit(20).cast("long").alias("height"), text.alias("text"), (i % 10 / 10).alias("confidence"))


_BLOCKS = """l AS (SELECT doc_id AS page, unnest(range(len(s))) AS i, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
    b AS (SELECT page, y, x, opens, row_number() OVER (PARTITION BY page ORDER BY y, x) AS n FROM (SELECT page, 20 * i + 15 * (i % 3) + 60 * (i // 11) AS y, (7 * page + 53 * i) % 300 AS x, (i % 4 = 0) AND (7 * page + 53 * i) % 300 < 200 AS opens,
        CASE WHEN i % 4 = 0 THEN i || '. ' || line ELSE line END AS text, i FROM l WHERE i % 10 >= 3) WHERE trim(text) <> ''),
    f AS (SELECT page, n, y, x, 1 AS grp, y + 20 AS bottom FROM b WHERE n = 1 UNION ALL SELECT b.page, b.n, b.y, b.x, f.grp + CASE WHEN b.opens OR abs(b.y - f.bottom) >= 50 THEN 1 ELSE 0 END,
        CASE WHEN b.opens OR abs(b.y - f.bottom) >= 50 THEN b.y + 20 ELSE greatest(f.bottom, b.y + 20) END FROM f JOIN b ON b.page = f.page AND b.n = f.n + 1)"""


@query(sql("SELECT page, y, x, CAST(grp AS BIGINT) AS grp FROM f", _BLOCKS))
def block_groups(d: Domain) -> DataFrame:
    return papers.grouped_blocks(blocks(d)).select("page", "y", "x", "grp")


_PARAS = """p AS (SELECT id, line, body, instr(text, body) - 1 AS start FROM (SELECT doc_id AS id, text, unnest(s) AS body, unnest(range(len(s))) AS line FROM (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS s FROM documents))),
    h AS (SELECT doc_id AS id, unnest([0, 1, 2, 3, 4]) * 37 + doc_id % 7 AS s FROM documents),
    a AS (SELECT p.id, p.line, h.s - p.start AS b, h.s + 20 - p.start AS e, coalesce(lag(h.s + 20 - p.start) OVER (PARTITION BY p.id, p.line ORDER BY h.s), 0) AS before FROM p JOIN h ON h.id = p.id AND h.s >= p.start AND h.s + 20 <= p.start + length(p.body)),
    z AS (SELECT p.id, p.line, coalesce(max(a.e), 0) AS reached, any_value(length(p.body)) AS size FROM p LEFT JOIN a ON a.id = p.id AND a.line = p.line GROUP BY 1, 2)"""


@query(sql("""SELECT id, line, b AS begin, e AS "end", 'note' AS kind FROM a UNION ALL SELECT id, line, before, b, 'normal' FROM a WHERE b > before UNION ALL SELECT id, line, reached, size, 'normal' FROM z WHERE reached < size""", _PARAS))
def paragraph_segments(d: Domain) -> DataFrame:
    texts = d.read("documents").select(F.col("doc_id").alias("id"), "text")
    start = F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: k * 37 + F.col("id") % 7)).alias("start")
    notes = texts.select("id", start).select("id", F.col("start").cast("long").alias("start"), (F.col("start") + 20).cast("long").alias("end"), F.lit("note").alias("kind"))
    return papers.segments(papers.paragraphs(texts), notes)


@query(sql(f"SELECT session_id, number, error_type, difficulty, strftime(created_at, {SQL_FMT}) AS created_at FROM errors"))
def upsert_errors(d: Domain) -> DataFrame:
    """The store after two batches of versions, the second put in twice."""
    cut = F.lit("1998-01-01").cast("timestamp")
    keys, order = ["session_id", "number"], ["created_at", "part", "supplier", "price"]
    old, new = d.versions().where(F.col("created_at") < cut), d.versions().where(F.col("created_at") >= cut)
    base = tables.latest(old, keys, order)
    return d.owned(tables.upsert(tables.upsert(base, new, keys, order), new, keys, order)).select("session_id", "number", "error_type", "difficulty", said("created_at").alias("created_at"))


@query(sql("SELECT id, user_id, CASE WHEN id % 3 = 0 THEN 'done' ELSE status END AS status, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN id % 7 ELSE image_count END AS image_count, id % 3 = 0 AS changed FROM sessions"))
def patch_sessions(d: Domain) -> DataFrame:
    base = tables.evolve(d.sessions(), {"updated_at": F.col("created_at")})
    changes = d.sessions().where("id % 3 = 0").select("id", F.lit("done").alias("status"), F.when(F.col("id") % 2 == 0, F.col("id") % 7).alias("image_count"), F.lit(-1).alias("user_id"))
    out = tables.patch(base, changes, "id", ["status", "image_count"], F.lit("2030-01-01").cast("timestamp"))
    return out.select("id", "user_id", "status", "image_count", (F.col("updated_at") != F.col("created_at")).alias("changed"))


@query(sql("""SELECT id, email, nickname, region FROM (SELECT c_custkey AS id, lower(trim(email)) AS email, split_part(lower(trim(email)), '@', 1) AS nickname, '上海' AS region, row_number() OVER (PARTITION BY lower(trim(email)) ORDER BY c_custkey) AS n
    FROM (SELECT c_custkey, ' User' || c_custkey % 900 || CASE WHEN c_custkey % 11 = 0 THEN '' ELSE '@Example.org ' END AS email FROM customer) WHERE email LIKE '%@%') WHERE n = 1 AND email NOT IN (SELECT 'user' || s_suppkey || '@example.org' FROM supplier)"""))
def new_accounts(d: Domain) -> DataFrame:
    """Valid registrations with a new address, each address once; the defaults of an account."""
    asked = d.read("customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit(" User"), (F.col("c_custkey") % 900).cast("string"), F.when(F.col("c_custkey") % 11 == 0, "").otherwise("@Example.org ")).alias("email"), F.lit("secret1").alias("password"))
    valid = asked.where(C.account_error(F.col("email"), F.col("password")).isNull()).withColumn("email", C.normalise_email(F.col("email")))
    base = d.read("supplier").select(F.concat(F.lit("user"), F.col("s_suppkey").cast("string"), F.lit("@example.org")).alias("email"))
    new = tables.new_only(valid, base, "email")
    return tables.evolve(new.drop("password"), {"nickname": F.get(F.split("email", "@"), F.lit(0)), "region": F.lit("上海")})


@query(sql("SELECT id, 'stored' AS source, total_score FROM records WHERE status = 'done' UNION ALL SELECT id, 'memory', 0 FROM records WHERE status <> 'done' AND id % 2 = 0"))
def result_lookup(d: Domain) -> DataFrame:
    stored = d.records().where("status = 'done'").select("id", F.lit("stored").alias("source"), "total_score")
    memory = d.records().where("id % 2 = 0").select("id", F.lit("memory").alias("source"), F.lit(0).cast("long").alias("total_score"))
    return tables.prefer([stored, memory], "id")


@query(sql("SELECT r.id, r.user_id, u.role FROM records r JOIN users u ON u.id = r.id % 5 WHERE u.role = 'admin' OR r.user_id = u.id"))
def key_lookup(d: Domain) -> DataFrame:
    """Records asked for by a set of users: administrators see all, others their own."""
    asked = d.users().where("id between 0 and 4").select(F.col("id").alias("asker"), "role")  # ids are unique, so five askers at most
    rows = d.records().select("id", "user_id").join(F.broadcast(asked), F.col("id") % 5 == F.col("asker"))
    return rows.where((F.col("role") == "admin") | (F.col("user_id") == F.col("asker"))).select("id", "user_id", "role")


@query(sql("""SELECT id, CASE WHEN subject NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'subject' WHEN image_count * 2 > 10 THEN 'images' ELSE '' END AS error, CASE id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'text' ELSE 'reject' END AS kind FROM sessions"""))
def submission_check(d: Domain) -> DataFrame:
    file = F.when(F.col("id") % 3 == 0, "data:image/png;base64,").when(F.col("id") % 3 == 1, "text").otherwise(" ")
    return d.sessions().select("id", F.coalesce(C.submission_error(F.col("subject"), F.col("image_count") * 2, ("1-URGENT", "2-HIGH", "3-MEDIUM")), F.lit("")).alias("error"), C.input_kind(file).alias("kind"))


@query(sql("SELECT id, user_id, total_score, status FROM records"))
def table_roundtrip(d: Domain) -> DataFrame:
    """Written whole, swapped in twice, and read back with its schema."""
    path, rows = tables.scratch(d.spark, "records"), d.records().drop("essay_text")
    tables.save(rows, path, ["status"])
    tables.save(rows, path, ["status"])
    return tables.load(d.spark, path, rows.schema).select("id", "user_id", "total_score", "status")


@query(sql("SELECT id, total_score, CASE WHEN id % 2 = 0 THEN 'text' ELSE 'image' END AS input_type, 0 AS is_guest FROM records"))
def schema_evolve(d: Domain) -> DataFrame:
    """Rows of an old and a new schema in one table, the new columns with their defaults."""
    old = d.records().where("id % 2 = 0").select("id", "total_score")
    new = tables.evolve(d.records().where("id % 2 = 1").select("id", "total_score"), {"input_type": F.lit("image"), "is_guest": F.lit(0)})
    both = old.unionByName(new, allowMissingColumns=True)
    return both.select("id", "total_score", C.or_blank(F.col("input_type"), "text").alias("input_type"), F.coalesce("is_guest", F.lit(0)).alias("is_guest"))
