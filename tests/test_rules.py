"""Small hand-made cases for rules where order matters."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import columns as C
from marginalia.operators import admission, documents, papers, views
from marginalia.sources import schemas, tables
from marginalia.streaming import jobs


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(("day", "plain", "academic"), [("2024-01-31", "2024-上", "2023-上"), ("2024-02-29", "2024-上", "2023-上"), ("2024-03-01", "2024-下", "2024-下"), ("2024-08-31", "2024-下", "2024-下"), ("2024-09-01", "2024-上", "2024-上")])
def test_semesters(spark, day, plain, academic):
    ts = F.lit(day).cast("timestamp")
    assert one(spark, C.semester_label(ts)) == plain and one(spark, C.semester_label(ts, academic=True)) == academic


@pytest.mark.parametrize(
    ("mark", "want"),
    [("✗", (False, "high")), ("x", (False, "high")), ("REWRITE", (False, "high")), ("-3", (False, "high")), ("○", (False, "high")), ("✓", (True, "high")), ("√ ok", (True, "high")), ("?", (False, "low")), ("✓ ✗", (False, "high"))],
)
def test_marks(spark, mark, want):
    got = one(spark, C.marked(F.lit(mark), F.lit(True)))
    assert (got.is_correct, got.confidence, got.has_red_ink) == (*want, True)


def test_no_mark_is_right(spark):
    got = one(spark, C.marked(F.lit(""), F.lit(False)))
    assert (got.is_correct, got.confidence, got.grading_mark, got.has_red_ink) == (True, "medium", "无标记", False)


def test_defaults_bands_and_deductions(spark):
    assert [one(spark, C.falsy(F.lit(v).cast("int"), 0, 3)) for v in (None, 0, 5)] == [3, 3, 5]
    assert [one(spark, C.clamp_difficulty(F.lit(v))) for v in (0, -2, 9, 4)] == [3, 1, 5, 4]
    assert [one(spark, C.grade_band(F.lit(v))) for v in (68, 67, 63, 62, 52, 51, 21, 20, 0)] == ["一类上", "一类中", "一类下", "二类上", "二类下", "三类", "四类", "五类上", "五类下"]
    assert [one(spark, C.length_deduction(F.lit(v))) for v in (500, 499, 400, 399, 350, 349)] == [0, 1, 1, 1, 1, 2]
    assert [one(spark, C.scaled(F.lit(v))) for v in (52, 75)] == [36, 53]
    assert one(spark, C.normalise_error_type(F.lit("粗心马虎"))) == "粗心" and one(spark, C.normalise_error_type(F.lit("计算失误"), F.lit(" "))) == "知识盲区"


@pytest.mark.parametrize(("email", "password", "want"), [(None, "secret1", "email_missing"), ("a b@c.d", "secret1", "email_invalid"), ("a@b.c", "", "password_missing"), ("a@b.c", "12345", "password_short"), (" A@b.c ", "123456", None)])
def test_accounts(spark, email, password, want):
    assert one(spark, C.account_error(F.lit(email).cast("string"), F.lit(password))) == want


def test_question_text(spark):
    text = F.lit("下列正确的是 A. 一二 B、三四 C . 五")
    assert one(spark, C.question_type(text)) == "选择题"
    assert one(spark, C.options_of(text)) == ["A. 一二", "B. 三四", "C. 五"]
    assert one(spark, C.inferred_answer(F.array(*map(F.lit, ["C", " x ", " B ", "D"])))) == "B"
    assert [one(spark, C.has_stem(F.lit(t))) for t in ("12.、 　3 听力", "求函数的最大值是多少")] == [False, True]


def test_block_groups(spark):
    rows = [(1, 0, 0, 20, "1. 题", 0.9), (1, 69, 0, 20, "续", 0.9), (1, 139, 0, 20, "远", 0.9), (1, 150, 250, 20, "2. 右", 0.9), (1, 160, 0, 100, "3. 高", 0.9), (1, 309, 5, 10, "近", 0.9), (1, 310, 0, 10, "淡", 0.2), (1, 311, 0, 10, " ", 0.9)]
    got = papers.grouped_blocks(spark.createDataFrame(rows, "page long, y long, x long, height long, text string, confidence double")).orderBy("y", "x").collect()
    assert [(r.text, r.grp) for r in got] == [("1. 题", 1), ("续", 1), ("远", 2), ("2. 右", 2), ("3. 高", 3), ("近", 3)]


def test_validation_rules_in_order(spark):
    schema = "paper long, number long, question_type string, student_answer string, correct_answer string, is_correct boolean, is_unanswered boolean, grading_mark string, has_red_ink boolean, red_ink string, confidence string"
    rows = [
        (1, 1, "选择题", "b. x", "B", True, None, "✓", True, "✓", "high"), (1, 2, "填空题", "b", "c", True, False, "✓", True, "✓ c", None), (1, 3, "填空题", "1", "1", True, False, "-2", True, "-2", "high"),
        (1, 4, "填空题", "", "", True, True, None, False, "", None), (1, None, "填空题", "", "", None, False, "", False, "", None),
    ]
    got = {r.number: r for r in papers.validated(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].student_answer == "B" and got[1].valid
    assert not got[2].is_correct and "矛盾：红笔正确答案=c" in got[2].issues[0] and got[2].confidence == "high"
    assert not got[3].is_correct and got[3].issues == ["矛盾：有扣分标记但标记为正确"]
    assert not got[4].is_correct and got[4].issues == ["未作答但标记为正确"] and got[4].confidence == "medium"
    assert got[None].issues == ["缺少题号", "缺少对错判断"]


@pytest.mark.parametrize(
    ("text", "level", "want"),
    [('[{"a":1},{"a":2}]', 0, [1, 2]), ('```json\n[{"a":1}]\n```', 0, [1]), ('说明 [{"a":1}] 完', 1, [1]), ('[{"a":1},{"a":2},', 2, [1, 2]), ('[{"a":1},{"a":x},{"a":3}]', 3, [1, 3]), ("nothing", 5, []), ('{"a":1}', 5, [])],
)
def test_json_arrays(spark, text, level, want):
    got, at = documents.repaired_array(F.lit(text), "struct<a:bigint>")
    row = spark.range(1).select(got.alias("got"), at.alias("level")).first()
    assert row.level == level and [x.a for x in row.got] == want


def test_json_objects(spark):
    got = [one(spark, documents.repaired_object(F.lit(t), "struct<a:bigint>")) for t in ('{"a":1}', 'x {"a":2} y', '{"a":3,}', "no")]
    assert [g and g.a for g in got] == [1, 2, 3, None]


REPORT = """最终得分：46分
（三类卷中）
**字数统计**：712
#### 审题立意（12/20分）
- 立意尚可
- **扣分原因**：偏浅
#### 思辨深度（16/20分）
- 好
**加分项：**
- 思辨锐度（+3分）

**扣分项：**
- 套作痕迹（-8分）
- 空洞（-3分）
---
**分数计算**
**维度得分之和**：28
**调整后100分制**：20
"""


@pytest.mark.parametrize(("mode", "words", "raw", "adjusted", "minus"), [("tolerant", 712, 28, 20, 2), ("parity", 0, 0, 0, 3)])
def test_reports(spark, mode, words, raw, adjusted, minus):
    r = spark.range(1).select(*[c.alias(n) for n, c in documents.report(F.lit(REPORT), mode).items()]).first()
    assert (r.total_score, r.grade, r.word_count, r.raw_score, r.adjusted_score, len(r.adjustments.minus)) == (46, "三类卷", words, raw, adjusted, minus)
    assert {k: v.score for k, v in r.dimensions.items()} == {"审题立意": 12, "思辨深度": 16}
    if mode == "tolerant":
        df = spark.range(1).select(*[c.alias(n) for n, c in documents.report(F.lit(REPORT)).items()])
        a = documents.audited(df).first()
        assert (a.dims_agree, a.adjusted_agree, a.total_agree, a.consistent) == (True, True, False, False)


def test_rate_windows(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(milliseconds=s)
    rows = [(i, at(ms), "a") for i, ms in enumerate((0, 3000, 5000, 10_000, 10_001, 12_000, 30_000))] + [(10, at(0), "b"), (11, at(60_000), "b"), (12, at(60_001), "b")]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, ip string")
    got = {r.event_id: (r.rate_ok, r.retry_after) for r in admission.rate_limited(df.where("ip = 'a'"), 10_000, 2).collect()}
    assert got == {0: (True, None), 1: (True, None), 2: (False, 5), 3: (False, 0), 4: (True, None), 5: (True, None), 6: (True, None)}
    got = {r.event_id: r.rate_ok for r in admission.rate_limited(df.where("ip = 'b'"), 60_000, 1).collect()}
    assert got == {10: True, 11: False, 12: True}


def test_budget_counts_refused_and_starts_anew_at_midnight(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(1, day, 7, 50), (2, day + dt.timedelta(hours=1), 7, 5), (3, day + dt.timedelta(hours=25), 7, 5), (4, day, None, 99)]
    got = {r.event_id: (r.used, r.budget_ok) for r in admission.budgeted(spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, tokens long"), 40).collect()}
    assert got[1] == (50, True) and got[2] == (55, False) and got[3] == (5, True) and got[4][1]


def test_store(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, at int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2), (1, "old", 0)], "id int, v string, at int")
    once = tables.upsert(base, new, ["id"], ["at"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, tables.upsert(once, new, ["id"], ["at"]).collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]
    path = str(tmp_path / "t")
    assert tables.load(spark, path, base.schema).count() == 0
    tables.save(base, path)
    tables.save(tables.load(spark, path, base.schema).where("id = 1"), path)
    assert [tuple(r) for r in tables.load(spark, path, base.schema).collect()] == [(1, "a", 1)]


def test_taxonomy_is_seeded_once(spark):
    nested = spark.createDataFrame([("数学", [("函数", ["二次函数", "三角函数"]), ("数列", ["等差数列"])])], "subject string, categories array<struct<name:string,items:array<string>>>")
    rows = views.seeded(nested)
    assert rows.groupBy("category").count().orderBy("category").collect()[0]["count"] == 2 and rows.count() == 5
    assert {(r.name, r.parent_name) for r in views.with_parent(rows).where("category = 'item'").collect()} == {("二次函数", "函数"), ("三角函数", "函数"), ("等差数列", "数列")}
    assert views.seeded(nested, rows).count() == 0


def test_segments(spark):
    lines = papers.paragraphs(spark.createDataFrame([(1, "abcdef\n\nghij")], "id long, text string"))
    notes = spark.createDataFrame([(1, 1, 3, "x"), (1, 4, 6, "y"), (1, 5, 9, "across")], "id long, start long, end long, kind string")
    got = sorted((r.line, r.begin, r.end, r.kind) for r in papers.segments(lines, notes).collect())
    assert got == [(0, 0, 1, "normal"), (0, 1, 3, "x"), (0, 3, 4, "normal"), (0, 4, 6, "y"), (1, 0, 4, "normal")]


def test_a_broken_off_write_leaves_the_state_before(spark, tmp_path):
    """A writer that dies before its success mark, or after it and before old states are deleted, loses nothing."""
    path, schema = str(tmp_path / "t"), "id long"
    tables.save(spark.range(3), path)
    (tmp_path / "t" / "state-1").mkdir()  # no success mark
    (tmp_path / "t" / "state-1" / "part-0.parquet").write_bytes(b"half")
    assert tables.load(spark, path, spark.range(0).schema).count() == 3
    tables.save(spark.range(5), path)
    assert tables.load(spark, path, spark.range(0).schema).count() == 5
    for n in (7, 8):
        tables.save(spark.range(n), path)
    assert [k for k, _ in tables.states(spark, path)] == [2, 3] and tables.load(spark, path, spark.range(0).schema).count() == 8
    assert tables.load(spark, str(tmp_path / "none"), spark.createDataFrame([], schema).schema).count() == 0


def test_unreadable_files_are_an_error_or_empty(spark, tmp_path):
    (tmp_path / "x.parquet").write_bytes(b"no parquet")
    schema = spark.range(0).schema
    assert tables.load(spark, str(tmp_path), schema, corrupt="skip").count() == 0
    with pytest.raises(Exception, match="parquet|Parquet"):
        tables.load(spark, str(tmp_path), schema).count()


def test_merge_writes_touched_buckets_and_may_be_replayed(spark, tmp_path):
    path, schema = str(tmp_path / "m"), "id long, v string, at long"
    put = lambda rows: tables.merge(spark.createDataFrame(rows, schema), path, ["id"], ["at"], 4)
    put([(i, "a", 0) for i in range(20)])
    for _ in range(2):
        put([(3, "b", 1), (99, "new", 1)])
    assert len([x for x in (tmp_path / "m" / "state-1").iterdir() if x.name.startswith("bucket=")]) <= 2
    (tmp_path / "m" / "state-3" / "bucket=0").mkdir(parents=True)  # a write that broke off
    kind = spark.createDataFrame([], schema).schema
    before = sorted(map(tuple, tables.merged(spark, path, kind).collect()))
    tables.compact(spark, path, kind, ["id"], 4)
    assert sorted(map(tuple, tables.merged(spark, path, kind).collect())) == before and len(tables.states(spark, path)) == 1
    got = {r.id: r.v for r in tables.merged(spark, path, spark.createDataFrame([], schema).schema).collect()}
    assert len(got) == 21 and got[3] == "b" and got[4] == "a" and got[99] == "new"


def test_late_rows_and_a_replayed_batch(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    put = jobs.with_late(str(tmp_path / "on"), str(tmp_path / "late"), "ts", 60)
    first = spark.createDataFrame([(1, at + dt.timedelta(hours=5))], "id long, ts timestamp")
    second = spark.createDataFrame([(2, at), (3, at + dt.timedelta(hours=4, minutes=30))], "id long, ts timestamp")
    put(first, 0)
    for _ in range(2):
        put(second, 1)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "on")).collect()) == [1, 3]
    assert [r.id for r in spark.read.schema("id long, ts timestamp").parquet(str(tmp_path / "late")).collect()] == [2]


def test_defaults_of_the_store(spark):
    row = schemas.filled(spark.createDataFrame([("u1", " A@B.c ", None)], "id string, email string, role string"), "users").first()
    assert (row.email, row.nickname, row.region, row.role, row.must_change_password) == ("a@b.c", "a", "上海", "user", 0)
    assert schemas.empty(spark, "error_problems").count() == 0 and schemas.filled(schemas.empty(spark, "users"), "users").dtypes == schemas.empty(spark, "users").dtypes


def test_rate_windows_across_arrow_batches(spark):
    """A key of more rows than an Arrow batch has, against a plain fold."""
    r = random.Random(4)
    rows, ms = [], 0
    for i in range(3000):
        ms += r.choice((0, 5, 40, 400))
        rows.append((i, dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms), "hot" if r.random() < 0.7 else None))
    want, state = {}, {}
    for i, ts, key in rows:
        start, n = state.get(key, (None, 0))
        fresh = start is None or (ts - start) / dt.timedelta(milliseconds=1) > 1000
        state[key] = (ts, 1) if fresh else (start, n + 1)
        want[i] = state[key][1] <= 5
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = {r.event_id: r.rate_ok for r in admission.rate_limited(spark.createDataFrame(rows, "event_id long, ts timestamp, ip string"), 1000, 5).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want


def test_fuzzy_terms_short_and_rare(spark):
    kp = spark.createDataFrame([(1, "s", "Abcdef"), (2, "s", "xbcd"), (3, "t", "bcd"), (4, "s", "é")], "id long, subject string, name string")
    terms = spark.createDataFrame([(1, 1, "s", "BCD"), (1, 2, "s", "x"), (1, 3, "t", "zz"), (1, 4, "s", "É"), (1, 5, "s", ""), (1, 6, "s", "bcdf")], "session_id long, number long, subject string, term string")
    assert sorted((r.number, r.kp_id) for r in views.fuzzy_tags(terms, kp).collect()) == [(1, 1), (2, 2), (4, 4)]


def test_answers_that_later_blocks_show(spark):
    """Only of marked questions with a number and no answer; the first block is the question itself."""
    blocks = {1: ["B", "x", " C ", "D"], 2: ["B"], 3: ["1", "AB", "E"], 4: ["1", "A"], 5: ["1", "A"], 6: None, 0: ["1", "A"], 7: ["1", "B"]}
    rows = [("p", n, "A" if n == 5 else "", "B", None, b) for n, b in blocks.items()]
    questions = spark.createDataFrame(rows, "paper string, number int, student_answer string, correct_answer string, options array<string>, blocks array<string>")
    marks = spark.createDataFrame([("p", n, 1, "✓" if n == 7 else "✗", None, None) for n in (0, 1, 2, 3, 5, 6, 7)], "paper string, number int, pos int, mark string, answer string, extra string")
    merged = papers.merge_marks(questions, marks, ["paper"])
    got = {x.number: (x.student_answer, x.is_unanswered) for x in merged.collect()}
    assert got == {1: ("C", False), 2: ("", True), 3: ("", True), 4: ("", False), 5: ("A", False), 6: ("", True), 0: ("", False), 7: ("B", False)}
    assert tuple(papers.merge_counts(merged, ["paper"]).first()) == ("p", 3, 5, 3, 3)
