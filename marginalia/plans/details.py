"""Registered jobs on stored JSON fields, recent tasks and failed runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import columns as C
from marginalia.functions.columns import or_blank
from marginalia.operators import admission as A
from marginalia.operators import documents, papers, views
from marginalia.sources import schemas, tables

from .domain import SQL_FMT, Domain, said, sql
from .papers import _M, _MERGED, _Q, _WRONG, merged, questions
from .registry import query
from .requests import _LATEST


def stored(d: Domain) -> DataFrame:
    """Questions as the store holds them: options, cards and the model's raw answer as JSON text, some blank or broken."""
    q = questions(d)
    odd = F.col("number") % 3
    raw = F.when(odd == 0, F.to_json(F.struct(F.concat(F.lit("d"), F.col("number").cast("string")).alias("diagnosis")))).when(
        odd == 1, F.to_json(F.struct(F.struct(F.lit("vl").alias("mark")).alias("vl"), F.struct(F.concat(F.lit("a"), F.col("number").cast("string")).alias("diagnosis")).alias("analysis")))
    )
    cards = F.to_json(F.map_from_arrays(F.array(F.lit("概念"), F.lit("步骤")), F.array(F.col("question_text"), F.col("question_type"))))
    return q.select("paper", "number", "correct_answer", F.when(odd == 2, "[broken").otherwise(F.to_json("options")).alias("options"), F.when(odd == 2, "").otherwise(cards).alias("cards"), raw.alias("ai_raw"), F.concat(F.lit("解一\n步骤"), F.col("number").cast("string")).alias("solution"))


@query(sql("""SELECT session_id AS paper, number, CASE number % 3 WHEN 0 THEN 'd' || number WHEN 1 THEN 'a' || number ELSE '' END AS diagnosis, CASE number % 3 WHEN 2 THEN 0 ELSE 2 END AS n_cards,
    CASE number % 3 WHEN 2 THEN 0 ELSE 4 END AS n_options, CASE number % 3 WHEN 2 THEN '' ELSE 'A. one,B. two' END AS shown, CASE number % 3 WHEN 2 THEN 0 ELSE 2 END AS hidden, '解一' AS first_line FROM errors"""))
def detail_fields(d: Domain) -> DataFrame:
    options = F.coalesce(F.from_json("options", "array<string>"), F.array().cast("array<string>"))
    cards = F.coalesce(F.from_json(F.nullif("cards", F.lit("")), "map<string,string>"), F.create_map().cast("map<string,string>"))
    diagnosis = F.coalesce(C.at_paths(F.col("ai_raw"), "$.diagnosis", "$.analysis.diagnosis"), F.lit(""))
    rows = stored(d).withColumns({"o": options, "c": cards})
    return rows.select(
        "paper", "number", diagnosis.alias("diagnosis"), F.size("c").alias("n_cards"), F.size("o").alias("n_options"), F.array_join(F.slice("o", 1, 2), ",").alias("shown"),
        F.greatest(F.size("o") - 2, F.lit(0)).alias("hidden"), F.get(F.split("solution", "\n"), F.lit(0)).alias("first_line"),
    )


@query(sql("""SELECT session_id AS paper, number, '步骤' AS name, CASE WHEN part % 2 = 0 THEN '选择题' ELSE '填空题' END AS explanation FROM errors WHERE number % 3 <> 2
    UNION ALL SELECT session_id, number, '概念', CASE WHEN part % 3 = 0 THEN '12. 、' || substr(p_name, 1, 4) ELSE '3. ' || p_name || ' question' END FROM errors JOIN part ON p_partkey = part WHERE number % 3 <> 2"""))
def knowledge_cards(d: Domain) -> DataFrame:
    cards = F.from_json(F.nullif("cards", F.lit("")), "map<string,string>")
    return stored(d).select("paper", "number", F.explode(cards).alias("name", "explanation"))


@query(sql("""SELECT task_id, kind, status IN ('queued', 'processing') AS pending, place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY updated_at DESC, task_id) AS place FROM c
    WHERE epoch_us((SELECT max(ts) FROM events)) - epoch_us(updated_at) <= 24 * 3600000000) WHERE place <= 100""", _LATEST))
def recent_tasks(d: Domain) -> DataFrame:
    """The newest 100 of each kind that are a day old at most."""
    rows = d.transitions()
    as_of = rows.agg(F.max("updated_at")).first()[0]
    fresh = A.current(rows).where(F.unix_micros(F.lit(as_of)) - F.unix_micros("updated_at") <= 24 * 3_600_000_000)
    ranked = fresh.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("updated_at"), "task_id")).cast("long"))
    return ranked.where("place <= 100").select("task_id", "kind", F.col("status").isin("queued", "processing").alias("pending"), "place")


@query(sql("SELECT id, status, CASE status WHEN 'failed' THEN 'no label for record ' || id ELSE '' END AS error_message, CASE status WHEN 'failed' THEN 0 ELSE total_score END AS total_score FROM records"))
def failed_runs(d: Domain) -> DataFrame:
    """Failed runs become rows of the same table, with their message and no score."""
    rows = d.records().select("id", "status", "total_score")
    done = rows.where("status = 'done'").withColumn("error_message", F.lit(""))
    failed = rows.where("status <> 'done'").select("id", "status", F.lit(0).cast("long").alias("total_score"), F.concat(F.lit("no label for record "), F.col("id").cast("string")).alias("error_message"))
    return done.unionByName(failed)




@query(sql("""SELECT session_id AS paper, number, page, part FROM (SELECT *, supplier % 3 + 1 AS page, row_number() OVER (PARTITION BY session_id, number ORDER BY supplier % 3 + 1, created_at, part, supplier, price) AS n FROM versions) WHERE n = 1"""))
def dedup_pages(d: Domain) -> DataFrame:
    """A question scanned on several pages counts once, where it comes first."""
    rows = d.versions().select(F.col("session_id").alias("paper"), "number", (F.col("supplier") % 3 + 1).alias("page"), "created_at", "part", "supplier", "price")
    first = F.min(F.struct("page", "created_at", "part", "supplier", "price")).alias("f")
    return rows.groupBy("paper", "number").agg(first).select("paper", "number", "f.page", "f.part")


@query(sql("SELECT id, email, region, role = 'admin' AS is_admin, id % 2 <> 0 AS must_change_password, place FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY id DESC) AS place FROM users) WHERE place <= 20"))
def user_list(d: Domain) -> DataFrame:
    """The newest 20 accounts of each region without what is secret in them."""
    rows = d.users().withColumns({"password_hash": F.sha2("email", 256), "flag": F.col("id") % 2})
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("region").orderBy(F.desc("id"))).cast("long")).where("place <= 20")
    return ranked.select("id", "email", "region", (F.col("role") == "admin").alias("is_admin"), (F.col("flag") != 0).alias("must_change_password"), "place")


@query(sql("SELECT paper, number, '{\"vl\":{\"page\":' || page || '},\"analysis\":{\"number\":' || number || '}}' AS ai_raw, page AS vl_page FROM (SELECT session_id AS paper, number, supplier % 3 + 1 AS page FROM errors)"))
def provenance(d: Domain) -> DataFrame:
    """Where a stored mistake came from, as one JSON document, and a field read back from it."""
    raw = F.to_json(F.struct(F.struct("page").alias("vl"), F.struct("number").alias("analysis")))
    rows = questions(d).select("paper", "number", raw.alias("ai_raw"))
    return rows.withColumn("vl_page", F.get_json_object("ai_raw", "$.vl.page").cast("long"))


@query(sql("SELECT paper, page, number, question_type FROM q", _Q))
def page_union(d: Domain) -> DataFrame:
    """Pages with their questions (of one page each) as rows again, each with its page."""
    pages = questions(d).groupBy("paper", "page").agg(F.collect_list(F.struct("number", "question_type")).alias("questions"))
    return papers.page_questions(pages, ["paper"]).select("paper", "page", "number", "question_type")


#: Texts of every kind, by part: what the kind is told by, and how many options stand in it.
KINDS = (("选 A. one B、two C . three", "选择题", 3), ("水的___是", "填空题", 0), ("对还是错", "判断题", 0), ("求解 x", "解答题", 0), ("the Passage", "阅读理解", 0), ("如图3", "实验题", 0), ("别的", "未知", 0))
_TEXT = "CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{t}'" for i, (t, _, _) in enumerate(KINDS)) + " END"
_KIND = "CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{k}'" for i, (_, k, _) in enumerate(KINDS)) + " END"


@query(sql(f"""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN CAST(p_partkey AS INTEGER) ELSE -1 END AS question_number, {_KIND} AS question_type, CASE p_partkey % 7 WHEN 0 THEN 'A. one/B. two/C. three' ELSE '' END AS options,
    CASE WHEN p_size % 3 = 0 THEN 'B' WHEN p_size % 3 = 1 THEN 'D' ELSE '' END AS answer, CAST(p_size AS BIGINT) AS x, CAST(7 AS BIGINT) AS y, CAST(10 AS BIGINT) AS width, CAST(p_size AS BIGINT) AS height FROM part"""))
def question_parse(d: Domain) -> DataFrame:
    """Number, kind, options, the student's letter and the box of a question, from its text and its blocks."""
    p, size = F.col("p_partkey"), F.col("p_size").cast("long")
    body = F.get(F.array(*[F.lit(t) for t, _, _ in KINDS]), (p % 7).cast("int"))
    text = F.when(F.col("p_size") % 2 == 0, F.concat(p.cast("string"), F.lit(". "), body)).otherwise(body)
    blocks = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("A"), F.lit(" B "), F.lit("C"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("x"), F.lit("E"), F.lit("D"))).otherwise(F.array(F.lit("A"), F.lit("AB")))
    corner = lambda dx, dy: F.struct((size + dx).alias("x"), (F.lit(7).cast("long") + dy).alias("y"))
    box = C.bounding_box(F.array(corner(10, F.lit(0)), corner(0, F.lit(0)), corner(0, size), corner(10, size)))
    rows = d.read("part").select(p.alias("id"), text.alias("text"), blocks.alias("blocks"), box.alias("box"))
    return rows.select(
        "id", F.coalesce(C.question_number(F.col("text")), F.lit(-1)).alias("question_number"), C.question_type(F.col("text")).alias("question_type"), F.array_join(C.options_of(F.col("text")), "/").alias("options"),
        F.coalesce(C.inferred_answer(F.col("blocks")), F.lit("")).alias("answer"), "box.x", "box.y", "box.width", "box.height",
    )


@query(sql("SELECT paper, number, question_type, CASE WHEN part % 5 = 0 THEN 'raw ' || number ELSE question_text END AS question_text, CASE WHEN student_answer = '' THEN '' ELSE student_answer END AS student_answer, grading_mark, red_ink, confidence, 4 AS n_options FROM (SELECT w.*, e.part FROM w JOIN errors e ON e.session_id = w.paper AND e.number = w.number)", _Q, _M, _MERGED, _WRONG))
def prompt_rows(d: Domain) -> DataFrame:
    """Wrong questions with the defaults of a prompt's fields; a blank text falls back to the raw one."""
    part = d.errors().select(F.col("session_id").alias("paper"), "number", "part")
    rows = merged(d).where(~F.col("is_correct")).join(part, ["paper", "number"])
    rows = rows.withColumns({"question_text": F.when(F.col("part") % 5 == 0, "").otherwise(F.col("question_text")), "raw_text": F.concat(F.lit("raw "), F.col("number").cast("string"))})
    return papers.normalised(rows).select("paper", "number", "question_type", "question_text", "student_answer", "grading_mark", "red_ink", "confidence", F.size("options").alias("n_options"))


@query(sql("SELECT id, '题目：' || CASE WHEN id % 3 = 0 THEN '(无)' ELSE 'topic ' || id END || chr(10) || '内容：' || status || '/' || status AS prompt FROM records"))
def prompt_template(d: Domain) -> DataFrame:
    topic = F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("topic "), F.col("id").cast("string")))
    return d.records().select("id", C.template("题目：{topic}\n内容：{text}/{text}", {"topic": topic, "text": F.col("status")}, {"topic": "(无)"}).alias("prompt"))


@query(sql("SELECT page_id, length(html) > 200 AS has_red_ink FROM pages WHERE page_id % 2 = 0 AND length(html) > 200 UNION ALL SELECT page_id, false FROM pages WHERE page_id % 2 = 1"))
def red_ink_pages(d: Domain) -> DataFrame:
    """Pages by whether their separated red ink (that of odd ones is blank) is more than an empty image; even pages without are left out."""
    payload = F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.lit(""))
    return d.read("pages").select("page_id", C.has_red_ink(payload).alias("has_red_ink")).where(F.col("has_red_ink") | (F.col("page_id") % 2 == 1))


@query(sql("SELECT user_id, subject, CASE error_type WHEN '' THEN '未知' ELSE error_type END AS error_type, count(*) AS n FROM errors GROUP BY ALL"))
def guidance_types(d: Domain) -> DataFrame:
    """Mistakes of a user and subject as a map by type, and its entries."""
    rows = d.errors().groupBy("user_id", "subject", or_blank(F.col("error_type"), C.UNKNOWN).alias("error_type")).agg(F.count("*").alias("n"))
    by_type = rows.groupBy("user_id", "subject").agg(F.map_from_entries(F.collect_list(F.struct("error_type", "n"))).alias("by_type"))  # of seven types
    return by_type.select("user_id", "subject", F.explode("by_type").alias("error_type", "n"))


@query(sql("""SELECT paper, number, substr(question_text || ' ' || question_text || ' ' || question_text || ' ' || question_text || ' ' || question_text, 1, 100) AS stem FROM (SELECT q.*, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, paper, q.number) AS n
    FROM q JOIN errors e ON e.session_id = q.paper AND e.number = q.number) WHERE n <= 10""", _Q))
def guidance_stems(d: Domain) -> DataFrame:
    """The ten latest mistakes of each user with stems of a hundred characters at most."""
    owner = d.errors().select(F.col("session_id").alias("paper"), "number", "user_id", "created_at")
    latest = views.page(owner, ["user_id"], [F.desc("created_at"), F.col("paper"), F.col("number")], 1, 10)
    long = F.array_join(F.array_repeat("question_text", 5), " ")
    return questions(d).join(latest, ["paper", "number"]).select("paper", "number", F.substring(long, 1, 100).alias("stem"))


@query(sql("SELECT kind, count(*) FILTER (status IN ('queued', 'processing')) AS pending, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'done' AND task_id % 2 = 1) AS unread FROM c GROUP BY 1", _LATEST))
def task_unread(d: Domain) -> DataFrame:
    """Even tasks have been looked at."""
    return A.task_counts(A.current(d.transitions()).withColumn("viewed", F.col("task_id") % 2 == 0))


@query(sql("SELECT session_id, error_type AS concept, last(CAST(number AS VARCHAR) ORDER BY number) AS explanation FROM errors WHERE error_type <> '' GROUP BY 1, 2"))
def flash_cards(d: Domain) -> DataFrame:
    """Cards of a paper by concept; the last of a concept counts."""
    card = F.struct("number", F.col("error_type").alias("concept"), F.col("number").cast("string").alias("text"))
    cards = d.errors().where("error_type <> ''").groupBy("session_id").agg(F.sort_array(F.collect_list(card)).alias("cards"))  # of one paper
    return cards.select("session_id", F.explode(papers.card_map(F.col("cards"), "concept", "text")).alias("concept", "explanation"))


@query(sql("""SELECT session_id, number, CASE part % 6 WHEN 0 THEN 'd' WHEN 1 THEN 'ad' WHEN 2 THEN 'ar' WHEN 3 THEN 'r' ELSE error_type END AS diagnosis, CASE part % 6 WHEN 3 THEN 'm' ELSE 'note' END AS mnemonic, CASE part % 6 WHEN 0 THEN 2 ELSE 0 END AS n_cards FROM errors"""))
def detail_paths(d: Domain) -> DataFrame:
    """Diagnosis, mnemonic and cards from the first path of the raw answer that has them, else from the row itself."""
    raws = ('{"diagnosis":"d","reason":"r","knowledgeCards":[{"concept":"c"},{"concept":"e"}]}', '{"diagnosis":"","analysis":{"diagnosis":"ad","reason":"x"}}', '{"analysis":{"reason":"ar"}}', '{"reason":"r","mnemonic":"m"}', "{broken", "")
    raw = F.get(F.array(*map(F.lit, raws)), (F.col("part") % 6).cast("int"))
    diagnosis = F.coalesce(C.at_paths(raw, "$.diagnosis", "$.analysis.diagnosis", "$.analysis.reason", "$.reason"), F.col("error_type"))
    cards = F.from_json(F.get_json_object(raw, "$.knowledgeCards"), "array<struct<concept:string>>")
    return d.errors().select("session_id", "number", diagnosis.alias("diagnosis"), F.coalesce(C.at_paths(raw, "$.mnemonic"), F.lit("note")).alias("mnemonic"), F.coalesce(F.size(cards), F.lit(0)).alias("n_cards"))


@query(sql("SELECT user_id, id, place FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS place FROM sessions) WHERE place <= 6"))
def recent_sessions(d: Domain) -> DataFrame:
    return views.page(d.sessions(), ["user_id"], [F.desc("created_at"), F.col("id")], 1, 6).select("user_id", "id", F.col("place").cast("long").alias("place"))


@query(sql("""SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 2 = 0 THEN 'redone' ELSE 'done' END AS status, CASE WHEN id % 2 = 0 THEN 0 ELSE CAST(total_score AS INTEGER) END AS total_score, 'text' AS input_type, '{}' AS dimensions, 0 AS is_guest, 23 AS n_columns FROM records"""))
def grading_defaults(d: Domain) -> DataFrame:
    """Gradings put in by id with the defaults of the table; every second one comes again, later and without a score."""
    rows = d.records().select(F.col("id").cast("string").alias("id"), (F.col("id") % 2).alias("odd"), "total_score", "created_at")
    first = schemas.filled(rows.drop("odd"), "grading_records")
    again = rows.where("odd = 0").select("id", F.lit("redone").alias("status"), "created_at", (F.col("created_at") + F.expr("interval 1 hour")).alias("updated_at"))
    out = tables.upsert(first, schemas.filled(again, "grading_records"), ["id"], ["updated_at"])
    return out.select("id", "status", "total_score", "input_type", "dimensions", "is_guest", F.lit(len(out.columns)).alias("n_columns"))


@query(sql(f"SELECT CAST(id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, '' AS title, 1 AS image_count, 'pending' AS status, 0 AS error_count, strftime(created_at, {SQL_FMT}) AS updated_at FROM sessions WHERE id % 4 <> 0"))
def new_sessions(d: Domain) -> DataFrame:
    """Papers handed in, with the defaults of a session; those there already are left alone."""
    batch = d.sessions().select(F.col("id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"), "subject", "created_at")
    new = tables.new_only(batch, batch.where("cast(id as long) % 4 = 0"), "id")
    return schemas.filled(new, "paper_sessions").select("id", "user_id", "title", "image_count", "status", "error_count", said("updated_at").alias("updated_at"))


@query(sql("SELECT user_id, CAST(sum(tokens) AS BIGINT) AS used FROM requests WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM requests) GROUP BY 1"))
def budget_eviction(d: Domain) -> DataFrame:
    """What is left of the budgets' states on the last day."""
    rows = d.requests()
    states = rows.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("tokens").alias("used"))
    return A.evicted(states, F.lit(rows.agg(F.max(F.to_date("ts"))).first()[0])).select("user_id", "used")


@query(sql("""SELECT event_id, CASE WHEN u THEN '未知' ELSE 'k' || k END AS error_type, CAST(CASE WHEN u THEN 3 ELSE event_id % 5 + 1 END AS BIGINT) AS difficulty, CASE WHEN u THEN 'AI 分析第' || (event_id // 4 + 1) || '批第' || (event_id % 4 + 1) || '题时返回格式异常，请重试' ELSE 'd' || k END AS diagnosis,
    CASE WHEN u THEN '' ELSE 's' || k END AS solution, CASE WHEN u THEN '' ELSE coalesce(NULL, '-') END AS mnemonic, CAST(CASE WHEN u THEN 0 ELSE 1 END AS BIGINT) AS cards FROM (SELECT event_id, event_id % 3 = 0 AS u, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""))
def batch_placeholders(d: Domain) -> DataFrame:
    """Every event of a batch with what its answer says, or a placeholder where no answer can be read; what an answer leaves out stays null."""
    k = F.get_json_object("props", "$.k")
    said = F.concat(F.lit('```json\n[{"error_type":"k'), k, F.lit('","diagnosis":"d'), k, F.lit('","solution":"s'), k, F.lit('","knowledge_cards":[{"concept":"c'), k, F.lit('"}],"difficulty":'), (F.col("event_id") % 5 + 1).cast("string"), F.lit("}]\n```"))
    rows = d.read("events").select("event_id", (F.floor(F.col("event_id") / 4) + 1).alias("batch"), (F.col("event_id") % 4 + 1).alias("place"), F.when(F.col("event_id") % 3 == 0, "no json").otherwise(said).alias("answer"))
    got, level = documents.repaired_array(F.col("answer"), "struct<error_type:string,diagnosis:string,solution:string,mnemonic:string,knowledge_cards:array<struct<concept:string>>,difficulty:bigint>")
    parsed = rows.select("event_id", level.alias("level"), F.get(got, F.lit(0)).alias("x")).where("level < 5").select("event_id", "x.*")
    out = documents.with_placeholders(rows.drop("answer"), parsed, ["event_id"])
    return out.select("event_id", "error_type", "difficulty", "diagnosis", "solution", F.coalesce("mnemonic", F.lit("-")).alias("mnemonic"), F.size("knowledge_cards").cast("long").alias("cards"))


@query(sql("SELECT id, total_score FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS n FROM records WHERE (created_at, id) < (SELECT (created_at, id) FROM records ORDER BY created_at DESC, id DESC LIMIT 1 OFFSET 40)) WHERE n <= 20"))
def deep_page(d: Domain) -> DataFrame:
    """The twenty records after the forty-first newest one: a page by its last row instead of by its number."""
    rows = d.records().select("id", "total_score", "created_at")
    last = rows.orderBy(F.desc("created_at"), F.desc("id")).limit(41).orderBy("created_at", "id").first()
    if last is None:
        return rows.select("id", "total_score")
    return views.after(rows, F.lit(last["created_at"]), F.lit(last["id"]), 20).select("id", "total_score")


@query(sql("SELECT p_partkey AS id, CASE p_size % 8 WHEN 0 THEN 3 WHEN 6 THEN 5 WHEN 7 THEN 5 ELSE p_size % 8 END AS difficulty, CASE WHEN p_size % 2 = 0 THEN chr(CAST(65 + p_partkey % 4 AS INTEGER)) ELSE '' END AS letter FROM part"))
def field_rules(d: Domain) -> DataFrame:
    """Difficulties within their range, and the letter that an option begins with."""
    option = F.concat(F.when(F.col("p_size") % 2 == 0, F.char(65 + F.col("p_partkey") % 4)).otherwise("x"), F.lit(". "), F.col("p_name"))
    return d.read("part").select(F.col("p_partkey").alias("id"), C.clamp_difficulty(F.col("p_size") % 8).alias("difficulty"), C.option_letter(option).alias("letter"))
