"""Registered views of the notebook."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.columns import percent, weak_severity
from marginalia.operators import views

from .domain import FMT, SQL_FMT, Domain, said, sql
from .registry import query

_TYPES = ", ".join(f"count(e.session_id) FILTER (e.error_type = '{t}') AS {n}" for n, t in views.PAPER_TYPES.items())


@query(sql(f"SELECT s.id, s.user_id, s.subject, strftime(s.created_at, {SQL_FMT}) AS created_at, count(e.session_id) AS error_count, {_TYPES} FROM sessions s LEFT JOIN errors e ON e.session_id = s.id GROUP BY ALL"))
def errors_by_paper(d: Domain) -> DataFrame:
    return views.by_paper(d.sessions(), d.errors()).select("id", "user_id", "subject", said("created_at").alias("created_at"), "error_count", *views.PAPER_TYPES)


def _time_sql(label: str) -> str:
    return sql(f"""SELECT user_id, {label} AS time_label, strftime(min(created_at), {SQL_FMT}) AS start_ts, strftime(max(created_at), {SQL_FMT}) AS end_ts, count(*) AS error_count,
        count(DISTINCT subject) AS subject_count, count(DISTINCT session_id) AS paper_count FROM errors GROUP BY 1, 2""")


def _time(d: Domain, period: str) -> DataFrame:
    return views.by_time(d.times(), d.sessions(), period).withColumns({"start_ts": F.date_format("start_ts", FMT), "end_ts": F.date_format("end_ts", FMT)})


@query(_time_sql("strftime(created_at, '%Y-%m')"))
def errors_by_month(d: Domain) -> DataFrame:
    return _time(d, "month")


@query(_time_sql("CASE WHEN month(created_at) BETWEEN 3 AND 8 THEN strftime(created_at, '%Y') || '-下' ELSE strftime(created_at, '%Y') || '-上' END"))
def errors_by_semester(d: Domain) -> DataFrame:
    return _time(d, "semester")


@query(_time_sql("strftime(created_at, '%Y')"))
def errors_by_year(d: Domain) -> DataFrame:
    return _time(d, "year")


@query(sql("SELECT user_id, subject, count(*) AS error_count, count(DISTINCT session_id) AS paper_count, string_agg(DISTINCT error_type, ',' ORDER BY error_type) AS error_types FROM errors GROUP BY 1, 2"))
def errors_by_subject(d: Domain) -> DataFrame:
    return views.by_subject(d.errors()).select("user_id", "subject", "error_count", "paper_count", F.array_join("types", ",").alias("error_types"))


_PAGE = "row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, session_id, number)"


@query(sql(f"""SELECT user_id, session_id, number, subject, difficulty, strftime(created_at, {SQL_FMT}) AS created_at, place FROM
    (SELECT *, {_PAGE} AS place FROM errors WHERE subject = '2-HIGH' AND created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '2000-12-31') WHERE place > 5 AND place <= 10"""))
def error_list_page(d: Domain) -> DataFrame:
    rows = views.filtered(d.errors(), subject="2-HIGH", start=F.lit("1996-01-01").cast("timestamp"), end=F.lit("2000-12-31").cast("timestamp"))
    rows = views.page(rows, ["user_id"], [F.desc("created_at"), F.col("session_id"), F.col("number")], 2, 5)
    return rows.select("user_id", "session_id", "number", "subject", "difficulty", said("created_at").alias("created_at"), F.col("place").cast("long").alias("place"))


@query(sql("""SELECT e.session_id, e.number, count(k.id) AS n_tags, coalesce(string_agg(k.name, ',' ORDER BY k.id), '') AS tags FROM errors e
    LEFT JOIN tags t ON t.session_id = e.session_id AND t.number = e.number LEFT JOIN knowledge k ON k.id = t.kp_id GROUP BY 1, 2"""))
def error_tags(d: Domain) -> DataFrame:
    named = d.tags().join(d.knowledge().select(F.col("id").alias("kp_id"), "name"), "kp_id")
    own = named.groupBy("session_id", "number").agg(F.sort_array(F.collect_list(F.struct("kp_id", "name"))).alias("t"))
    return d.errors().join(own, ["session_id", "number"], "left").select(
        "session_id", "number", F.coalesce(F.size("t"), F.lit(0)).cast("long").alias("n_tags"), F.coalesce(F.array_join("t.name", ","), F.lit("")).alias("tags")
    )


@query(sql("""SELECT user_id, count(*) AS total, count(*) FILTER (created_at >= (SELECT max(created_at) FROM errors) - INTERVAL 30 DAY) AS recent, 'all' AS kind, '' AS value FROM errors GROUP BY 1
    UNION ALL SELECT user_id, count(*), 0, 'subject', subject FROM errors GROUP BY 1, subject
    UNION ALL SELECT user_id, count(*), 0, 'type', error_type FROM errors WHERE error_type <> '' GROUP BY 1, error_type"""))
def error_stats(d: Domain) -> DataFrame:
    """One pass over the mistakes: grouping sets of user, user and subject, user and type."""
    errors = d.errors().select("user_id", "subject", "error_type", "created_at")
    as_of = d.read("lineitem").agg(F.max("l_shipdate")).first()[0]  # the last version of a key is the last of all at its greatest time
    recent = F.count_if(F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.expr("interval 30 days")).alias("recent")
    user, subject, kind = F.col("user_id"), F.col("subject"), F.col("error_type")
    sets = errors.groupingSets([[user], [user, subject], [user, kind]], user, subject, kind)
    rows = sets.agg(F.count("*").alias("total"), recent, F.grouping("subject").alias("no_subject"), F.grouping("error_type").alias("no_type"))
    rows = rows.where((F.col("no_type") == 1) | (kind != ""))
    what = F.when(F.col("no_subject") == 0, "subject").when(F.col("no_type") == 0, "type").otherwise("all")
    return rows.select("user_id", "total", F.when(what == "all", F.col("recent")).otherwise(0).cast("long").alias("recent"), what.alias("kind"), F.coalesce("subject", "error_type", F.lit("")).alias("value"))


@query(sql("""SELECT user_id, count(*) FILTER (status = 'done') AS done, coalesce(round(avg(total_score) FILTER (status = 'done' AND total_score > 0), 1), 0) AS avg_score,
    count(*) FILTER (created_at >= date_trunc('day', (SELECT max(created_at) FROM records))) AS today FROM records GROUP BY 1"""))
def grading_stats(d: Domain) -> DataFrame:
    rows = d.records().drop("essay_text")
    day = F.date_trunc("day", F.lit(rows.agg(F.max("created_at")).first()[0]).cast("timestamp"))
    done = F.col("status") == "done"
    return rows.groupBy("user_id").agg(
        F.count_if(done).alias("done"), F.coalesce(F.round(F.avg(F.when(done & (F.col("total_score") > 0), F.col("total_score"))), 1), F.lit(0.0)).alias("avg_score"), F.count_if(F.col("created_at") >= day).alias("today")
    )


@query(sql(f"SELECT id, user_id, total_score, strftime(created_at, {SQL_FMT}) AS created_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS place FROM records WHERE status = 'done') WHERE place <= 10"))
def history_page(d: Domain) -> DataFrame:
    rows = d.records().where("status = 'done'").select("id", "user_id", "total_score", "created_at")
    return views.page(rows, ["user_id"], [F.desc("created_at"), F.col("id")], 1, 10).select("id", "user_id", "total_score", said("created_at").alias("created_at"))


_KP = "SELECT user_id, kp_id, k.subject, k.name, count(*) AS error_count FROM tags JOIN errors USING (session_id, number) JOIN knowledge k ON k.id = kp_id GROUP BY ALL"


@query(sql("""SELECT user_id, kp_id, subject, name, error_count, place, CAST(round(100.0 * error_count / greatest(1, top)) AS BIGINT) AS bar, error_count >= 2 AS weak, error_count >= 3 AS hot,
    CASE place WHEN 1 THEN 'first' WHEN 2 THEN 'second' WHEN 3 THEN 'third' ELSE '' END AS badge FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY error_count DESC, kp_id) AS place, max(error_count) OVER (PARTITION BY user_id) AS top FROM kp) WHERE place <= 50""", f"kp AS ({_KP})"))
def knowledge_stats(d: Domain) -> DataFrame:
    rows = views.knowledge_counts(d.tags(), d.errors(), d.knowledge()).withColumn("top", F.max("error_count").over(Window.partitionBy("user_id")))
    rows = views.page(rows, ["user_id"], [F.desc("error_count"), F.col("kp_id")], 1, 50)
    n = F.col("error_count")
    badge = F.when(F.col("place") == 1, "first").when(F.col("place") == 2, "second").when(F.col("place") == 3, "third").otherwise("")
    return rows.select("user_id", "kp_id", "subject", "name", "error_count", F.col("place").cast("long").alias("place"), F.round(100 * n / F.greatest(F.lit(1), F.col("top"))).cast("long").alias("bar"), (n >= 2).alias("weak"), (n >= 3).alias("hot"), badge.alias("badge"))


@query(sql("""SELECT kp_id, session_id, number, user_id, place FROM (SELECT kp_id, session_id, number, user_id,
    row_number() OVER (PARTITION BY kp_id ORDER BY created_at DESC, session_id, number) AS place FROM tags JOIN errors USING (session_id, number)) WHERE place <= 100"""))
def errors_by_kp(d: Domain) -> DataFrame:
    rows = d.tags().join(d.errors(), ["session_id", "number"])
    return views.page(rows, ["kp_id"], [F.desc("created_at"), F.col("session_id"), F.col("number")], 1, 100).select("kp_id", "session_id", "number", "user_id", F.col("place").cast("long").alias("place"))


@query(sql("SELECT id, subject, name FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY id) AS n FROM knowledge WHERE name ILIKE '%Ed W%') WHERE n <= 20"))
def kp_search(d: Domain) -> DataFrame:
    return views.search(d.knowledge(), "Ed W").select("id", "subject", "name")


@query(sql("""SELECT DISTINCT t.session_id, t.number, f.kp_id FROM terms t JOIN (SELECT subject, term, min(k.id) AS kp_id FROM (SELECT DISTINCT subject, term FROM terms) JOIN knowledge k USING (subject)
    WHERE contains(lower(k.name), lower(term)) GROUP BY 1, 2) f USING (subject, term)""",
    "terms AS (SELECT e.session_id, e.number, p_type AS subject, CASE WHEN e.session_id % 2 = 1 THEN upper(split_part(p_name, ' ', 2)) ELSE split_part(p_name, ' ', 2) END AS term FROM errors e JOIN part ON p_partkey = e.part)"))
def kp_fuzzy_tags(d: Domain) -> DataFrame:
    second = F.get(F.split("p_name", " "), F.lit(1))
    terms = d.errors().join(d.read("part"), F.col("part") == F.col("p_partkey")).select("session_id", "number", F.col("p_type").alias("subject"), F.when(F.col("session_id") % 2 == 1, F.upper(second)).otherwise(second).alias("term"))
    return views.fuzzy_tags(terms, d.knowledge())


@query(sql("""SELECT p_type AS subject, p_brand AS parent_name, p_name AS name, 'item' AS category FROM (SELECT DISTINCT p_type, p_brand, p_name FROM part)
    UNION ALL SELECT p_type, NULL, p_brand, 'category' FROM (SELECT DISTINCT p_type, p_brand FROM part)"""))
def taxonomy_tree(d: Domain) -> DataFrame:
    category = d.read("part").groupBy(F.col("p_type").alias("subject"), "p_brand").agg(F.collect_set("p_name").alias("items"))  # few names, whatever the size
    nested = category.select("subject", F.array(F.struct(F.col("p_brand").alias("name"), "items")).alias("categories"))  # a row for each category
    return views.with_parent(views.seeded(nested)).select("subject", "parent_name", "name", "category")


@query(sql("""SELECT user_id, count(*) AS papers, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages, CAST(sum(n) AS BIGINT) AS total_errors, max(n) AS most FROM (SELECT s.user_id, s.id, count(e.session_id) AS n FROM sessions s
    LEFT JOIN errors e ON e.session_id = s.id GROUP BY 1, 2) GROUP BY 1"""))
def paging_totals(d: Domain) -> DataFrame:
    return views.by_paper(d.sessions(), d.errors()).groupBy("user_id").agg(
        F.count("*").alias("papers"), F.ceil(F.count("*") / 20).cast("long").alias("pages"), F.sum("error_count").alias("total_errors"), F.max("error_count").alias("most")
    )


@query(sql("""SELECT e.user_id, e.session_id, e.number FROM errors e JOIN (SELECT user_id, strftime(created_at, '%Y-%m') AS label, min(created_at) AS lo, max(created_at) AS hi FROM errors GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, label) = 1) g ON g.user_id = e.user_id AND e.created_at BETWEEN g.lo AND g.hi"""))
def drilldown(d: Domain) -> DataFrame:
    """The mistakes of each user's fullest month, by the group row's own range."""
    errors = d.times().join(d.sessions().select(F.col("id").alias("session_id"), "user_id"), "session_id")
    top = views.page(views.by_time(d.times(), d.sessions(), "month"), ["user_id"], [F.desc("error_count"), F.col("time_label")], 1, 1).select(F.col("user_id").alias("u"), "start_ts", "end_ts")
    return errors.join(top, (F.col("user_id") == F.col("u")) & F.col("created_at").between(F.col("start_ts"), F.col("end_ts")), "left_semi").select("user_id", "session_id", "number")


@query(sql("""SELECT u.id AS user_id, coalesce(e.n, 0) AS errors, coalesce(k.points, 0) AS points, coalesce(k.weak, 0) AS weak, coalesce(e.today, 0) AS today FROM users u
    LEFT JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (created_at >= date_trunc('day', (SELECT max(created_at) FROM errors))) AS today FROM errors GROUP BY 1) e ON e.user_id = u.id
    LEFT JOIN (SELECT user_id, count(*) AS points, count(*) FILTER (error_count >= 2) AS weak FROM kp GROUP BY 1) k ON k.user_id = u.id""", f"kp AS ({_KP})"))
def dashboard_tiles(d: Domain) -> DataFrame:
    errors = d.errors()
    day = F.date_trunc("day", F.lit(d.read("lineitem").agg(F.max("l_shipdate")).first()[0]).cast("timestamp"))
    mine = errors.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("errors"), F.count_if(F.col("created_at") >= day).alias("today"))
    points = views.knowledge_counts(d.tags(), errors, d.knowledge()).groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("points"), F.count_if(F.col("error_count") >= 2).alias("weak"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return d.users().select("id").join(mine, "id", "left").join(points, "id", "left").select(F.col("id").alias("user_id"), zero("errors"), zero("points"), zero("weak"), zero("today"))


@query(sql("""SELECT e.user_id, e.subject, total, CAST(d.level AS BIGINT) AS level, coalesce(n, 0) AS n FROM (SELECT user_id, subject, count(*) AS total FROM errors GROUP BY 1, 2) e CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS level) d
    LEFT JOIN (SELECT user_id, subject, difficulty, count(*) AS n FROM errors GROUP BY ALL) c ON c.user_id = e.user_id AND c.subject = e.subject AND c.difficulty = d.level"""))
def guidance_summary(d: Domain) -> DataFrame:
    """Mistakes of a user and subject by difficulty, all five levels there."""
    levels = [F.struct(F.lit(k).cast("long").alias("level"), F.count_if(F.col("difficulty") == k).alias("n")) for k in range(1, 6)]
    rows = d.errors().groupBy("user_id", "subject").agg(F.count("*").alias("total"), F.array(*levels).alias("levels"))
    return rows.select("user_id", "subject", "total", F.explode("levels").alias("l")).select("user_id", "subject", "total", "l.level", "l.n")


@query(sql("SELECT user_id, subject, session_id, number, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, subject ORDER BY created_at DESC, session_id, number) AS n FROM errors) WHERE n <= 10"))
def guidance_latest(d: Domain) -> DataFrame:
    rows = views.page(d.errors(), ["user_id", "subject"], [F.desc("created_at"), F.col("session_id"), F.col("number")], 1, 10)
    return rows.select("user_id", "subject", "session_id", "number", F.col("place").cast("long").alias("n"))


@query(sql("""SELECT *, CASE WHEN n >= 6 THEN 'high' WHEN n >= 3 THEN 'medium' ELSE 'low' END AS severity, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, subject, area) AS priority FROM
    (SELECT user_id, k.subject, k.parent AS area, count(*) AS n FROM tags JOIN errors USING (session_id, number) JOIN knowledge k ON k.id = kp_id GROUP BY ALL)"""))
def weak_areas(d: Domain) -> DataFrame:
    points = d.knowledge().select(F.col("id").alias("kp_id"), F.col("subject"), F.col("parent").alias("area"))
    rows = d.tags().join(d.errors().select("session_id", "number", "user_id"), ["session_id", "number"]).join(points, "kp_id").groupBy("user_id", "subject", "area").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "subject", "area")).cast("long")
    return rows.withColumns({"severity": weak_severity(F.col("n")), "priority": place})


@query(sql("SELECT user_id, subject, error_type, n, CAST(round(100.0 * n / sum(n) OVER (PARTITION BY user_id, subject)) AS BIGINT) AS share FROM (SELECT user_id, subject, error_type, count(*) AS n FROM errors GROUP BY ALL)"))
def dominant_types(d: Domain) -> DataFrame:
    rows = d.errors().groupBy("user_id", "subject", "error_type").agg(F.count("*").alias("n"))
    return rows.withColumn("share", percent(F.col("n"), F.sum("n").over(Window.partitionBy("user_id", "subject"))).cast("long"))
