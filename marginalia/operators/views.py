"""Roll-ups of mistakes by paper, time, subject and knowledge point, and pages of lists. Every one is for all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.columns import ERROR_TYPES, month_label, semester_label, year_label

PAPER_TYPES = dict(zip(("concept_errors", "calc_errors", "reading_errors", "method_errors", "knowledge_errors"), ERROR_TYPES))


def by_paper(sessions: DataFrame, errors: DataFrame) -> DataFrame:
    """Each session with its mistakes and five of their types; mistakes are counted before the join, papers without any get 0."""
    counts = errors.groupBy(F.col("session_id").alias("id")).agg(
        F.count("*").alias("error_count"), *[F.count_if(F.col("error_type") == t).alias(n) for n, t in PAPER_TYPES.items()]
    )
    names = ["error_count", *PAPER_TYPES]
    return sessions.join(counts, "id", "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in names})


LABELS = {"month": month_label, "semester": semester_label, "year": year_label}


def by_time(times: DataFrame, sessions: DataFrame, period: str = "month") -> DataFrame:
    """times: session_id and created_at of each mistake. These are summed by paper before they meet their sessions, so that wide rows are never grouped.

    Papers are counted where a session's rows of one user begin, so that subjects alone are counted as distinct ones and no row is expanded.
    """
    label = LABELS[period](F.col("created_at")).alias("time_label")
    papers = times.groupBy("session_id", label).agg(F.min("created_at").alias("low"), F.max("created_at").alias("high"), F.count("*").alias("n"))
    before = F.lag(F.struct("user_id")).over(Window.partitionBy("session_id").orderBy("user_id", "subject"))
    owners = sessions.select(F.col("id").alias("session_id"), "user_id", "subject").where("session_id is not null")
    owners = owners.withColumn("paper", (~before.eqNullSafe(F.struct("user_id"))).cast("long"))
    return papers.join(owners, "session_id").groupBy("user_id", "time_label").agg(
        F.min("low").alias("start_ts"), F.max("high").alias("end_ts"), F.sum("n").alias("error_count"),
        F.countDistinct("subject").alias("subject_count"), F.sum("paper").alias("paper_count"),
    )


def by_subject(errors: DataFrame) -> DataFrame:
    """The list of types is sorted; blank alone gives an empty list."""
    types = F.sort_array(F.collect_set("error_type"))
    return errors.groupBy("user_id", "subject").agg(F.count("*").alias("error_count"), F.countDistinct("session_id").alias("paper_count"), types.alias("types"))


def filtered(errors: DataFrame, *, user=None, subject=None, session=None, start=None, end=None) -> DataFrame:
    """Rows that meet all conditions given; subject 'all' is none, both ends of time count."""
    conditions = [
        None if user is None else F.col("user_id") == user,
        None if subject in (None, "all") else F.col("subject") == subject,
        None if session is None else F.col("session_id") == session,
        None if start is None else F.col("created_at") >= start,
        None if end is None else F.col("created_at") <= end,
    ]
    for c in conditions:
        errors = errors if c is None else errors.where(c)
    return errors


def page(df: DataFrame, by: list[str], order: list[Column], number: int, limit: int) -> DataFrame:
    """Page `number` of each group, with its place (1 is the first of all pages)."""
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where((F.col("place") > (number - 1) * limit) & (F.col("place") <= number * limit))


def after(df: DataFrame, ts, id_, limit: int) -> DataFrame:
    """The next `limit` rows after (ts, id) in newest-first order: what a deep page should use."""
    below = (F.col("created_at") < ts) | ((F.col("created_at") == ts) & (F.col("id") < id_))
    return df.where(below).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def knowledge_counts(tags: DataFrame, errors: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Mistakes of each user by knowledge point; attributes join after the count."""
    counts = tags.join(errors.select("session_id", "number", "user_id"), ["session_id", "number"]).groupBy("user_id", "kp_id").agg(F.count("*").alias("error_count"))
    return counts.join(knowledge.select(F.col("id").alias("kp_id"), "subject", "name"), "kp_id")


def search(knowledge: DataFrame, term: str, subject: str | None = None, cap: int = 20) -> DataFrame:
    """The first `cap` points of each subject whose name holds the term, case aside; a blank term finds nothing."""
    if not term.strip():
        return knowledge.limit(0)
    hits = knowledge.where(F.col("name").ilike(f"%{term}%"))
    hits = hits if subject is None else hits.where(F.col("subject") == subject)
    return page(hits, ["subject"], [F.col("id")], 1, cap).drop("place")


def fuzzy_tags(terms: DataFrame, knowledge: DataFrame, gram: int = 3) -> DataFrame:
    """(key columns, kp_id) for terms (session_id, number, subject, term): the first point of the subject whose name holds the term.

    Distinct terms meet the points once. Names are filed under each of their grams; a term looks under its rarest one, so
    the join compares what shares a gram instead of all pairs of a subject. Terms shorter than a gram look under a letter.
    """
    distinct = terms.select("subject", "term", F.lower("term").alias("low")).where("term <> ''").distinct()
    kp = knowledge.select("subject", F.lower("name").alias("name"), "id")

    def grams(text: str, n: int) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1)), lambda i: F.substring(F.col(text), i, n)))

    filed = kp.select("subject", "name", "id", F.explode(F.concat(grams("name", gram), grams("name", 1))).alias("gram")).distinct()
    sizes = filed.groupBy("subject", "gram").agg(F.count("*").alias("n"))
    asked = distinct.withColumn("gram", F.explode(F.when(F.length("low") >= gram, grams("low", gram)).otherwise(grams("low", 1))))
    rarest = asked.join(sizes, ["subject", "gram"]).groupBy("subject", "term", "low").agg(F.min(F.struct("n", "gram")).alias("g"))
    met = rarest.select("subject", "term", "low", F.col("g.gram").alias("gram")).join(filed, ["subject", "gram"])
    found = met.where(F.col("name").contains(F.col("low"))).groupBy("subject", "term").agg(F.min("id").alias("kp_id"))
    return terms.join(found, ["subject", "term"]).select("session_id", "number", "kp_id").distinct()


def seeded(nested: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Parent and child rows of a taxonomy (subject, categories array<struct<name, items array<string>>>); none if there is one already."""
    categories = nested.select("subject", F.posexplode("categories").alias("i", "c"))
    items = categories.select("subject", "i", "c.name", F.posexplode("c.items").alias("j", "item"))
    ident = lambda *c: F.lower(F.hex(F.xxhash64(*c)))
    rows = categories.select(ident("subject", "c.name").alias("id"), "subject", F.col("c.name").alias("name"), F.lit(None).cast("string").alias("parent_id"), F.lit("category").alias("category")).unionByName(
        items.select(ident("subject", "name", "item").alias("id"), "subject", F.col("item").alias("name"), ident("subject", "name").alias("parent_id"), F.lit("item").alias("category"))
    )
    return rows if existing is None or existing.isEmpty() else rows.limit(0)


def with_parent(points: DataFrame) -> DataFrame:
    parent = points.where("category = 'category'").select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    return points.join(parent, "parent_id", "left")
