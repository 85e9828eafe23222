"""The domain's tables, derived from the given ones, once as DataFrames and once as SQL for the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.columns import ERROR_TYPES, falsy
from marginalia.operators.admission import cost
from marginalia.sources.tables import latest, read

TYPES = (*ERROR_TYPES, "")
FMT, SQL_FMT = "yyyy-MM-dd HH:mm:ss", "'%Y-%m-%d %H:%M:%S'"


def said(ts) -> object:
    return F.date_format(ts, FMT)


class Domain:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return read(self.spark, self.dir, name)

    def users(self) -> DataFrame:
        return self.read("customer").join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("email"), F.col("n_name").alias("region"), F.when(F.col("c_custkey") == 0, "admin").otherwise("user").alias("role")
        )

    def sessions(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("processing")
        return self.read("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("subject"),
            (F.col("o_orderkey") % 10 + 1).alias("image_count"), status.alias("status"), F.col("o_orderdate").alias("created_at"),
        )

    def versions(self) -> DataFrame:
        """Mistakes as submitted; a key (session_id, number) may come again, later by (created_at, part, supplier, price)."""
        kind = F.get(F.array(*map(F.lit, TYPES)), (F.col("l_partkey") % 7).cast("int"))
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").cast("long").alias("number"), F.col("l_shipdate").alias("created_at"), F.col("l_partkey").alias("part"),
            F.col("l_suppkey").alias("supplier"), F.col("l_extendedprice").alias("price"), kind.alias("error_type"), (F.col("l_suppkey") % 6).alias("difficulty"),
        )

    def owned(self, versions: DataFrame) -> DataFrame:
        owner = self.sessions().select(F.col("id").alias("session_id"), "user_id", "subject")
        return versions.join(owner, "session_id").withColumn("difficulty", falsy(F.col("difficulty"), 0, 3))

    def errors(self) -> DataFrame:
        """The stored mistakes: the last version of each key with the defaults of the store."""
        return self.owned(latest(self.versions(), ["session_id", "number"], ["created_at", "part", "supplier", "price"]))

    def times(self) -> DataFrame:
        """session_id, number and created_at of the stored mistakes: the last version of a key is one of its greatest time."""
        return self.versions().groupBy("session_id", "number").agg(F.max("created_at").alias("created_at"))

    def knowledge(self) -> DataFrame:
        return self.read("part").groupBy(F.col("p_type").alias("subject"), F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"), F.min_by("p_brand", "p_partkey").alias("parent"))

    def tags(self) -> DataFrame:
        parts = self.read("part").select("p_partkey", F.col("p_type").alias("subject"), F.col("p_name").alias("name")).join(self.knowledge().select("subject", "name", "id"), ["subject", "name"])
        lines = self.read("lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").cast("long").alias("number"), F.col("l_partkey").alias("p_partkey")).distinct()
        return lines.join(parts.select("p_partkey", F.col("id").alias("kp_id")), "p_partkey").select("session_id", "number", "kp_id").distinct()

    def records(self) -> DataFrame:
        docs, labels = self.read("documents"), self.read("labels").select("doc_id", F.lit(True).alias("labelled")).distinct()
        return docs.join(labels, "doc_id", "left").select(
            F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("user_id"), F.col("text").alias("essay_text"), (F.col("n_chars") % 71).alias("total_score"), "n_chars",
            F.when(F.col("labelled"), "done").otherwise("failed").alias("status"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, cast(doc_id as int))")).alias("created_at"),
        )

    def requests(self) -> DataFrame:
        return self.read("events").select("event_id", "ts", F.col("user_id").cast("string").alias("ip"), "user_id", F.col("event_type").alias("endpoint"), cost(F.col("event_type")).alias("tokens"), (F.col("user_id") == 0).alias("is_admin"))

    def transitions(self) -> DataFrame:
        status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "processing").otherwise("queued")
        kind = F.when(F.col("event_id") % 1000 % 3 == 0, "paper").when(F.col("event_id") % 1000 % 3 == 1, "essay").otherwise("light")
        return self.read("events").select((F.col("event_id") % 1000).alias("task_id"), kind.alias("kind"), status.alias("status"), F.col("ts").alias("updated_at"), "event_id")


_CASE = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES))
CTE = {
    "users": "SELECT c_custkey AS id, c_name AS email, n_name AS region, CASE WHEN c_custkey = 0 THEN 'admin' ELSE 'user' END AS role FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "sessions": """SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority AS subject, o_orderkey % 10 + 1 AS image_count,
        CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'processing' END AS status, o_orderdate AS created_at FROM orders""",
    "versions": f"""SELECT l_orderkey AS session_id, CAST(l_linenumber AS BIGINT) AS number, l_shipdate AS created_at, l_partkey AS part, l_suppkey AS supplier,
        l_extendedprice AS price, CASE l_partkey % 7 {_CASE} END AS error_type, l_suppkey % 6 AS difficulty FROM lineitem""",
    "errors": """SELECT session_id, number, v.created_at, part, supplier, price, error_type, CASE difficulty WHEN 0 THEN 3 ELSE difficulty END AS difficulty, user_id, subject
        FROM (SELECT *, row_number() OVER (PARTITION BY session_id, number ORDER BY created_at DESC, part DESC, supplier DESC, price DESC) AS rn FROM versions) v
        JOIN sessions s ON s.id = v.session_id WHERE rn = 1""",
    "knowledge": "SELECT p_type AS subject, p_name AS name, min(p_partkey) AS id, arg_min(p_brand, p_partkey) AS parent FROM part GROUP BY 1, 2",
    "tags": """SELECT DISTINCT l_orderkey AS session_id, CAST(l_linenumber AS BIGINT) AS number, k.id AS kp_id FROM lineitem JOIN part ON l_partkey = p_partkey
        JOIN knowledge k ON k.subject = p_type AND k.name = p_name""",
    "records": """SELECT d.doc_id AS id, d.doc_id % 50 AS user_id, d.text AS essay_text, d.n_chars % 71 AS total_score, d.n_chars, CASE WHEN l.doc_id IS NULL THEN 'failed' ELSE 'done' END AS status,
        TIMESTAMP '2024-01-01' + to_hours(CAST(d.doc_id AS INTEGER)) AS created_at FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id""",
    "requests": """SELECT event_id, ts, CAST(user_id AS VARCHAR) AS ip, user_id, event_type AS endpoint, CAST(CASE event_type WHEN 'click' THEN 15000 WHEN 'error' THEN 8000 WHEN 'purchase' THEN 50000
        WHEN 'signup' THEN 10000 ELSE 5000 END AS BIGINT) AS tokens, user_id = 0 AS is_admin FROM events""",
    "transitions": """SELECT event_id % 1000 AS task_id, CASE event_id % 1000 % 3 WHEN 0 THEN 'paper' WHEN 1 THEN 'essay' ELSE 'light' END AS kind,
        CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'processing' ELSE 'queued' END AS status, ts AS updated_at, event_id FROM events""",
}


def sql(body: str, *more: str) -> str:
    """body after the definitions that it names, and `more` ones (name AS (...))."""
    text, names = " ".join((body, *more)), []
    for name in reversed(CTE):  # later ones build on earlier ones
        if any(f" {name}{end}" in text.replace("\n", " ") + " " for end in (" ", ")", ",", ".")):
            names.insert(0, name)
            text += " " + CTE[name] + " "
    parts = [f"{n} AS ({CTE[n]})" for n in names] + list(more)
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
