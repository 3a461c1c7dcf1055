"""The logical model over the given tables, as DataFrames and as the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(spark, sf_dir: str, name: str) -> DataFrame:
    """A given table. A file of one row group is read by one task; the setting ``docquill.spread`` deals the rows of texts to so many.

    That moves the texts once, so it is off by default and should stay off where
    a table has more row groups than the cluster has cores.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spread = spark.conf.get("docquill.spread", None)
    return df.repartition(int(spread)) if spread and name in ("documents", "pages") else df


def elements(spark, sf_dir: str) -> DataFrame:
    """The lines of ``documents`` as ordered elements with a page and a category; every tenth is a numbered heading."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("seq", "line"))
    k = (F.col("doc_id") * 31 + F.col("seq") * 7) % 10
    category = F.when(k == 0, "Title").when(k.isin(1, 2, 3), "ListItem").when(k == 4, "UncategorizedText").when(k == 5, "Header").otherwise("NarrativeText")
    number = F.concat((F.col("seq") % 9 + 1).cast("string"), F.lit("."), (F.col("doc_id") % 5 + 1).cast("string"), F.lit(" "))
    text = F.when(k == 0, F.concat(number, F.col("line"))).otherwise(F.col("line"))
    return lines.select("doc_id", "seq", (F.floor(F.col("seq") / 8) + 1).cast("long").alias("page"), category.alias("category"), text.alias("text"))


ELEMENTS = """lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents
), keyed AS (SELECT *, (doc_id * 31 + seq * 7) % 10 AS k FROM lines), elements AS (
    SELECT doc_id, seq, seq // 8 + 1 AS page,
        CASE WHEN k = 0 THEN 'Title' WHEN k IN (1, 2, 3) THEN 'ListItem' WHEN k = 4 THEN 'UncategorizedText' WHEN k = 5 THEN 'Header' ELSE 'NarrativeText' END AS category,
        CASE WHEN k = 0 THEN (seq % 9 + 1) || '.' || (doc_id % 5 + 1) || ' ' || line ELSE line END AS text
    FROM keyed
)"""


def chunks(spark, sf_dir: str) -> DataFrame:
    """``embeddings`` as chunk vectors: chunk_id, doc_id, run_id, content of the document of that number, embedding."""
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    found = e.join(d.select(F.col("doc_id").alias("d"), F.col("text").alias("content")), F.col("vec_id") == F.col("d"), "left")
    return found.select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 40).alias("doc_id"), F.col("label").alias("run_id"), "content", "embedding")


CHUNKS = """chunks AS (
    SELECT vec_id AS chunk_id, vec_id % 40 AS doc_id, label AS run_id, d.text AS content, embedding
    FROM embeddings LEFT JOIN documents d ON d.doc_id = vec_id
)"""


def owned_documents(spark, sf_dir: str) -> DataFrame:
    """``documents`` with access level, owner, upload type, project and time of deletion."""
    d = table(spark, sf_dir, "documents")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % n + 1).cast("int"))
    return d.select(
        "doc_id", "text", "lang", "source", "n_chars", pick(3, "public", "auth", "private").alias("access_level"), (F.col("doc_id") % 7).alias("user_id"),
        pick(2, "email", "user_project").alias("upload_type"), (F.col("doc_id") % 11).alias("project_id"), (F.col("doc_id") % 13 == 0).alias("deleted"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"),
    )


OWNED = """owned AS (
    SELECT doc_id, text, lang, source, n_chars, ['public', 'auth', 'private'][doc_id % 3 + 1] AS access_level, doc_id % 7 AS user_id,
        ['email', 'user_project'][doc_id % 2 + 1] AS upload_type, doc_id % 11 AS project_id, doc_id % 13 = 0 AS deleted, 'doc_' || doc_id || '.pdf' AS filename
    FROM documents
)"""


def runs(spark, sf_dir: str) -> DataFrame:
    """``orders`` as indexing runs: run_id, user_id, access_level, upload_type, project_id, status, created."""
    o = table(spark, sf_dir, "orders")
    level = F.when(F.col("o_orderstatus") == "F", "private").when(F.col("o_orderstatus") == "O", "public").otherwise("auth")
    status = F.when(F.col("o_orderpriority").startswith("1"), "failed").when(F.col("o_orderpriority").startswith("2"), "running").otherwise("completed")
    return o.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("user_id"), level.alias("access_level"),
        F.when(F.col("o_orderkey") % 2 == 0, "email").otherwise("user_project").alias("upload_type"),
        (F.col("o_orderkey") % 100).alias("project_id"), status.alias("status"), F.col("o_orderdate").alias("created"), F.col("o_totalprice").alias("price"),
    )


RUNS = """runs AS (
    SELECT o_orderkey AS run_id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'private' WHEN 'O' THEN 'public' ELSE 'auth' END AS access_level,
        CASE WHEN o_orderkey % 2 = 0 THEN 'email' ELSE 'user_project' END AS upload_type, o_orderkey % 100 AS project_id,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'failed' WHEN '2' THEN 'running' ELSE 'completed' END AS status, o_orderdate AS created, o_totalprice AS price
    FROM orders
)"""


def projects(spark, sf_dir: str) -> DataFrame:
    """``customer`` as projects 0 to n: project_id, user_id, name, deleted."""
    c = table(spark, sf_dir, "customer")
    return c.select((F.col("c_custkey")).alias("project_id"), (F.col("c_custkey") % 50).alias("user_id"), F.col("c_name").alias("name"), (F.col("c_acctbal") < 0).alias("deleted"))


PROJECTS = "projects AS (SELECT c_custkey AS project_id, c_custkey % 50 AS user_id, c_name AS name, c_acctbal < 0 AS deleted FROM customer)"


def query_runs(spark, sf_dir: str) -> DataFrame:
    """``events`` as the log of query runs: id, ts, user_id, status, response_ms, meta (JSON), access_level."""
    e = table(spark, sf_dir, "events")
    level = F.element_at(F.array(F.lit("public"), F.lit("auth"), F.lit("private")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
        F.col("value").alias("response_ms"), F.col("props").alias("meta"), level.alias("access_level"), F.col("event_type"),
    )


QUERY_RUNS = """query_runs AS (
    SELECT event_id AS id, ts, user_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, value AS response_ms, props AS meta,
        ['public', 'auth', 'private'][event_id % 3 + 1] AS access_level, event_type
    FROM events
)"""
