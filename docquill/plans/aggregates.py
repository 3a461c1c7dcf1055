"""Rollups of logs, runs, chunks and checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docquill.functions import records as RC
from docquill.functions.text import caption_word_count, has_numbers, preview, text_complexity
from docquill.functions.vectors import cosine, norm
from docquill.operators import validation as V
from docquill.operators.chunking import composed
from docquill.operators.elements import inherit_sections
from docquill.plans.model import CHUNKS, ELEMENTS, OWNED, QUERY_RUNS, RUNS, chunks, elements, owned_documents, query_runs, runs, table
from docquill.plans.order import large_documents
from docquill.plans.text import COMPLEXITY, HAS_NUMBERS, MAJOR, TITLE_SQL, WORDS
from docquill.registry import query

NUM = "TRY_CAST(json_extract_string(meta, '$.k') AS DOUBLE)"
#: JSON paths of the measures of a query run: confidence, relevance and three step timings.
MEASURES = {"confidence": "$.performance.confidence", "relevance": "$.quality.relevance_score", "query_processing": "$.timings.query_processing", "retrieval": "$.timings.retrieval", "generation": "$.timings.generation"}


def log_metrics(measures: dict[str, str] = MEASURES, column: str = "metrics"):
    """The measures of a group of query runs; those in JSON by their paths, what is no number left out. (One parse to a struct is no faster: 2.6 s against 2.4 on sf0.1.)"""
    value = lambda path: F.get_json_object(column, path).try_cast("double")
    return [
        F.count("*").alias("total"), F.count(F.when(F.col("status") == "completed", 1)).alias("successful"), F.count(F.when(F.col("status") == "failed", 1)).alias("failed"),
        F.round(F.avg("response_ms"), 6).alias("avg_response"), *[F.round(F.avg(value(path)), 6).alias(f"avg_{name}") for name, path in measures.items()],
    ]


def logged(spark, sf_dir):
    """Query runs with their metrics as JSON; every seventh run has no timings, every eleventh one that is no number."""
    r, k = query_runs(spark, sf_dir), F.get_json_object("meta", "$.k").try_cast("double")
    timings = F.when(F.col("id") % 7 > 0, F.struct((k / 8).alias("query_processing"), (k / 4).alias("retrieval"), F.when(F.col("id") % 11 == 0, "slow").otherwise((k / 2).cast("string")).alias("generation")))
    return r.withColumn("metrics", F.to_json(F.struct(F.struct((k / 128).alias("confidence")).alias("performance"), F.struct((k / 64).alias("relevance_score")).alias("quality"), timings.alias("timings"))))


LOG = f"""count(*) AS total, count(CASE WHEN status = 'completed' THEN 1 END) AS successful, count(CASE WHEN status = 'failed' THEN 1 END) AS failed, round(avg(response_ms), 6) AS avg_response, round(avg({NUM} / 128), 6) AS avg_confidence, round(avg({NUM} / 64), 6) AS avg_relevance,
    round(avg(CASE WHEN id % 7 > 0 THEN {NUM} / 8 END), 6) AS avg_query_processing, round(avg(CASE WHEN id % 7 > 0 THEN {NUM} / 4 END), 6) AS avg_retrieval, round(avg(CASE WHEN id % 7 > 0 AND id % 11 > 0 THEN {NUM} / 2 END), 6) AS avg_generation"""


@query("query_analytics", f"WITH {QUERY_RUNS} SELECT CAST(date_trunc('day', ts) AS DATE) AS day, {LOG} FROM query_runs GROUP BY 1")
def query_analytics(spark, sf_dir):
    return logged(spark, sf_dir).groupBy(F.col("ts").cast("date").alias("day")).agg(*log_metrics())


@query("day_bucket", f"WITH {QUERY_RUNS} SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM query_runs GROUP BY ALL")
def day_bucket(spark, sf_dir):
    return query_runs(spark, sf_dir).groupBy(F.date_trunc("day", "ts").cast("date").alias("day"), "event_type").agg(F.count("*").alias("n"))


RECENT = "ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 72 HOUR"


def since(runs, moment: str, hours: int):
    """Runs of the last hours before a moment."""
    return runs.where(F.col("ts") >= F.lit(moment).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours)))


@query("recent_query_performance", f"WITH {QUERY_RUNS} SELECT {LOG}, CASE WHEN count(*) > 0 THEN round(count(CASE WHEN status = 'completed' THEN 1 END) * 100.0 / count(*), 6) ELSE 0 END AS success_rate FROM query_runs WHERE {RECENT}")
def recent_query_performance(spark, sf_dir, moment: str = "2024-01-20 00:00:00", hours: int = 72):
    """Over the last hours before a given moment."""
    rate = F.coalesce(F.try_divide(F.col("successful") * 100.0, F.col("total")), F.lit(0.0))
    return since(logged(spark, sf_dir), moment, hours).agg(*log_metrics()).withColumn("success_rate", F.round(rate, 6))


@query("hours_back", f"WITH {QUERY_RUNS} SELECT id, ts FROM query_runs WHERE {RECENT}")
def hours_back(spark, sf_dir, moment: str = "2024-01-20 00:00:00", hours: int = 72):
    return since(query_runs(spark, sf_dir), moment, hours).select("id", "ts")


@query("json_path_float", f"WITH {QUERY_RUNS} SELECT id, {NUM} AS k FROM query_runs")
def json_path_float(spark, sf_dir):
    return query_runs(spark, sf_dir).select("id", F.get_json_object("meta", "$.k").try_cast("double").alias("k"))


@query("pipeline_metrics", f"""WITH {QUERY_RUNS}, newest AS (SELECT *, row_number() OVER (ORDER BY ts DESC, id) AS place FROM query_runs ORDER BY ts DESC, id LIMIT 100)
    SELECT count(*) AS total, CAST(floor(avg(response_ms)) AS BIGINT) AS avg_response, round(count(CASE WHEN status = 'completed' THEN 1 END) / count(*), 6) AS success_rate, string_agg(CASE WHEN place <= 10 THEN substr(event_type || ' by ' || user_id || ': ' || meta, 1, 50) END, ' | ' ORDER BY place) AS previews FROM newest""")
def pipeline_metrics(spark, sf_dir):
    """Of the newest hundred runs, with previews of the first ten."""
    newest = query_runs(spark, sf_dir).orderBy(F.desc("ts"), "id").limit(100)
    place = F.row_number().over(Window.orderBy(F.desc("ts"), "id"))  # a hundred rows
    newest = newest.withColumn("place", place).withColumn("shown", F.substring(F.concat("event_type", F.lit(" by "), F.col("user_id").cast("string"), F.lit(": "), "meta"), 1, 50))
    done = F.count(F.when(F.col("status") == "completed", 1))
    previews = F.transform(F.sort_array(F.collect_list(F.when(F.col("place") <= 10, F.struct("place", "shown")))), lambda x: x["shown"])
    return newest.agg(F.count("*").alias("total"), F.floor(F.avg("response_ms")).alias("avg_response"), F.round(done / F.count("*"), 6).alias("success_rate"), F.array_join(previews, " | ").alias("previews"))


@query("storage_usage_stats", f"WITH {OWNED} SELECT upload_type, count(*) AS files, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS bytes, round(coalesce(avg(n_chars), 0), 6) AS avg_bytes FROM owned GROUP BY 1")
def storage_usage_stats(spark, sf_dir):
    return owned_documents(spark, sf_dir).groupBy("upload_type").agg(F.count("*").alias("files"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("bytes"), F.round(F.coalesce(F.avg("n_chars"), F.lit(0.0)), 6).alias("avg_bytes"))


@query("storage_usage_run", f"WITH {OWNED} SELECT project_id, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, round(sum(n_chars) / 1048576.0, 6) AS mb FROM owned GROUP BY 1")
def storage_usage_run(spark, sf_dir):
    return owned_documents(spark, sf_dir).groupBy("project_id").agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"), F.round(F.sum("n_chars") / 1048576.0, 6).alias("mb"))


@query("list_wiki_pages", f"WITH {OWNED}, f AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'wiki_metadata.json' WHEN doc_id % 4 < 3 THEN 'page_' || doc_id || '.md' ELSE filename END AS name FROM owned) SELECT doc_id, name FROM f WHERE name LIKE '%.md' OR name = 'wiki_metadata.json'")
def list_wiki_pages(spark, sf_dir):
    k = F.col("doc_id") % 4
    name = F.when(k == 0, "wiki_metadata.json").when(k < 3, F.concat(F.lit("page_"), F.col("doc_id"), F.lit(".md"))).otherwise(F.col("filename"))
    return owned_documents(spark, sf_dir).select("doc_id", name.alias("name")).where(F.col("name").endswith(".md") | (F.col("name") == "wiki_metadata.json"))


@query("run_progress", """SELECT l_orderkey AS run_id, CAST(count(*) AS BIGINT) AS steps, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS completed,
    round(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS percentage, CASE WHEN bool_and(l_linestatus = 'F') THEN 'completed' ELSE 'running' END AS status FROM lineitem GROUP BY 1""")
def run_progress(spark, sf_dir):
    done = F.count_if(F.col("l_linestatus") == "F")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(
        F.count("*").alias("steps"), done.alias("completed"), F.round(done * 100.0 / F.count("*"), 6).alias("percentage"),
        F.when(F.bool_and(F.col("l_linestatus") == "F"), "completed").otherwise("running").alias("status"),
    )


@query("run_summary", """SELECT l_orderkey AS run_id, sum(l_quantity) AS pages, round(sum(l_extendedprice), 4) AS chunks, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS names FROM lineitem GROUP BY 1""")
def run_summary(spark, sf_dir):
    names = F.array_join(F.transform(F.sort_array(F.collect_list("l_partkey")), lambda x: x.cast("string")), ",")  # the documents of one run
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.sum("l_quantity").alias("pages"), F.round(F.sum("l_extendedprice"), 4).alias("chunks"), names.alias("names"))


CHUNK_STATS = f"""count(*) AS n, round(avg(len({WORDS})), 6) AS avg_words, round(avg(length(text)), 6) AS avg_chars, CAST(count(CASE WHEN length(text) < 500 THEN 1 END) AS BIGINT) AS small, CAST(count(CASE WHEN length(text) BETWEEN 500 AND 999 THEN 1 END) AS BIGINT) AS medium,
    CAST(count(CASE WHEN length(text) >= 1000 THEN 1 END) AS BIGINT) AS large, CAST(count(CASE WHEN length(text) < 150 THEN 1 END) AS BIGINT) AS very_small, CAST(count(CASE WHEN length(text) > 750 THEN 1 END) AS BIGINT) AS very_large,
    CAST(min(length(text)) AS BIGINT) AS shortest, CAST(max(length(text)) AS BIGINT) AS longest"""


@query("chunk_analysis", f"WITH {ELEMENTS} SELECT category, {CHUNK_STATS} FROM elements GROUP BY 1")
def chunk_analysis(spark, sf_dir):
    n = F.length("text").cast("long")
    return elements(spark, sf_dir).groupBy("category").agg(
        F.count("*").alias("n"), F.round(F.avg(caption_word_count(F.col("text"))), 6).alias("avg_words"), F.round(F.avg(n), 6).alias("avg_chars"), F.count_if(n < 500).alias("small"), F.count_if(n.between(500, 999)).alias("medium"), F.count_if(n >= 1000).alias("large"),
        F.count_if(n < 150).alias("very_small"), F.count_if(n > 750).alias("very_large"), F.min(n).alias("shortest"), F.max(n).alias("longest"),
    )


@query("chunk_sections", f"""WITH {ELEMENTS}, p AS (SELECT *, CASE WHEN category = 'UncategorizedText' THEN 1 ELSE 0 END AS phase FROM elements), m AS (SELECT *, CASE WHEN {MAJOR} THEN {TITLE_SQL} END AS major, CASE WHEN phase = 1 THEN 0 ELSE page END AS place FROM p),
    s AS (SELECT coalesce(last_value(major IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY phase, seq ROWS UNBOUNDED PRECEDING), last_value(major IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY phase, place, seq ROWS UNBOUNDED PRECEDING), 'Unknown Section') AS section FROM m)
    SELECT section, count(*) AS n FROM s GROUP BY 1""")
def chunk_sections(spark, sf_dir):
    """How many elements inherit each section."""
    e = elements(spark, sf_dir).withColumn("phase", F.when(F.col("category") == "UncategorizedText", 1).otherwise(0))
    s = inherit_sections(e, large_documents(spark, sf_dir)).select(F.coalesce("section", F.lit("Unknown Section")).alias("section"))
    return s.groupBy("section").agg(F.count("*").alias("n"))


@query("chunk_examples", f"WITH {ELEMENTS} SELECT category, doc_id, seq, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id, seq) AS n FROM elements) WHERE n <= 2")
def chunk_examples(spark, sf_dir):
    """Two examples of each category: the first of each hash bucket, then of those."""
    e, first = elements(spark, sf_dir), lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("doc_id", "seq"))
    few = e.withColumn("part", F.pmod(F.xxhash64("doc_id", "seq"), F.lit(64))).withColumn("n", first("category", "part")).where("n <= 2")
    return few.withColumn("n", first("category")).where("n <= 2").select("category", "doc_id", "seq", preview(F.col("text"), 200).alias("preview"))


@query("shortest_longest_3", f"""WITH {ELEMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY length(text), doc_id, seq) AS up, row_number() OVER (PARTITION BY category ORDER BY length(text) DESC, doc_id DESC, seq DESC) AS down FROM elements)
    SELECT category, doc_id, seq, up <= 3 AS is_short FROM r WHERE up <= 3 OR down <= 3""")
def shortest_longest_3(spark, sf_dir):
    """Three of each end: first of each hash bucket of a category, then of the few that remain."""
    e = elements(spark, sf_dir).select("category", F.struct(F.length("text").alias("n"), "doc_id", "seq").alias("k"))
    small = Window.partitionBy("category", "bucket").orderBy("k")
    large = Window.partitionBy("category", "bucket").orderBy(F.desc("k"))
    local = e.withColumn("bucket", F.pmod(F.xxhash64("k.doc_id"), F.lit(64)))
    local = local.withColumn("u", F.row_number().over(small)).withColumn("d", F.row_number().over(large)).where("u <= 3 OR d <= 3")  # six of each bucket
    few = local.withColumn("up", F.row_number().over(Window.partitionBy("category").orderBy("k"))).withColumn("down", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("k"))))
    return few.where("up <= 3 OR down <= 3").select("category", "k.doc_id", "k.seq", (F.col("up") <= 3).alias("is_short"))


@query("chunk_validation", f"WITH {CHUNKS} SELECT run_id, count(*) AS n, CAST(count(CASE WHEN content IS NULL OR trim(content) = '' THEN 1 END) AS BIGINT) AS empty, CAST(count(CASE WHEN doc_id % 5 = 0 THEN 1 END) AS BIGINT) AS no_page FROM chunks GROUP BY 1")
def chunk_validation(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return c.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("content").isNull() | (F.trim("content") == "")).alias("empty"), F.count_if(F.col("doc_id") % 5 == 0).alias("no_page"))


@query("category_distribution", f"WITH {ELEMENTS} SELECT category, count(*) AS n FROM elements GROUP BY 1")
def category_distribution(spark, sf_dir):
    return elements(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


@query("section_header_distribution", f"WITH {ELEMENTS} SELECT text AS section, count(*) AS n FROM elements WHERE category = 'Title' GROUP BY 1 ORDER BY n DESC, section LIMIT 10")
def section_header_distribution(spark, sf_dir):
    return elements(spark, sf_dir).where("category = 'Title'").groupBy(F.col("text").alias("section")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "section").limit(10)


@query("metadata_summary", f"""WITH {ELEMENTS} SELECT page % 3 AS kind, count(*) AS n, CAST(count(CASE WHEN {HAS_NUMBERS} THEN 1 END) AS BIGINT) AS with_numbers, CAST(count(CASE WHEN category = 'Title' THEN 1 END) AS BIGINT) AS with_sections,
    CAST(count(CASE WHEN c = 'simple' THEN 1 END) AS BIGINT) AS simple, CAST(count(CASE WHEN c = 'medium' THEN 1 END) AS BIGINT) AS medium, CAST(count(CASE WHEN c = 'complex' THEN 1 END) AS BIGINT) AS complex FROM (SELECT *, {COMPLEXITY} AS c FROM elements) GROUP BY 1""")
def metadata_summary(spark, sf_dir):
    """With numbers, with section titles, and how many of each complexity."""
    e = elements(spark, sf_dir).withColumn("c", text_complexity(F.col("text")))
    return e.groupBy((F.col("page") % 3).alias("kind")).agg(F.count("*").alias("n"), F.count_if(has_numbers(F.col("text"))).alias("with_numbers"), F.count_if(F.col("category") == "Title").alias("with_sections"), *[F.count_if(F.col("c") == x).alias(x) for x in ("simple", "medium", "complex")])


@query("embedding_quality", """WITH x AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings), n AS (SELECT vec_id, label, sqrt(sum(v * v)) AS norm FROM x GROUP BY ALL),
    g AS (SELECT label, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS low, round(max(v), 6) AS high FROM x GROUP BY 1),
    z AS (SELECT label, CAST(count(CASE WHEN norm = 0 THEN 1 END) AS BIGINT) AS zeros, round(avg(norm), 6) AS norm_mean, round(stddev_pop(norm), 6) AS norm_std FROM n GROUP BY 1),
    d AS (SELECT label, count(*) - count(DISTINCT embedding) AS duplicates FROM embeddings GROUP BY 1),
    f AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
    two AS (SELECT a.label, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS first_two FROM f a JOIN f b ON a.label = b.label AND a.k = 1 AND b.k = 2)
    SELECT *, round(CASE WHEN zeros = 0 THEN 0.3 ELSE 0 END + CASE WHEN duplicates = 0 THEN 0.3 ELSE 0 END + CASE WHEN norm_mean > 0.9 THEN 0.2 ELSE 0 END + CASE WHEN std > 0.01 THEN 0.2 ELSE 0 END, 6) AS score FROM g JOIN z USING (label) JOIN d USING (label) LEFT JOIN two USING (label)""")
def embedding_quality(spark, sf_dir):
    """Per run, with the similarity of its first two vectors. The moments come from sums per vector, so no value is exploded; copies are told by 128 bits."""
    e = table(spark, sf_dir, "embeddings")
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    s = e.select("label", F.struct(F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding")).alias("h"), norm(F.col("embedding")).alias("norm"), F.size("embedding").alias("n"), F.aggregate(doubles, F.lit(0.0), lambda a, x: a + x).alias("s"), F.array_min(doubles).alias("lo"), F.array_max(doubles).alias("hi"))
    g = s.groupBy("label").agg(
        (F.sum("s") / F.sum("n")).alias("m"), (F.sum(F.col("norm") * F.col("norm")) / F.sum("n")).alias("m2"), F.round(F.min("lo"), 6).alias("low"), F.round(F.max("hi"), 6).alias("high"),
        F.count_if(F.col("norm") == 0).alias("zeros"), F.round(F.avg("norm"), 6).alias("norm_mean"), F.round(F.stddev_pop("norm"), 6).alias("norm_std"), (F.count("*") - F.count_distinct("h")).alias("duplicates"),
    )
    g = g.withColumn("std", F.round(F.sqrt(F.col("m2") - F.col("m") * F.col("m")), 6)).withColumn("mean", F.round("m", 6)).drop("m", "m2")
    point = lambda ok, p: F.when(ok, p).otherwise(0.0)
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))
    few = e.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("k", first("label", "part")).where("k <= 2").withColumn("k", first("label")).where("k <= 2")
    two = few.groupBy("label").agg(F.max_by("embedding", F.when(F.col("k") == 1, 1)).alias("a"), F.max_by("embedding", F.when(F.col("k") == 2, 1)).alias("b"))
    g = g.join(two.select("label", F.when(F.col("b").isNotNull(), F.round(cosine(F.col("a"), F.col("b")), 6)).alias("first_two")), "label", "left")
    return g.withColumn("score", F.round(point(F.col("zeros") == 0, 0.3) + point(F.col("duplicates") == 0, 0.3) + point(F.col("norm_mean") > 0.9, 0.2) + point(F.col("std") > 0.01, 0.2), 6))


@query("embedding_success_rate", "SELECT label AS run_id, count(*) AS total, CAST(count(CASE WHEN vec_id % 6 > 0 THEN 1 END) AS BIGINT) AS embedded, CASE WHEN count(CASE WHEN vec_id % 6 > 0 THEN 1 END) / count(*) >= 0.8 THEN 'completed' ELSE 'failed' END AS status FROM embeddings GROUP BY 1")
def embedding_success_rate(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("run_id")).agg(F.count("*").alias("total"), F.count_if(F.col("vec_id") % 6 > 0).alias("embedded"))
    return e.withColumn("status", F.when(F.col("embedded") / F.col("total") >= 0.8, "completed").otherwise("failed"))


@query("index_verification", "SELECT label AS run_id, count(embedding) AS n, CASE WHEN count(embedding) > 0 THEN 'verified' ELSE 'failed' END AS status FROM embeddings GROUP BY 1")
def index_verification(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("run_id")).agg(F.count("embedding").alias("n"))
    return e.withColumn("status", F.when(F.col("n") > 0, "verified").otherwise("failed"))


@query("enrichment_summary", f"""WITH {ELEMENTS}, p AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY seq) AS text FROM elements WHERE category = 'Title' GROUP BY ALL)
    SELECT doc_id, CAST(coalesce(t.tables, 0) AS BIGINT) AS tables, CAST(coalesce(i.images, 0) AS BIGINT) AS images, CAST(coalesce(t.words, 0) + coalesce(i.words, 0) AS BIGINT) AS words
    FROM (SELECT doc_id, count(*) AS tables, sum(len({WORDS})) AS words FROM elements WHERE category = 'UncategorizedText' GROUP BY 1) t FULL JOIN (SELECT doc_id, count(*) AS images, sum(len({WORDS})) AS words FROM p GROUP BY 1) i USING (doc_id)""")
def enrichment_summary(spark, sf_dir):
    """Captioned tables and page images of each document, and the words of their captions; the headings of a page stand for the caption of its image."""
    e = elements(spark, sf_dir)
    words = lambda rows, name: rows.groupBy("doc_id").agg(F.count("*").alias(name), F.sum(caption_word_count(F.col("text"))).alias(f"{name}_words"))
    heads = e.where("category = 'Title'").groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n").alias("text"))
    both = words(e.where("category = 'UncategorizedText'"), "tables").join(words(heads, "images"), "doc_id", "full")
    none = lambda c: F.coalesce(c, F.lit(0))
    return both.select("doc_id", none("tables").alias("tables"), none("images").alias("images"), (none("tables_words") + none("images_words")).alias("words"))


@query("wiki_metadata_summary", f"WITH {CHUNKS}, {OWNED} SELECT o.project_id, count(DISTINCT c.doc_id) AS documents, count(*) AS chunks, CAST(sum(coalesce(o.n_chars, 0)) AS BIGINT) AS chars FROM chunks c JOIN owned o USING (doc_id) GROUP BY 1")
def wiki_metadata_summary(spark, sf_dir):
    met = chunks(spark, sf_dir).join(owned_documents(spark, sf_dir).select("doc_id", "project_id", "n_chars"), "doc_id")
    return met.groupBy("project_id").agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("chars"))


@query("validation_batch", f"""WITH {OWNED} SELECT project_id, bool_and(n_chars < 10000) AS is_valid, CAST(sum(n_chars // 500) AS BIGINT) AS pages, round(sum(n_chars // 500) * 6.0 / 60, 6) AS minutes, CAST(count(CASE WHEN n_chars >= 10000 THEN 1 END) AS BIGINT) AS errors FROM owned GROUP BY 1""")
def validation_batch(spark, sf_dir):
    """A batch as a whole; its errors are counted here and listed by validation_errors, a row each."""
    pages = F.floor(F.col("n_chars") / 500)
    return owned_documents(spark, sf_dir).groupBy("project_id").agg(F.bool_and(F.col("n_chars") < 10000).alias("is_valid"), F.sum(pages).alias("pages"), F.round(F.sum(pages) * 6.0 / 60, 6).alias("minutes"), F.count_if(F.col("n_chars") >= 10000).alias("errors"))


@query("validation_errors", f"WITH {OWNED} SELECT project_id, doc_id, filename || ': too long' AS error FROM owned WHERE n_chars >= 10000")
def validation_errors(spark, sf_dir):
    return owned_documents(spark, sf_dir).where("n_chars >= 10000").select("project_id", "doc_id", F.concat("filename", F.lit(": too long")).alias("error"))


@query("run_timings", """WITH t AS (SELECT user_id AS run_id, event_type AS step, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS micros FROM events GROUP BY ALL)
    SELECT run_id, string_agg(step || '=' || micros, ',' ORDER BY step) AS steps, CAST(sum(micros) AS BIGINT) AS total_micros, max(micros) AS slowest_micros, round(sum(micros) / 1e6, 6) AS total_time FROM t GROUP BY 1""")
def run_timings(spark, sf_dir):
    """Microseconds by step of each run as a map, their sum and the slowest; the log is summed by step, as whole numbers in any order, before it meets by run."""
    micros = F.sum(F.round(F.col("value") * 1000).cast("long")).alias("micros")
    t = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("step")).agg(micros)
    total = F.sum("micros")
    g = t.groupBy("run_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("step", "micros")))).alias("steps"), total.alias("total_micros"), F.max("micros").alias("slowest_micros"), F.round(total / 1e6, 6).alias("total_time"))
    shown = F.transform(F.map_entries("steps"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return g.withColumn("steps", F.array_join(shown, ","))


STATUS = "CASE WHEN quality = 1 AND toxic = 0 THEN 'found' WHEN quality = 1 THEN 'risk' WHEN toxic = 1 THEN 'conditions' ELSE 'missing' END"


def checklist_status():
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return F.when(good & ~toxic, "found").when(good, "risk").when(toxic, "conditions").otherwise("missing")


@query("status_counts", f"SELECT {STATUS} AS status, count(*) AS n FROM labels GROUP BY 1")
def status_counts(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy(checklist_status().alias("status")).agg(F.count("*").alias("n"))


@query("result_clean", f"""WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN upper({STATUS}) WHEN 1 THEN 'unknown' ELSE {STATUS} END AS status, CASE doc_id % 3 WHEN 0 THEN '1.7' WHEN 1 THEN 'x' ELSE '-0.5' END AS score, CASE doc_id % 2 WHEN 0 THEN 'NONE' ELSE 'p' || doc_id END AS excerpt, CASE doc_id % 5 WHEN 0 THEN 'x' ELSE CAST(doc_id AS VARCHAR) END AS page FROM labels)
    SELECT doc_id, CASE WHEN lower(status) IN ('found', 'missing', 'risk', 'conditions', 'pending_clarification') THEN lower(status) ELSE 'missing' END AS status, least(1.0, greatest(0.0, TRY_CAST(score AS DOUBLE))) AS score,
        CASE WHEN lower(excerpt) IN ('null', 'none', '') THEN NULL ELSE excerpt END AS excerpt, TRY_CAST(page AS INT) AS page FROM r""".replace("least(1.0, greatest(0.0, TRY_CAST(score AS DOUBLE)))", "CASE WHEN TRY_CAST(score AS DOUBLE) IS NULL THEN NULL ELSE least(1.0, greatest(0.0, TRY_CAST(score AS DOUBLE))) END"))
def result_clean(spark, sf_dir):
    from docquill.operators.checklist import clean_results

    d = F.col("doc_id")
    raw = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(d % 4 == 0, F.upper(checklist_status())).when(d % 4 == 1, "unknown").otherwise(checklist_status()).alias("status"), F.when(d % 3 == 0, "1.7").when(d % 3 == 1, "x").otherwise("-0.5").alias("score"),
        F.when(d % 2 == 0, "NONE").otherwise(F.concat(F.lit("p"), d)).alias("excerpt"), F.when(d % 5 == 0, "x").otherwise(d.cast("string")).alias("page"),
    )
    return clean_results(raw)


@query("fallback_results", "SELECT item_id AS item_number, substr(text, 1, 20) AS item_name, 'pending_clarification' AS status, 'failed' AS description, 0.0::DOUBLE AS confidence FROM benchmark")
def fallback_results(spark, sf_dir):
    from docquill.operators.checklist import fallback

    return fallback(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item_number"), F.substring("text", 1, 20).alias("item_name")), "failed")


@query("primary_source", "SELECT l_orderkey AS run_id, min_by(l_partkey, struct_pack(a := l_linenumber, b := l_partkey)) AS source_document, min_by(l_suppkey, struct_pack(a := l_linenumber, b := l_partkey, c := l_suppkey)) AS source_page FROM lineitem GROUP BY 1")
def primary_source(spark, sf_dir):
    """The first of each result's sources."""
    first = F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(first.alias("s")).select("run_id", F.col("s.l_partkey").alias("source_document"), F.col("s.l_suppkey").alias("source_page"))


@query("sources_by_document", """WITH p AS (SELECT l_partkey AS doc_id, list_sort(list(DISTINCT l_suppkey)) AS pages FROM lineitem GROUP BY 1)
    SELECT doc_id, array_to_string(pages[1:3], ', ') || CASE WHEN len(pages) > 3 THEN ' and ' || (len(pages) - 3) || ' more' ELSE '' END AS pages FROM p""")
def sources_by_document(spark, sf_dir):
    from docquill.operators.checklist import pages_label

    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("doc_id")).agg(F.sort_array(F.collect_set("l_suppkey")).alias("pages"))
    return p.select("doc_id", pages_label(F.col("pages")).alias("pages"))


@query("total_page_size", "SELECT o_custkey AS run_id, round(sum(coalesce(o_totalprice, 0)), 4) AS bytes FROM orders GROUP BY 1")
def total_page_size(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.round(F.sum(F.coalesce("o_totalprice", F.lit(0.0))), 4).alias("bytes"))


@query("resource_peaks", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, max(value) AS peak FROM events GROUP BY 1")
def resource_peaks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.max("value").alias("peak"))


# page and document checks


PAGES = """pages_of AS (SELECT o_orderkey AS page_id, CAST(o_orderkey % 20 AS INT) AS images, CAST(o_custkey % 4 AS INT) AS meaningful, CAST(o_custkey % 3 AS INT) AS tables, CAST(o_orderkey % 7 * 1000 AS INT) AS items, CAST(o_orderkey % 15 AS INT) AS blocks, CAST(o_totalprice / 40 AS BIGINT) AS chars, o_custkey FROM orders)"""


def pages_of(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("page_id"), (k % 20).cast("int").alias("images"), (c % 4).cast("int").alias("meaningful"), (c % 3).cast("int").alias("tables"), (k % 7 * 1000).cast("int").alias("items"),
        (k % 15).cast("int").alias("blocks"), F.rint(F.col("o_totalprice") / 40).cast("long").alias("chars"), "o_custkey",
    )


COMPLEXITY = "CASE WHEN meaningful >= 2 THEN 'images' WHEN items >= 4000 THEN 'vector_drawing' WHEN tables > 0 THEN 'tables' WHEN images >= 15 AND meaningful = 0 AND tables = 0 THEN 'diagram' ELSE 'text_only' END"


@query("page_complexity", f"WITH {PAGES} SELECT page_id, {COMPLEXITY} AS complexity, images > 10 AND blocks >= 3 AS fragmented FROM pages_of")
def page_complexity(spark, sf_dir):
    c = lambda n: F.col(n)
    return pages_of(spark, sf_dir).select("page_id", V.page_complexity(c("meaningful"), c("items"), c("tables"), c("images")).alias("complexity"), V.is_fragmented(c("images"), c("blocks")).alias("fragmented"))


@query("scan_full_pages", f"WITH {PAGES}, z AS (SELECT page_id, CASE WHEN images > 10 AND blocks >= 3 THEN 3.0 WHEN items >= 4000 THEN 2.0 ELSE 1.5 END AS zoom FROM pages_of WHERE images > 0) SELECT page_id, zoom::DOUBLE AS zoom, CAST(floor(zoom * 72) AS INT) AS dpi FROM z")
def scan_full_pages(spark, sf_dir):
    zoom = V.extraction_zoom(V.is_fragmented(F.col("images"), F.col("blocks")), F.when(F.col("items") >= 4000, "complex").otherwise("simple"))
    return pages_of(spark, sf_dir).where("images > 0").select("page_id", zoom.alias("zoom"), F.floor(zoom * 72).cast("int").alias("dpi"))


@query("drawing_page", f"WITH {PAGES} SELECT page_id, (images > 3 AND blocks < 10) OR (items >= 5000 AND images > 0) AS drawing FROM pages_of")
def drawing_page(spark, sf_dir):
    complexity = F.when(F.col("items") >= 5000, "complex").otherwise("simple")
    return pages_of(spark, sf_dir).select("page_id", V.is_drawing_page(F.col("images"), F.col("blocks"), complexity).alias("drawing"))


@query("table_validation", f"""WITH {PAGES}, v AS (SELECT page_id, chars > 5000 AS a, images > 20 OR blocks > 12 AS b, items / 6000.0 > 0.7 AS c, images > 3 AND blocks < 10 AS d FROM pages_of)
    SELECT page_id, round(CASE WHEN a THEN 0.3 ELSE 1 END * CASE WHEN b THEN 0.4 ELSE 1 END * CASE WHEN c THEN 0.2 ELSE 1 END * CASE WHEN d THEN 0.3 ELSE 1 END, 6)::DOUBLE AS confidence, NOT (a OR b OR c OR d) AS is_valid FROM v""")
def table_validation(spark, sf_dir):
    a = [F.col("chars"), F.when((F.col("images") > 20) | (F.col("blocks") > 12), 21).otherwise(1), F.col("items") / 6000.0, (F.col("images") > 3) & (F.col("blocks") < 10)]
    return pages_of(spark, sf_dir).select("page_id", F.round(V.table_confidence(*a), 6).alias("confidence"), V.table_is_valid(*a).alias("is_valid"))


@query("meaningful_images", "SELECT l_orderkey AS page_id, CAST(count(CASE WHEN l_quantity * 10 >= 150 AND l_partkey % 300 >= 100 AND l_quantity * 10 * (l_partkey % 300) >= 25000 THEN 1 END) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def meaningful_images(spark, sf_dir):
    ok = V.is_meaningful_image(F.col("l_quantity") * 10, F.col("l_partkey") % 300)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.count_if(ok).alias("n"))


@query("scanned_doc", f"""WITH {ELEMENTS}, p AS (SELECT doc_id, page, sum(length(text)) AS chars FROM elements WHERE page <= 3 GROUP BY ALL), d AS (SELECT doc_id, avg(chars) AS m FROM p GROUP BY 1)
    SELECT doc_id, m < 25 AS scanned, round(CASE WHEN m < 25 THEN greatest(0.7, 1 - m / 25) ELSE least(0.9, m / 250) END, 6) AS confidence FROM d""")
def scanned_doc(spark, sf_dir):
    p = elements(spark, sf_dir).where("page <= 3").groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("chars"))
    m = p.groupBy("doc_id").agg(F.avg("chars").alias("m"))
    return m.select("doc_id", V.is_scanned(F.col("m")).alias("scanned"), F.round(V.scanned_confidence(F.col("m")), 6).alias("confidence"))


@query("doc_characteristics", f"""WITH {ELEMENTS}, p AS (SELECT doc_id, page, sum(length(text)) AS chars, CAST(count(CASE WHEN category = 'UncategorizedText' THEN 1 END) AS BIGINT) AS images FROM elements GROUP BY ALL)
    SELECT doc_id, count(*) AS pages, round(count(CASE WHEN chars > 50 THEN 1 END) * 100.0 / count(*), 6) AS text_percentage, CASE WHEN avg(chars) > 1000 THEN 'high' WHEN avg(chars) > 200 THEN 'medium' ELSE 'low' END AS density,
        CASE WHEN sum(images) > 3 * count(*) THEN 'high' WHEN sum(images) > count(*) THEN 'medium' ELSE 'low' END AS image_density FROM p GROUP BY 1""")
def doc_characteristics(spark, sf_dir):
    p = elements(spark, sf_dir).groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("chars"), F.count_if(F.col("category") == "UncategorizedText").alias("images"))
    level = lambda x, high, low: F.when(x > high, "high").when(x > low, "medium").otherwise("low")
    n = F.count("*")
    return p.groupBy("doc_id").agg(n.alias("pages"), F.round(F.count_if(F.col("chars") > 50) * 100.0 / n, 6).alias("text_percentage"), level(F.avg("chars"), 1000, 200).alias("density"), level(F.sum("images"), 3 * n, n).alias("image_density"))


@query("doc_type", f"""WITH {PAGES} SELECT page_id, CASE WHEN chars % 100 < 10 THEN 'image_heavy_scan' WHEN chars % 100 > 80 AND images < blocks THEN 'text_heavy' WHEN images > blocks * 2 THEN 'diagram_heavy' WHEN chars % 100 > 50 THEN 'mixed_content' ELSE 'low_text_content' END AS kind FROM pages_of""")
def doc_type(spark, sf_dir):
    return pages_of(spark, sf_dir).select("page_id", V.document_kind(F.col("chars") % 100, F.col("images"), F.col("blocks")).alias("kind"))


@query("partition_strategy", f"""WITH {PAGES} SELECT page_id, CASE WHEN tables = 2 THEN 'explicit' WHEN chars % 250 < 25 THEN CASE WHEN images > 0 THEN 'hybrid_ocr_images' ELSE 'pymupdf_fallback' END ELSE 'pymupdf_only' END AS strategy FROM pages_of""")
def partition_strategy(spark, sf_dir):
    """An explicit strategy wins; scans go to OCR, with a fallback; anything else is read as text."""
    ocr = F.when(F.col("images") > 0, "hybrid_ocr_images").otherwise("pymupdf_fallback")
    return pages_of(spark, sf_dir).select("page_id", F.when(F.col("tables") == 2, "explicit").when(V.is_scanned(F.col("chars") % 250), ocr).otherwise("pymupdf_only").alias("strategy"))


@query("sample_size", f"WITH {PAGES} SELECT page_id, CAST(CASE WHEN n <= 10 THEN n WHEN n <= 50 THEN 5 ELSE least(10, greatest(5, n // 10)) END AS INT) AS sample FROM (SELECT page_id, CAST(chars % 150 AS INT) AS n FROM pages_of)")
def sample_size(spark, sf_dir):
    return pages_of(spark, sf_dir).select("page_id", V.sample_pages((F.col("chars") % 150).cast("int")).alias("sample"))


@query("processing_estimate", f"""WITH {PAGES}, w AS (SELECT page_id, blocks + images + tables AS pages, (blocks - floor(blocks * 3 / 10.0)) * 1.5 + images * 6.0 + (tables + floor(blocks * 3 / 10.0)) * 8.0 AS work FROM pages_of)
    SELECT page_id, CAST(greatest(30, (floor((work + 20 + pages * 0.5 + work * 0.2) / 30) + 1) * 30) AS BIGINT) AS seconds FROM w""")
def processing_estimate(spark, sf_dir):
    pages = F.col("blocks") + F.col("images") + F.col("tables")
    return pages_of(spark, sf_dir).select("page_id", V.processing_seconds(pages, F.col("blocks"), F.col("images"), F.col("tables")).alias("seconds"))


@query("retry_delay", f"WITH {PAGES} SELECT page_id, CAST(CASE tables WHEN 0 THEN least(300, 30 * 2 ** meaningful) WHEN 1 THEN least(60, 5 * 2 ** meaningful) ELSE least(30, 2 ** (meaningful + 3)) END AS BIGINT) AS delay FROM pages_of")
def retry_delay(spark, sf_dir):
    kind = F.when(F.col("tables") == 0, "rate_limit").when(F.col("tables") == 1, "timeout").otherwise("unknown")
    attempt = F.when(F.col("tables") == 2, F.col("meaningful") + 3).otherwise(F.col("meaningful"))
    return pages_of(spark, sf_dir).select("page_id", V.retry_delay(kind, attempt).alias("delay"))


@query("error_category", """SELECT event_id, CASE WHEN event_id % 600 = 429 THEN 'rate_limit' WHEN event_id % 600 BETWEEN 500 AND 599 THEN 'server_error' WHEN event_id % 600 >= 400 THEN 'http_error' WHEN event_type = 'error' THEN 'rate_limit' WHEN event_type = 'view' THEN 'timeout' ELSE 'unknown' END AS category FROM events""")
def error_category(spark, sf_dir):
    message = F.when(F.col("event_type") == "error", "Limit reached").when(F.col("event_type") == "view", "read TIMEOUT").otherwise(F.lit("no"))
    return table(spark, sf_dir, "events").select("event_id", V.error_category(F.col("event_id") % 600, message).alias("category"))


SECTIONED = f"t AS (SELECT doc_id, seq, CASE WHEN seq % 5 = 0 THEN 'Table' WHEN seq % 5 = 1 THEN 'Image' ELSE category END AS c, CASE WHEN seq % 2 = 0 THEN 'see Table ' || text ELSE text END AS t, CASE WHEN seq % 3 > 0 THEN 'Part ' || page ELSE 'Unknown Section' END AS s FROM elements)"


@query("compose_content", f"""WITH {ELEMENTS}, {SECTIONED}, b AS (SELECT *, CASE WHEN c = 'Table' THEN concat('Type: Table', chr(10), chr(10), 'Summary: ', t) WHEN c = 'Image' THEN concat('Type: Image', chr(10), chr(10), 'Summary: ', t)
        WHEN c = 'UncategorizedText' AND regexp_matches(lower(t), 'tabel|table|figur|figure') THEN concat('Type: Reference', chr(10), chr(10), 'Content: ', t) ELSE t END AS content FROM t)
    SELECT doc_id, seq, content, CASE WHEN c IN ('Table', 'Image') OR content <> t THEN concat('Context: ', s, chr(10), chr(10), content) WHEN c IN ('NarrativeText', 'ListItem', 'UncategorizedText') THEN concat('Section: ', s, chr(10), chr(10), CASE WHEN c = 'NarrativeText' AND t = '' THEN '[Empty list]' ELSE content END) ELSE content END AS titled FROM b""")
def compose_content(spark, sf_dir):
    """Contents by category, without and with the section's title."""
    e = elements(spark, sf_dir)
    c = F.when(F.col("seq") % 5 == 0, "Table").when(F.col("seq") % 5 == 1, "Image").otherwise(F.col("category"))
    t = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("see Table "), F.col("text"))).otherwise(F.col("text"))
    section = F.when(F.col("seq") % 3 > 0, F.concat(F.lit("Part "), F.col("page").cast("string")))
    return e.select("doc_id", "seq", composed(c, t).alias("content"), composed(c, t, None, section).alias("titled"))


@query("extract_text_chain", f"""WITH {ELEMENTS} SELECT doc_id, seq, CASE seq % 7 WHEN 0 THEN CASE WHEN text <> '' THEN text ELSE '' END WHEN 1 THEN text WHEN 2 THEN 'original ' || text WHEN 3 THEN CASE WHEN text <> '' THEN text || chr(10) || chr(10) ELSE '' END || category || chr(10) || page WHEN 4 THEN '<p>' || text || '</p>' WHEN 5 THEN '[IMAGE PAGE]' ELSE '' END AS value FROM elements""")
def extract_text_chain(spark, sf_dir):
    """Caption, text, the original's text, narrative with list items, markup, the placeholder, nothing: a different part of the elements is there in turn."""
    at = lambda k, c: F.when(F.col("seq") % 7 == k, c)
    text = F.col("text")
    chain = RC.extracted_text(
        at(0, text), at(1, text), at(2, F.concat(F.lit("original "), text)), at(3, text), at(3, F.array("category", F.col("page").cast("string"))), at(4, F.concat(F.lit("<p>"), text, F.lit("</p>"))), at(5, F.lit("full_page_with_images"))
    )
    return elements(spark, sf_dir).select("doc_id", "seq", chain.alias("value"))
