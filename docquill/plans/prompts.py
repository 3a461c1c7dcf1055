"""Prompts and structured answers, failures of sinks, and the remaining vector and box scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquill.functions import repair
from docquill.functions import vectors as V
from docquill.operators import boxes as B
from docquill.operators import clustering as K
from docquill.operators import elements as E
from docquill.operators import retrieval as R
from docquill.plans.model import CHUNKS, ELEMENTS, chunks, elements, table
from docquill.plans.order import BOX, line_boxes
from docquill.plans.vectors import ONE, SCORED, first_query, vectors_of
from docquill.plans.text import REPETITION
from docquill.registry import query
from docquill.sources import providers as P

CAPTION = "'Describe this ' || {kind} || ' of a document.' || chr(10) || 'Text around it: ' || substr(coalesce({context}, ''), 1, 1500)"


@query("table_caption", f"WITH {ELEMENTS} SELECT doc_id, seq, {CAPTION.format(kind=repr('table'), context='text')} AS prompt FROM elements WHERE category = 'UncategorizedText'")
def table_caption(spark, sf_dir):
    e = elements(spark, sf_dir).where("category = 'UncategorizedText'")
    return e.select("doc_id", "seq", P.caption_prompt(F.lit("table"), F.col("text")).alias("prompt"))


@query("page_caption", f"""WITH {ELEMENTS}, few AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY seq) AS rn FROM elements), c AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY seq) AS context FROM few WHERE rn <= 5 GROUP BY ALL)
    SELECT doc_id, page, {CAPTION.format(kind=repr('page'), context='context')} AS prompt FROM c WHERE page % 2 = 0""")
def page_caption(spark, sf_dir):
    """The first five texts of a page are the context of its picture."""
    e = elements(spark, sf_dir).where("page % 2 = 0")
    c = E.page_context(e.select("doc_id", "page").distinct(), e)
    return c.select("doc_id", "page", P.caption_prompt(F.lit("page"), F.col("context")).alias("prompt"))


@query("cluster_name_prompt", f"WITH {CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY chunk_id) AS n FROM chunks) SELECT run_id AS cluster, 'Cluster ' || run_id || ': ' || substr(string_agg(CASE WHEN n <= 3 THEN substr(coalesce(content, ''), 1, 150) END, ' | ' ORDER BY chunk_id), 1, 800) AS line FROM r GROUP BY 1")
def cluster_name_prompt(spark, sf_dir):
    s = K.cluster_summaries(chunks(spark, sf_dir).withColumnRenamed("run_id", "cluster"))
    return s.select("cluster", F.concat(F.lit("Cluster "), F.col("cluster").cast("string"), F.lit(": "), F.substring("samples", 1, 800)).alias("line"))


ANSWER = "status string, confidence double, sources array<string>"


@query("structured_output", "SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN 'pending_clarification' ELSE role END AS status, CASE WHEN turn % 3 < 2 THEN turn / 8 END AS confidence, CASE WHEN turn % 3 < 2 THEN 2 ELSE 0 END AS n_sources, CASE WHEN turn % 3 < 2 THEN sha256(text) END AS sha FROM conversations")
def structured_output(spark, sf_dir):
    """By a typed schema, else by the repaired answer, else a row to be clarified."""
    obj = F.to_json(F.struct(F.col("role").alias("status"), (F.col("turn") / 8).alias("confidence"), F.array(F.col("text"), F.lit("x")).alias("sources")))
    answer = F.when(F.col("turn") % 3 == 0, obj).when(F.col("turn") % 3 == 1, F.concat(F.lit("It is\n```json\n"), obj, F.lit("\n```"))).otherwise(F.lit("cannot say"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("answer")).withColumn("repaired", repair.object_in("answer"))
    direct = F.from_json(F.when(F.col("answer").startswith("{"), F.col("answer")), ANSWER)
    c = c.withColumn("a", F.coalesce(direct, F.from_json("repaired", ANSWER)))
    sources = F.col("a.sources")
    return c.select("conv_id", "turn", F.coalesce("a.status", F.lit("pending_clarification")).alias("status"), F.col("a.confidence").alias("confidence"), F.greatest(F.coalesce(F.size(sources), F.lit(0)), F.lit(0)).alias("n_sources"), F.sha2(F.get(sources, F.lit(0)).cast("binary"), 256).alias("sha"))


@query("topk_fixed15", f"WITH {CHUNKS}, {ONE}, {SCORED} SELECT chunk_id FROM scored ORDER BY similarity DESC, chunk_id LIMIT 15")
def topk_fixed15(spark, sf_dir):
    return R.nearest(vectors_of(spark, sf_dir), first_query(spark, sf_dir)).select("chunk_id")


@query("cosine_strict", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)::DOUBLE AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_strict(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(b, "vec_id").select("vec_id", F.round(V.cosine_strict(F.col("embedding"), F.col("b")), 6).alias("similarity"))


@query("sink_failed_embeddings", f"WITH {CHUNKS} SELECT chunk_id, CASE WHEN chunk_id % 3 = 1 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN chunk_id % 3 = 1 THEN 'time-out' END AS error FROM chunks")
def sink_failed_embeddings(spark, sf_dir):
    from docquill.sources.tables import fresh_name, read_named, replace_named, with_failures

    c, name = chunks(spark, sf_dir).select("chunk_id", F.lit("pending").alias("status")), fresh_name("failed_embeddings")
    replace_named(with_failures(c, c.where("chunk_id % 3 = 1").select("chunk_id"), "time-out"), name)
    return read_named(spark, name).select("chunk_id", "status", "error")


@query("bbox_area", f"SELECT l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey AS seq, round(({BOX}[3] - {BOX}[1]) * ({BOX}[4] - {BOX}[2]), 6) AS area FROM lineitem")
def bbox_area(spark, sf_dir):
    return line_boxes(spark, sf_dir).select("doc_id", "seq", F.round(B.area(F.col("box")), 6).alias("area"))


TABLES = r"""src AS (SELECT doc_id, list_transform(string_split(replace(text, '<', '('), chr(10)), lambda l: list_transform(string_split(l, ', '), lambda c: trim(regexp_replace(c, '[ \t\r\n]+', ' ', 'g')))) AS rows FROM documents),
    md AS (SELECT doc_id, len(rows) AS n_rows, list_max(list_transform(rows, lambda r: len(r))) AS n_columns, array_to_string(list_concat(['| ' || array_to_string(rows[1], ' | ') || ' |', '| ' || array_to_string(list_transform(rows[1], lambda c: '---'), ' | ') || ' |'], list_transform(rows[2:], lambda r: '| ' || array_to_string(r, ' | ') || ' |')), chr(10)) AS text FROM src)"""


@query("scan_tables", f"""WITH {TABLES}, {REPETITION.replace('FROM documents', 'FROM md')}
    SELECT md.doc_id, 'table_1' AS table_id, md.text, CAST(n_rows AS INT) AS n_rows, CAST(n_columns AS INT) AS n_columns FROM md JOIN scores USING (doc_id) WHERE length(md.text) <= 5000 AND n_columns <= 20 AND value <= 0.7""")
def scan_tables(spark, sf_dir):
    """The lines of documents as the rows of a table in markup, read back as Markdown; what is too large, too wide or too repetitive goes."""
    from docquill.operators.tables import table_elements

    row = lambda line: F.concat(F.lit("<TR class=x><td>"), F.replace(line, F.lit(", "), F.lit("</td>\n<td align='left'>")), F.lit("</td></TR>"))
    rows = F.array_join(F.transform(F.split(F.replace("text", F.lit("<"), F.lit("(")), "\n", -1), row), "\n")
    pages = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("<p>text</p><table border=1>"), rows, F.lit("</table>")).alias("html"))
    return table_elements(pages, "doc_id", "html")


@query("scan_page_meta", r"SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?i)<html[^>]*lang=.([a-z]+)', 1) AS lang, CAST(len(regexp_extract_all(html, '(?i)<img[ >]')) AS BIGINT) AS images FROM pages")
def scan_page_meta(spark, sf_dir):
    """Title, language and pictures: what a document's own metadata holds."""
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", r"(?i)<html[^>]*lang=.([a-z]+)", 1).alias("lang"),
        F.regexp_count("html", F.lit(r"(?i)<img[ >]")).cast("long").alias("images"),
    )
