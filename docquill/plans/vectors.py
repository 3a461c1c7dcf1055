"""Vector search over the chunk vectors, and what is made of the hits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docquill.functions import vectors as V
from docquill.operators import ann as A
from docquill.operators import clustering as K
from docquill.operators import retrieval as R
from docquill.plans.model import CHUNKS, chunks, table
from docquill.registry import query

SIM = "round(list_cosine_similarity(embedding::DOUBLE[], q.query::DOUBLE[]), 6)"
ONE = "q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id = 0)"
MANY = "q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 50 = 0)"
SCORED = f"scored AS (SELECT query_id, chunk_id, doc_id, run_id, content, {SIM} AS similarity FROM chunks, q)"
TOP = "each AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM scored WHERE similarity >= 0.15) WHERE rank <= {k})"
TOP_EACH = TOP.format(k=10)


def vectors_of(spark, sf_dir):
    """The chunks without their contents, which a search does not look at."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 40).alias("doc_id"), F.col("label").alias("run_id"), "embedding")


def first_query(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def many_queries(spark, sf_dir):
    """Every fiftieth vector; searched for among all."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def hits_of_each(spark, sf_dir, k=R.PER_QUERY):
    """The best ``k`` of each query; contents are fetched for the hits only."""
    c = chunks(spark, sf_dir)
    return R.best_of_each(vectors_of(spark, sf_dir).select("chunk_id", "embedding"), many_queries(spark, sf_dir), k).join(c.drop("embedding"), "chunk_id")


@query("match_chunks", f"WITH {CHUNKS}, {ONE}, {SCORED} SELECT chunk_id, doc_id, similarity FROM scored ORDER BY similarity DESC, chunk_id LIMIT 15")
def match_chunks(spark, sf_dir):
    return R.nearest(vectors_of(spark, sf_dir), first_query(spark, sf_dir)).select("chunk_id", "doc_id", "similarity")


@query("match_chunks_of_run", f"WITH {CHUNKS}, {ONE}, {SCORED} SELECT chunk_id, similarity FROM scored WHERE run_id = 3 ORDER BY similarity DESC, chunk_id LIMIT 15")
def match_chunks_of_run(spark, sf_dir):
    return R.nearest(vectors_of(spark, sf_dir).where("run_id = 3 AND embedding IS NOT NULL"), first_query(spark, sf_dir)).select("chunk_id", "similarity")


@query("topk_limit_200", f"WITH {CHUNKS}, {ONE}, {SCORED} SELECT chunk_id, similarity FROM scored ORDER BY similarity DESC, chunk_id LIMIT 200")
def topk_limit_200(spark, sf_dir):
    return R.nearest(vectors_of(spark, sf_dir), first_query(spark, sf_dir), 500).select("chunk_id", "similarity")


@query("cosine_distance", f"WITH {CHUNKS}, {ONE}, {SCORED} SELECT chunk_id, round(1 - similarity, 6) AS distance FROM scored")
def cosine_distance(spark, sf_dir):
    scored = R.score(vectors_of(spark, sf_dir), first_query(spark, sf_dir))
    return scored.select("chunk_id", F.round(1 - F.col("similarity"), 6).alias("distance"))


@query("cosine_similarity", "SELECT a.vec_id, round(CASE WHEN a.vec_id % 5 = 0 THEN 0 ELSE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END, 6)::DOUBLE AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_similarity(spark, sf_dir):
    """Of neighbours by id; every fifth vector is cut short, which gives zero."""
    a = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")).alias("a"))
    b = table(spark, sf_dir, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("cosine_clipped", "SELECT a.vec_id, round(greatest(-1, least(1, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6)::DOUBLE AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_clipped(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(b, "vec_id").select("vec_id", F.round(V.cosine_clipped(F.col("embedding"), F.col("b")), 6).alias("similarity"))


@query("knn_post_filter", f"WITH {CHUNKS}, {ONE}, {SCORED}, top AS (SELECT * FROM scored ORDER BY similarity DESC, chunk_id LIMIT 15) SELECT chunk_id, similarity FROM top WHERE doc_id IN (0, 3, 7, 11, 19)")
def knn_post_filter(spark, sf_dir):
    """The document filter after the limit: fewer may come back."""
    return R.nearest(vectors_of(spark, sf_dir), first_query(spark, sf_dir)).where(F.col("doc_id").isin(0, 3, 7, 11, 19)).select("chunk_id", "similarity")


@query("knn_pre_filter", f"WITH {CHUNKS}, {ONE}, {SCORED} SELECT chunk_id, similarity FROM scored WHERE doc_id IN (0, 3, 7, 11, 19) ORDER BY similarity DESC, chunk_id LIMIT 15")
def knn_pre_filter(spark, sf_dir):
    return R.nearest(vectors_of(spark, sf_dir).where(F.col("doc_id").isin(0, 3, 7, 11, 19)), first_query(spark, sf_dir)).select("chunk_id", "similarity")


@query("search_with_fallback", f"""WITH {CHUNKS}, {ONE}, {SCORED}, top AS (SELECT *, greatest(similarity, 0) AS s FROM scored ORDER BY similarity DESC, chunk_id LIMIT 15),
    post AS (SELECT chunk_id, content, s FROM top WHERE doc_id IN (5, 6)), pre AS (SELECT chunk_id, content, similarity AS s FROM scored WHERE doc_id IN (5, 6) ORDER BY s DESC, chunk_id LIMIT 15),
    hits AS (SELECT * FROM post UNION ALL SELECT * FROM pre WHERE NOT EXISTS (SELECT 1 FROM post))
    SELECT chunk_id, s AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY substr(coalesce(content, ''), 1, 100) ORDER BY s DESC, chunk_id) AS n FROM hits) WHERE n = 1 ORDER BY s DESC, chunk_id LIMIT 15""")
def search_with_fallback(spark, sf_dir):
    allowed = spark.createDataFrame([(5,), (6,)], "doc_id long")
    return R.search(chunks(spark, sf_dir), first_query(spark, sf_dir), allowed).select("chunk_id", "similarity")


@query("hnsw_format", f"""WITH {CHUNKS}, {ONE}, {SCORED}, top AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, chunk_id) - 1 AS rank FROM scored ORDER BY similarity DESC, chunk_id LIMIT 15)
    SELECT chunk_id, round(greatest(coalesce(CASE WHEN chunk_id % 3 > 0 THEN similarity END, greatest(0.1, 1 - 0.05 * rank)), 0), 6)::DOUBLE AS similarity FROM top""")
def hnsw_format(spark, sf_dir):
    """Every third hit's vector cannot be read, and its similarity comes from its rank."""
    top = R.nearest(vectors_of(spark, sf_dir), first_query(spark, sf_dir))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")) - 1  # 15 rows
    known = F.when(F.col("chunk_id") % 3 > 0, F.col("similarity"))
    return top.withColumn("rank", rank).select("chunk_id", F.round(R.ranked_similarity(known, F.col("rank")), 6).alias("similarity"))


@query("sort_similarity", f"WITH {CHUNKS}, {MANY}, {SCORED} SELECT query_id, chunk_id, coalesce(CASE WHEN chunk_id % 4 > 0 THEN similarity END, 0.0) AS similarity FROM scored ORDER BY 3 DESC, 1, 2")
def sort_similarity(spark, sf_dir):
    """All pairs in order; an unknown similarity counts as zero."""
    return R.in_order(vectors_of(spark, sf_dir), many_queries(spark, sf_dir), F.col("chunk_id") % 4 > 0)


@query("threshold_filter", f"WITH {CHUNKS}, {MANY}, {SCORED} SELECT query_id, chunk_id, similarity FROM scored WHERE similarity >= 0.25")
def threshold_filter(spark, sf_dir):
    return R.above_minimum(R.score(vectors_of(spark, sf_dir), many_queries(spark, sf_dir)), "english").select("query_id", "chunk_id", "similarity")


@query("quality_category", f"WITH {CHUNKS}, {MANY}, {SCORED} SELECT query_id, chunk_id, CASE WHEN similarity >= 0.7 THEN 'excellent' WHEN similarity >= 0.55 THEN 'good' WHEN similarity >= 0.35 THEN 'acceptable' ELSE 'poor' END AS danish, CASE WHEN similarity >= 0.75 THEN 'excellent' WHEN similarity >= 0.6 THEN 'good' WHEN similarity >= 0.4 THEN 'acceptable' ELSE 'poor' END AS english FROM scored")
def quality_category(spark, sf_dir):
    s = R.score(vectors_of(spark, sf_dir), many_queries(spark, sf_dir))
    return s.select("query_id", "chunk_id", R.quality_category(F.col("similarity"), "danish").alias("danish"), R.quality_category(F.col("similarity")).alias("english"))


@query("legacy_threshold_filter", f"WITH {CHUNKS}, {MANY}, {SCORED}, x AS (SELECT query_id, chunk_id, CASE WHEN similarity BETWEEN 0.1 AND 1 THEN similarity ELSE round(1 - similarity, 6) END AS similarity FROM scored) SELECT * FROM x WHERE similarity >= 0.2")
def legacy_threshold_filter(spark, sf_dir):
    """Values outside of 0.1 to 1 are taken for distances, so that most pairs stay."""
    s = R.score(vectors_of(spark, sf_dir).select("chunk_id", "embedding"), many_queries(spark, sf_dir), R.TOGETHER)
    as_similarity = F.when(F.col("similarity").between(0.1, 1.0), F.col("similarity")).otherwise(F.round(1 - F.col("similarity"), 6))
    return s.select("query_id", "chunk_id", as_similarity.alias("similarity")).where("similarity >= 0.2")


@query("parse_embedding", "SELECT vec_id, CASE WHEN vec_id % 7 > 0 THEN 64 END AS dims, CASE WHEN vec_id % 7 > 0 THEN round(embedding[1]::DOUBLE, 6) END AS first FROM embeddings")
def parse_embedding(spark, sf_dir):
    """Vectors written as text; every seventh is cut short and cannot be read."""
    text = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), ", "), F.when(F.col("vec_id") % 7 > 0, "]").otherwise(""))
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 > 0, V.parse_vector(text)).alias("v"))
    return v.select("vec_id", F.when(F.col("v").isNotNull(), F.size("v")).alias("dims"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


@query("dim_check", "SELECT label, CAST(count(CASE WHEN len(embedding) = 64 THEN 1 END) AS BIGINT) AS right_size FROM embeddings GROUP BY 1")
def dim_check(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count_if(F.size("embedding") == 64).alias("right_size"))


@query("join_cross_similarity", f"WITH {CHUNKS}, {MANY}, {SCORED} SELECT query_id, chunk_id, similarity FROM scored")
def join_cross_similarity(spark, sf_dir):
    """All pairs. They are the result itself, so where it is stored equal similarities go together."""
    pairs = R.score(vectors_of(spark, sf_dir).select("chunk_id", "embedding"), many_queries(spark, sf_dir), R.TOGETHER)
    return pairs.select("query_id", "chunk_id", "similarity")


@query("topk_per_query", f"WITH {CHUNKS}, {MANY}, {SCORED}, {TOP_EACH} SELECT query_id, chunk_id, rank::INT AS rank, similarity FROM each")
def topk_per_query(spark, sf_dir):
    return hits_of_each(spark, sf_dir).select("query_id", "chunk_id", "rank", "similarity")


@query("similarity_threshold_015", f"WITH {CHUNKS}, {MANY}, {SCORED} SELECT query_id, count(*) AS n FROM scored WHERE similarity >= 0.15 GROUP BY 1")
def similarity_threshold_015(spark, sf_dir):
    return R.score(vectors_of(spark, sf_dir), many_queries(spark, sf_dir)).where(F.col("similarity") >= R.LEAST).groupBy("query_id").agg(F.count("*").alias("n"))


@query("dedup_max_similarity", f"WITH {CHUNKS}, {MANY}, {SCORED} SELECT chunk_id, max(similarity) AS similarity, min_by(query_id, struct_pack(a := -similarity, b := query_id)) AS query_id FROM scored GROUP BY 1")
def dedup_max_similarity(spark, sf_dir):
    return R.best_query_of_each(vectors_of(spark, sf_dir), many_queries(spark, sf_dir)).select("chunk_id", "similarity", "query_id")


@query("multi_query_knn", f"WITH {CHUNKS}, {MANY}, {SCORED}, {TOP_EACH} SELECT chunk_id, max(similarity) AS similarity FROM each GROUP BY 1 ORDER BY 2 DESC, 1")
def multi_query_knn(spark, sf_dir):
    return R.best_of_chunk(hits_of_each(spark, sf_dir)).select("chunk_id", "similarity").orderBy(F.desc("similarity"), "chunk_id")


@query("union_multi_query", f"WITH {CHUNKS}, {MANY}, {SCORED}, {TOP_EACH} SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY query_id) AS n FROM each) WHERE n = 1")
def union_multi_query(spark, sf_dir):
    """A chunk that several queries find belongs to the first of them."""
    return hits_of_each(spark, sf_dir).groupBy("chunk_id").agg(F.min("query_id").alias("query_id"))


PAGE = "(SELECT *, row_number() OVER (PARTITION BY substr(coalesce(content, ''), 1, 100) ORDER BY query_id, rank) AS n FROM each)"


@query("topk_per_page", f"WITH {CHUNKS}, {MANY}, {SCORED}, {TOP_EACH} SELECT chunk_id, similarity FROM {PAGE} WHERE n = 1 ORDER BY similarity DESC, chunk_id LIMIT 15")
def topk_per_page(spark, sf_dir):
    """The queries of a wiki page: the earliest query's hit of a prefix stays, then the best 15."""
    first = R.first_of_prefix(hits_of_each(spark, sf_dir), 100, [F.col("query_id"), F.col("rank")])
    return first.orderBy(F.desc("similarity"), "chunk_id").limit(15).select("chunk_id", "similarity")


@query("source_doc_counts", f"WITH {CHUNKS}, {MANY}, {SCORED}, {TOP_EACH} SELECT doc_id, count(*) AS chunk_count FROM each GROUP BY 1")
def source_doc_counts(spark, sf_dir):
    return hits_of_each(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("chunk_count"))


@query("per_query_stats", f"WITH {CHUNKS}, {MANY}, {SCORED}, {TOP_EACH} SELECT q.query_id, count(chunk_id) AS results, round(coalesce(avg(similarity), 0), 6) AS avg_similarity FROM q LEFT JOIN (SELECT * FROM each WHERE similarity > 0.3) e USING (query_id) GROUP BY 1")
def per_query_stats(spark, sf_dir):
    hits = hits_of_each(spark, sf_dir).where("similarity > 0.3")
    return many_queries(spark, sf_dir).select("query_id").join(hits, "query_id", "left").groupBy("query_id").agg(F.count("chunk_id").alias("results"), F.round(F.coalesce(F.avg("similarity"), F.lit(0.0)), 6).alias("avg_similarity"))


OVERVIEW = f"""{CHUNKS}, {MANY}, {SCORED}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, substr(coalesce(content, ''), 1, 200) ORDER BY similarity DESC, chunk_id) AS n FROM scored),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM f WHERE n = 1 AND similarity >= 0.15), t AS (SELECT * FROM o WHERE rank <= 10)"""


def overview_hits(spark, sf_dir):
    """Per query: dedup by 200 characters first, then the threshold, then ten. The prefix is cut before the pairing, contents are fetched after it."""
    c = chunks(spark, sf_dir)
    prefix = F.substring(F.coalesce("content", F.lit("")), 1, 200).alias("content")
    best = R.best_of_each(c.select("chunk_id", prefix, "embedding"), many_queries(spark, sf_dir), unlike="content")
    return best.drop("content").join(c.select("chunk_id", "content"), "chunk_id")


@query("overview_knn", f"WITH {OVERVIEW} SELECT query_id, chunk_id, rank::INT AS rank FROM t")
def overview_knn(spark, sf_dir):
    return overview_hits(spark, sf_dir).select("query_id", "chunk_id", "rank")


@query("overview_prompt", f"WITH {OVERVIEW}, u AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY query_id, rank) AS m FROM t) SELECT chunk_id, substr(coalesce(content, ''), 1, 800) AS excerpt FROM u WHERE m = 1 ORDER BY query_id, rank LIMIT 15")
def overview_prompt(spark, sf_dir):
    """The first 15 chunks in the order in which queries found them, not sorted again."""
    first = overview_hits(spark, sf_dir).groupBy("chunk_id").agg(F.min(F.struct("query_id", "rank")).alias("at"), F.any_value("content").alias("content"))
    return first.orderBy("at").limit(15).select("chunk_id", F.substring(F.coalesce("content", F.lit("")), 1, 800).alias("excerpt"))


@query("citation_numbering", f"WITH {CHUNKS}, {MANY}, {SCORED}, {TOP_EACH}, m AS (SELECT query_id AS page_id, chunk_id, doc_id, rank, min(rank) OVER (PARTITION BY query_id, doc_id) AS first FROM each) SELECT page_id, chunk_id, CAST(dense_rank() OVER (PARTITION BY page_id ORDER BY first) AS INT) AS citation FROM m")
def citation_numbering(spark, sf_dir):
    return R.numbered_citations(hits_of_each(spark, sf_dir).withColumnRenamed("query_id", "page_id")).select("page_id", "chunk_id", "citation")


@query("answer_context", f"""WITH {CHUNKS}, {MANY}, {SCORED}, {TOP.format(k=10)} SELECT query_id, string_agg('Dokumenter fra doc_' || doc_id || '.pdf, side ' || run_id || ':' || chr(10) || coalesce(content, '') || chr(10), chr(10) ORDER BY rank) AS context FROM each GROUP BY 1""")
def answer_context(spark, sf_dir):
    """Each hit whole below the name of its document and its page, which the answer is to name."""
    hits = hits_of_each(spark, sf_dir).withColumn("filename", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))).withColumn("page", F.col("run_id"))
    return R.answer_context(hits)


@query("checklist_prompt", f"WITH {CHUNKS}, {MANY}, {SCORED}, {TOP.format(k=60)} SELECT query_id, string_agg('[' || doc_id || ', ' || chunk_id || '] ' || substr(coalesce(content, ''), 1, 800), chr(10) ORDER BY rank) AS context FROM each WHERE rank <= 50 GROUP BY 1")
def checklist_prompt(spark, sf_dir):
    return R.context(hits_of_each(spark, sf_dir, 60), 50, 800)


@query("markdown_prompt", f"""WITH {CHUNKS}, {MANY}, {SCORED}, {TOP.format(k=30)}, t AS (SELECT *, 'doc_' || doc_id || '.pdf' AS filename, min(rank) OVER (PARTITION BY query_id, doc_id) AS first FROM each WHERE rank <= 20),
    f AS (SELECT query_id, string_agg('[' || n || '] ' || filename, chr(10) ORDER BY n) AS footnotes FROM (SELECT query_id, filename, row_number() OVER (PARTITION BY query_id ORDER BY min(first)) AS n FROM t GROUP BY query_id, doc_id, filename) GROUP BY 1)
    SELECT query_id, string_agg('Excerpt ' || rank || ':' || chr(10) || 'Source: [' || filename || ', page ' || run_id || ']' || chr(10) || 'Relevance: ' || printf('%d.%03d', (CAST(round(greatest(similarity, 0) * 1000000) AS BIGINT) + 500) // 1000000, (CAST(round(greatest(similarity, 0) * 1000000) AS BIGINT) + 500) // 1000 % 1000) || chr(10) || 'Content: ' || substr(coalesce(content, ''), 1, 600) || '...', chr(10) ORDER BY rank) AS excerpts, any_value(footnotes) AS footnotes
    FROM t JOIN f USING (query_id) WHERE rank <= 12 GROUP BY 1""")
def markdown_prompt(spark, sf_dir):
    """Of thirty hits the best 20 give the footnotes and the first 12 the excerpts."""
    hits = hits_of_each(spark, sf_dir, 30).withColumnRenamed("query_id", "page_id").withColumn("filename", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))).withColumn("page", F.col("run_id"))
    return R.page_excerpts(hits).withColumnRenamed("page_id", "query_id")


@query("answer_quality", f"""WITH {CHUNKS}, {MANY}, {SCORED}, {TOP_EACH}, a AS (SELECT query_id, avg(similarity) AS rel, least(count(*) / 5.0, 1) AS complete FROM each GROUP BY 1)
    SELECT query_id, round(rel, 6) AS relevance, round(complete, 6)::DOUBLE AS completeness, round(0.4 * rel + 0.3 * complete + 0.27 * rel, 6)::DOUBLE AS score, CASE WHEN 0.4 * rel + 0.3 * complete + 0.27 * rel > 0.6 THEN 'good' WHEN 0.4 * rel + 0.3 * complete + 0.27 * rel > 0.4 THEN 'acceptable' ELSE 'low' END AS level FROM a""")
def answer_quality(spark, sf_dir):
    s = hits_of_each(spark, sf_dir).groupBy("query_id").agg(F.sort_array(F.collect_list("similarity"), False).alias("s"))
    m = s.select("query_id", R.answer_quality(F.col("s")).alias("m"))
    return m.select("query_id", *[F.round(f"m.{c}", 6).alias(c) for c in ("relevance", "completeness", "score")], "m.level")


@query("answer_confidence", f"WITH {CHUNKS}, {MANY}, {SCORED}, {TOP_EACH} SELECT query_id, round(least(1.0, avg(similarity)), 6)::DOUBLE AS confidence FROM each WHERE rank <= 3 GROUP BY 1")
def answer_confidence(spark, sf_dir):
    s = hits_of_each(spark, sf_dir).groupBy("query_id").agg(F.sort_array(F.collect_list("similarity"), False).alias("s"))
    return s.select("query_id", F.round(R.answer_confidence(F.col("s")), 6).alias("confidence"))


@query("empty_answer", f"WITH {CHUNKS}, {MANY}, {SCORED} SELECT q.query_id, CASE WHEN count(chunk_id) = 0 THEN 'no relevant information' ELSE 'answer' END AS answer, CASE WHEN count(chunk_id) = 0 THEN 'low' ELSE 'open' END AS level FROM q LEFT JOIN (SELECT * FROM scored WHERE similarity >= 0.8 AND chunk_id > 7) s USING (query_id) GROUP BY 1")
def empty_answer(spark, sf_dir):
    hits = R.score(vectors_of(spark, sf_dir), many_queries(spark, sf_dir)).where("similarity >= 0.8 AND chunk_id > 7")
    n = many_queries(spark, sf_dir).select("query_id").join(hits, "query_id", "left").groupBy("query_id").agg(F.count("chunk_id").alias("n"))
    none = F.col("n") == 0
    return n.select("query_id", F.when(none, "no relevant information").otherwise("answer").alias("answer"), F.when(none, "low").otherwise("open").alias("level"))


@query("ann_index")
def ann_index(spark, sf_dir):
    """Approximate neighbours of every fiftieth vector against all rows, by an index that is written once for the table's files; tests hold the recall."""
    e = table(spark, sf_dir, "embeddings")
    name = A.index_name(e, "embeddings")
    if not A.exists(spark, name):
        A.write_index(e.select(F.col("vec_id").alias("chunk_id"), "embedding"), name)
    return A.search(A.open_index(spark, name), many_queries(spark, sf_dir)).select("query_id", "chunk_id", "rank", "similarity")


@query("kmeans")
def kmeans(spark, sf_dir):
    return K.clusters(chunks(spark, sf_dir)).select("chunk_id", "cluster")


@query("cluster_count", "SELECT label, CAST(least(10, greatest(4, count(*) // 20)) AS INT) AS k FROM embeddings GROUP BY 1")
def cluster_count(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(K.cluster_count(F.count("*")).alias("k"))


@query("cluster_summary", f"WITH {CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY chunk_id) AS n FROM chunks) SELECT run_id AS cluster, max(n) AS n, string_agg(CASE WHEN n <= 3 THEN substr(coalesce(content, ''), 1, 150) END, ' | ' ORDER BY chunk_id) AS samples FROM r GROUP BY 1")
def cluster_summary(spark, sf_dir):
    return K.cluster_summaries(chunks(spark, sf_dir).withColumnRenamed("run_id", "cluster"))


@query("sink_embeddings", f"WITH {CHUNKS} SELECT chunk_id, CASE WHEN chunk_id % 3 = 0 THEN 'completed' WHEN chunk_id % 3 = 1 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN chunk_id % 3 = 0 THEN 64 ELSE 0 END AS dims FROM chunks")
def sink_embeddings(spark, sf_dir):
    """Chunks without vectors are stored; the vectors of a third, and then the failures of another, are put in by key. A re-run would take the rest."""
    from docquill.sources.tables import fresh_name, read_keyed, upsert_named

    c, name = chunks(spark, sf_dir).select("chunk_id", "embedding"), fresh_name("chunk_embeddings")
    none = F.lit(None).cast("string")
    upsert_named(c.select("chunk_id", F.lit(None).cast("array<float>").alias("embedding"), F.lit("pending").alias("status"), none.alias("model"), none.alias("error")), name, ["chunk_id"])
    upsert_named(c.where("chunk_id % 3 = 0").select("chunk_id", "embedding", F.lit("completed").alias("status"), F.lit("test-double").alias("model")), name, ["chunk_id"])
    upsert_named(c.where("chunk_id % 3 = 1").select("chunk_id", F.lit("failed").alias("status"), F.lit("time-out").alias("error")), name, ["chunk_id"])
    return read_keyed(spark, name).select("chunk_id", "status", F.when(F.col("embedding").isNull(), 0).otherwise(F.size("embedding")).alias("dims"))


@query("scan_pending_chunks", f"WITH {CHUNKS} SELECT chunk_id FROM chunks WHERE run_id = 2 AND chunk_id % 3 > 0")
def scan_pending_chunks(spark, sf_dir):
    from docquill.sources.tables import pending

    c = chunks(spark, sf_dir).withColumn("embedding", F.when(F.col("chunk_id") % 3 == 0, F.col("embedding")))
    return pending(c.where("run_id = 2")).select("chunk_id")
