"""Order-sensitive operators over elements, boxes and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquill.functions.text import token_estimate
from docquill.operators import boxes as B
from docquill.operators import chunking as C
from docquill.operators import elements as E
from docquill.operators.limiter import admit, demand
from docquill.operators.segments import GIANT, giants, known_giants
from docquill.plans.model import ELEMENTS, OWNED, elements, owned_documents, table
from docquill.plans.text import MAJOR, TITLE_SQL
from docquill.registry import query


def large_documents(spark, sf_dir):
    """The documents with so many characters that they may have more elements than a task should hold, or None."""
    return known_giants(table(spark, sf_dir, "documents").where(F.col("n_chars") > GIANT).select("doc_id"))


@query("section_inheritance", f"""WITH {ELEMENTS}, p AS (SELECT *, CASE WHEN category = 'UncategorizedText' THEN 1 ELSE 0 END AS phase FROM elements), m AS (SELECT *, CASE WHEN {MAJOR} THEN {TITLE_SQL} END AS major, CASE WHEN phase = 1 THEN 0 ELSE page END AS place FROM p)
    SELECT doc_id, seq, coalesce(last_value(major IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY phase, seq ROWS UNBOUNDED PRECEDING),
        last_value(major IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY phase, place, seq ROWS UNBOUNDED PRECEDING)) AS section FROM m""")
def section_inheritance(spark, sf_dir):
    e = elements(spark, sf_dir).withColumn("phase", F.when(F.col("category") == "UncategorizedText", 1).otherwise(0))
    return E.inherit_sections(e, large_documents(spark, sf_dir)).select("doc_id", "seq", "section")


KEPT = "kept AS (SELECT * FROM elements WHERE category NOT IN ('Header', 'Footer', 'PageBreak', 'Title') AND NOT (category = 'UncategorizedText' AND length(trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')) < 20))"
GROUPED = f"""{ELEMENTS}, {KEPT}, r AS (SELECT *, category = 'ListItem' AS item, category = 'NarrativeText' AND coalesce(lead(category) OVER w = 'ListItem', FALSE) AS anchor,
        sum(CASE WHEN category = 'ListItem' THEN 0 ELSE 1 END) OVER (w ROWS UNBOUNDED PRECEDING) AS run FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
    g AS (SELECT *, row_number() OVER w AS place, first_value(anchor) OVER w AS led FROM r WINDOW w AS (PARTITION BY doc_id, run ORDER BY seq)),
    grouped AS (SELECT doc_id, seq, page, category, text FROM g WHERE NOT (led AND place <= 11) UNION ALL
        SELECT doc_id, min(seq), min_by(page, seq), 'List', min_by(text, seq) || chr(10) || chr(10) || string_agg(CASE WHEN place > 1 THEN text END, chr(10) ORDER BY seq) FROM g WHERE led AND place <= 11 GROUP BY doc_id, run)"""
MERGED = f"""{GROUPED}, s AS (SELECT *, length(CASE WHEN category = 'UncategorizedText' AND regexp_matches(lower(text), 'tabel|table|figur|figure') THEN concat('Type: Reference', chr(10), chr(10), 'Content: ', text) ELSE text END) < 100 AS small FROM grouped),
    i AS (SELECT *, sum(CASE WHEN small THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM s), n AS (SELECT *, sum(CASE WHEN small THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, island, small) AS many FROM i),
    merged AS (SELECT doc_id, seq, page, category, text, CAST(1 AS BIGINT) AS merged FROM n WHERE NOT small OR many < 2 UNION ALL
        SELECT doc_id, min(seq), min_by(page, seq), 'MergedContent', coalesce(string_agg(nullif(trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), ''), chr(10) || chr(10) ORDER BY seq), ''), count(*) FROM n WHERE small AND many >= 2 GROUP BY doc_id, island)"""


@query("list_grouping", f"WITH {GROUPED} SELECT * FROM grouped")
def list_grouping(spark, sf_dir):
    return C.group_lists(C.filter_noise(elements(spark, sf_dir)), big=large_documents(spark, sf_dir))


@query("merge_small", f"WITH {MERGED} SELECT * FROM merged")
def merge_small(spark, sf_dir):
    big = large_documents(spark, sf_dir)
    return C.merge_small(C.group_lists(C.filter_noise(elements(spark, sf_dir)), big=big), big=big)


@query("recursive_split")
def recursive_split(spark, sf_dir):
    """Whole documents in overlapping pieces; tests hold the pieces' bounds and order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return C.split_large(docs).select("doc_id", "piece", "total", F.length("text").alias("chars"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


@query("chunk_documents")
def chunk_documents(spark, sf_dir):
    """The whole chain from elements to chunks."""
    c = C.chunk_elements(elements(spark, sf_dir), big=large_documents(spark, sf_dir))
    return c.select("doc_id", "seq", "piece", "total", "page", "category", "chunk_id", F.sha2(F.col("content").cast("binary"), 256).alias("sha"))


@query("token_batches", f"""WITH RECURSIVE {ELEMENTS}, t AS (SELECT doc_id, seq, CAST(floor(length(text) * 1.8) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM elements),
    f AS (SELECT doc_id, seq, n, tokens, tokens AS held, 1 AS count_, 0 AS batch FROM t WHERE n = 1 UNION ALL
        SELECT t.doc_id, t.seq, t.n, t.tokens, CASE WHEN f.held + t.tokens > 2000 OR f.count_ >= 10 THEN t.tokens ELSE f.held + t.tokens END, CASE WHEN f.held + t.tokens > 2000 OR f.count_ >= 10 THEN 1 ELSE f.count_ + 1 END,
            f.batch + CASE WHEN f.held + t.tokens > 2000 OR f.count_ >= 10 THEN 1 ELSE 0 END FROM f JOIN t ON t.doc_id = f.doc_id AND t.n = f.n + 1)
    SELECT doc_id, seq, tokens, batch FROM f""")
def token_batches(spark, sf_dir):
    """The texts of each document in batches, so that no group is larger than a document; small bounds, so that both bind."""
    e = elements(spark, sf_dir).select("doc_id", "seq", token_estimate(F.col("text")).alias("tokens"))
    return C.token_batches(e, "doc_id", 2000, 10, large_documents(spark, sf_dir))


PREFIX = "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY substr(text, 1, {n}) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1"


def _first_of_prefix(n):
    @query(f"dedup_prefix_{n}", PREFIX.format(n=n))
    def run(spark, sf_dir):
        """By an aggregate: the smallest id of each prefix, reduced before the shuffle."""
        return table(spark, sf_dir, "documents").groupBy(F.substring("text", 1, n).alias("p")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


_first_of_prefix(100)
_first_of_prefix(200)


@query("dedup_by_id", "SELECT l_partkey AS chunk_id, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY 1")
def dedup_by_id(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("chunk_id")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first"))


@query("current_step", """SELECT l_orderkey AS run_id, coalesce(['partition', 'metadata', 'enrichment', 'chunking', 'embedding', 'verify', 'done'][min(CASE WHEN l_linestatus <> 'F' THEN l_linenumber END)], 'completed') AS step FROM lineitem GROUP BY 1""")
def current_step(spark, sf_dir):
    """The first step in order that is not complete."""
    steps = F.array(*[F.lit(s) for s in ("partition", "metadata", "enrichment", "chunking", "embedding", "verify", "done")])
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.min(F.when(F.col("l_linestatus") != "F", F.col("l_linenumber"))).alias("open"))
    return g.select("run_id", F.coalesce(F.get(steps, F.col("open") - 1), F.lit("completed")).alias("step"))


BOX = "[l_quantity, l_linenumber * 10.0, l_quantity + l_partkey % 40 + 1.0, l_linenumber * 10.0 + l_suppkey % 30 + 1.0]"


def line_boxes(spark, sf_dir):
    box = F.array(F.col("l_quantity"), F.col("l_linenumber") * 10.0, F.col("l_quantity") + F.col("l_partkey") % 40 + 1.0, F.col("l_linenumber") * 10.0 + F.col("l_suppkey") % 30 + 1.0)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 2).alias("page"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("seq"), box.alias("box"))


@query("bbox_dedup")
def bbox_dedup(spark, sf_dir):
    kept = B.drop_repeated_boxes(line_boxes(spark, sf_dir))
    return kept.select("doc_id", "page", "place", "seq", *[F.col("box")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query("bbox_overlap", f"""WITH b AS (SELECT l_orderkey AS doc_id, l_partkey % 2 AS page, l_linenumber * 1000000 + l_partkey AS seq, {BOX} AS box FROM lineitem),
    p AS (SELECT x.doc_id, x.seq AS a, y.seq AS b, x.box AS u, y.box AS v FROM b x JOIN b y ON x.doc_id = y.doc_id AND x.page = y.page AND x.seq < y.seq),
    q AS (SELECT *, greatest(0, least(u[3], v[3]) - greatest(u[1], v[1])) * greatest(0, least(u[4], v[4]) - greatest(u[2], v[2])) AS shared, least((u[3] - u[1]) * (u[4] - u[2]), (v[3] - v[1]) * (v[4] - v[2])) AS small FROM p)
    SELECT doc_id, a, b, round(shared / small, 6) AS overlap, abs(u[1] - v[1]) <= 1 AND abs(u[2] - v[2]) <= 1 AND abs(u[3] - v[3]) <= 1 AND abs(u[4] - v[4]) <= 1 AS same FROM q""")
def bbox_overlap(spark, sf_dir):
    """All pairs of boxes of one page, those that share nothing too."""
    return B.page_pairs(line_boxes(spark, sf_dir)).select("doc_id", "a", "b", F.round("overlap", 6).alias("overlap"), "same")


@query("bbox_scale", f"SELECT l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey AS seq, round({BOX}[1] * 72 / 200, 6) AS x0, round({BOX}[4] * 72 / 200, 6) AS y1, round({BOX}[3] * 595.0 / 1654, 6) AS x1 FROM lineitem")
def bbox_scale(spark, sf_dir):
    none = F.lit(None).cast("double")
    by_dpi = E.scaled_box(F.col("box"), none, none, none, none)
    by_page = E.scaled_box(F.col("box"), F.lit(1654.0), F.lit(2339.0), F.lit(595.0), F.lit(842.0))
    return line_boxes(spark, sf_dir).select("doc_id", "seq", F.round(by_dpi[0], 6).alias("x0"), F.round(by_dpi[3], 6).alias("y1"), F.round(by_page[2], 6).alias("x1"))


@query("normalize_ocr", f"WITH {ELEMENTS} SELECT doc_id, seq, coalesce(CASE WHEN seq % 9 > 0 THEN page END, 1) AS page, category, round(seq * 72 / 200.0, 6)::DOUBLE AS x0 FROM elements WHERE doc_id % 3 > 0 OR category = 'Table'")
def normalize_ocr(spark, sf_dir):
    e = elements(spark, sf_dir).withColumn("page", F.when(F.col("seq") % 9 > 0, F.col("page"))).withColumn("visual", F.col("doc_id") % 3 == 0)
    e = e.withColumn("box", F.array(*[F.col("seq").cast("double")] * 4))
    return E.normalize_ocr(e).select("doc_id", "seq", "page", "category", F.round(F.col("box")[0], 6).alias("x0"))


def requests(spark, sf_dir):
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("caller"), F.col("event_id").alias("id"), t.alias("t"), (F.col("event_id") % 20 + 1).alias("n"))


@query("rate_limit")
def rate_limit(spark, sf_dir):
    r = requests(spark, sf_dir)
    return admit(r, big=giants(r, ["caller"]))


@query("rate_limit_demand", "SELECT user_id AS caller, event_id AS id, CAST(sum(event_id % 20 + 1) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS BIGINT) AS asked FROM events")
def rate_limit_demand(spark, sf_dir):
    return demand(requests(spark, sf_dir)).select("caller", "id", "asked")


@query("join_page_text_context", f"""WITH {ELEMENTS}, images AS (SELECT DISTINCT doc_id, page FROM elements WHERE category = 'UncategorizedText'), few AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY seq) AS rn FROM elements)
    SELECT i.doc_id, i.page, string_agg(text, chr(10) ORDER BY seq) AS context FROM images i LEFT JOIN few f ON f.doc_id = i.doc_id AND f.page = i.page AND rn <= 5 GROUP BY ALL""")
def join_page_text_context(spark, sf_dir):
    e = elements(spark, sf_dir)
    return E.page_context(e.where("category = 'UncategorizedText'").select("doc_id", "page").distinct(), e)


@query("anti_tables_on_full_pages", f"WITH {ELEMENTS}, full_pages AS (SELECT DISTINCT doc_id, page FROM elements WHERE category = 'Title') SELECT doc_id, seq, page FROM elements ANTI JOIN full_pages USING (doc_id, page) WHERE category = 'UncategorizedText'")
def anti_tables_on_full_pages(spark, sf_dir):
    e = elements(spark, sf_dir)
    full = e.where("category = 'Title'").select("doc_id", "page").distinct()
    return e.where("category = 'UncategorizedText'").join(full, ["doc_id", "page"], "left_anti").select("doc_id", "seq", "page")


@query("union_elements", f"WITH {ELEMENTS} SELECT doc_id, 0 AS phase, seq FROM elements WHERE category <> 'UncategorizedText' UNION ALL SELECT doc_id, 1, seq FROM elements WHERE category = 'UncategorizedText' UNION ALL SELECT doc_id, 2, page FROM (SELECT DISTINCT doc_id, page FROM elements)")
def union_elements(spark, sf_dir):
    e = elements(spark, sf_dir)
    at = lambda rows, phase, by: rows.select("doc_id", F.lit(phase).alias("phase"), F.col(by).cast("long").alias("seq"))
    return at(e.where("category <> 'UncategorizedText'"), 0, "seq").unionByName(at(e.where("category = 'UncategorizedText'"), 1, "seq")).unionByName(at(e.select("doc_id", "page").distinct(), 2, "page"))


@query("sink_chunks", f"WITH {MERGED} SELECT doc_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM merged GROUP BY 1")
def sink_chunks(spark, sf_dir):
    """Chunks are written as a table and read back."""
    from docquill.sources.tables import append, read_back

    big = large_documents(spark, sf_dir)
    c = C.merge_small(C.group_lists(C.filter_noise(elements(spark, sf_dir)), big=big), big=big)
    back = read_back(append(c, "chunks"))
    return back.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))


@query("chunk_id_backfill", "SELECT vec_id, 'chunk_' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS chunk_id FROM embeddings")
def chunk_id_backfill(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("chunk_"), F.lpad(F.col("vec_id").cast("string"), 6, "0")).alias("chunk_id"))
