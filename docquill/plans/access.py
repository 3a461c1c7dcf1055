"""Access predicates, joins, set operations, pages and latest rows over the relational tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from docquill.operators import access as A
from docquill.operators.cascade import ForeignKey, cascade
from docquill.operators.pages import By, page_after, page_at, token_of
from docquill.plans.model import CHUNKS, OWNED, PROJECTS, QUERY_RUNS, RUNS, chunks, owned_documents, projects, query_runs, runs, table
from docquill.functions import records as RC
from docquill.registry import query
from docquill.sources.tables import fresh_name, read_keyed, upsert_named

UID = 3
SEEN = "(access_level = 'public' OR access_level = 'auth' OR user_id = 3)"
RUN_SEEN = "(access_level = 'public' AND upload_type = 'email' OR access_level = 'auth' OR r.user_id = 3 OR EXISTS (SELECT 1 FROM projects p WHERE p.project_id = r.project_id AND p.user_id = 3))"


@query("rls_documents", f"WITH {OWNED} SELECT doc_id, access_level, user_id FROM owned WHERE {SEEN}")
def rls_documents(spark, sf_dir):
    return owned_documents(spark, sf_dir).where(A.visible_document(UID)).select("doc_id", "access_level", "user_id")


@query("rls_documents_anonymous", f"WITH {OWNED} SELECT doc_id, lang FROM owned WHERE access_level = 'public'")
def rls_documents_anonymous(spark, sf_dir):
    return owned_documents(spark, sf_dir).where(A.visible_document(None)).select("doc_id", "lang")


@query("rls_indexing_runs", f"WITH {RUNS}, {PROJECTS} SELECT run_id, access_level, upload_type FROM runs r WHERE {RUN_SEEN}")
def rls_indexing_runs(spark, sf_dir):
    return A.visible_runs(runs(spark, sf_dir), projects(spark, sf_dir), UID).select("run_id", "access_level", "upload_type")


@query("rls_chunks", f"""WITH {CHUNKS}, {OWNED}, {RUNS}, {PROJECTS} SELECT chunk_id, doc_id, run_id FROM chunks c
    WHERE EXISTS (SELECT 1 FROM owned o WHERE o.doc_id = c.doc_id AND {SEEN}) OR EXISTS (SELECT 1 FROM runs r WHERE r.run_id = c.run_id AND {RUN_SEEN})""")
def rls_chunks(spark, sf_dir):
    seen = A.visible_runs(runs(spark, sf_dir), projects(spark, sf_dir), UID)
    return A.visible_chunks(chunks(spark, sf_dir), owned_documents(spark, sf_dir), seen, UID).select("chunk_id", "doc_id", "run_id")


@query("rls_query_runs", f"WITH {QUERY_RUNS} SELECT id, access_level, user_id FROM query_runs WHERE {SEEN}")
def rls_query_runs(spark, sf_dir):
    return query_runs(spark, sf_dir).where(A.visible_document(UID)).select("id", "access_level", "user_id")


@query("rls_wiki_runs", f"WITH {RUNS}, {PROJECTS} SELECT run_id, status FROM runs r WHERE status = 'completed' AND {RUN_SEEN}")
def rls_wiki_runs(spark, sf_dir):
    return A.visible_runs(runs(spark, sf_dir).where("status = 'completed'"), projects(spark, sf_dir), UID).select("run_id", "status")


@query("rls_projects", f"WITH {PROJECTS} SELECT project_id, name FROM projects WHERE user_id = 3 AND NOT deleted")
def rls_projects(spark, sf_dir):
    return A.owned_projects(projects(spark, sf_dir), UID).where("NOT deleted").select("project_id", "name")


@query("rls_project_wikis", f"WITH {RUNS} SELECT run_id, project_id FROM runs WHERE access_level = 'public' AND upload_type = 'email' OR user_id = 3")
def rls_project_wikis(spark, sf_dir):
    return runs(spark, sf_dir).where(f"access_level = 'public' AND upload_type = 'email' OR user_id = {UID}").select("run_id", "project_id")


@query("rls_checklist", f"""WITH {RUNS} SELECT l_orderkey AS run_id, l_linenumber AS item FROM lineitem JOIN runs r ON l_orderkey = run_id
    WHERE CASE access_level WHEN 'public' THEN TRUE WHEN 'auth' THEN TRUE ELSE r.user_id = 3 END""")
def rls_checklist(spark, sf_dir):
    """Results inherit the access of their run."""
    allowed = runs(spark, sf_dir).where(F.when(F.col("access_level").isin("public", "auth"), True).otherwise(F.col("user_id") == UID))
    return table(spark, sf_dir, "lineitem").join(allowed, F.col("l_orderkey") == F.col("run_id"), "left_semi").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("item"))


PATH = "CASE upload_type WHEN 'email' THEN 'email-uploads/' || run_id ELSE 'users/' || user_id || '/projects/' || project_id || '/index-runs/' || run_id END"


def storage_path():
    own = F.concat_ws("/", F.lit("users"), "user_id", F.lit("projects"), "project_id", F.lit("index-runs"), "run_id")
    return F.when(F.col("upload_type") == "email", F.concat(F.lit("email-uploads/"), F.col("run_id"))).otherwise(own)


@query("storage_path", f"WITH {RUNS} SELECT run_id, {PATH} AS path FROM runs")
def storage_paths(spark, sf_dir):
    return runs(spark, sf_dir).select("run_id", storage_path().alias("path"))


@query("path_extract_run_id", f"WITH {RUNS} SELECT run_id, TRY_CAST(nullif(regexp_extract({PATH}, '/index-runs/([0-9]+)', 1), '') AS BIGINT) AS extracted FROM runs")
def path_extract_run_id(spark, sf_dir):
    found = F.nullif(F.regexp_extract(storage_path(), "/index-runs/([0-9]+)", 1), F.lit(""))
    return runs(spark, sf_dir).select("run_id", found.try_cast("long").alias("extracted"))


@query("rls_storage", f"WITH {RUNS} SELECT run_id FROM runs WHERE {PATH} LIKE 'email-uploads/%' OR {PATH} LIKE 'users/3/%' OR access_level = 'public'")
def rls_storage(spark, sf_dir):
    return runs(spark, sf_dir).where(storage_path().like("email-uploads/%") | storage_path().like(f"users/{UID}/%") | (F.col("access_level") == "public")).select("run_id")


@query("accessible_docs", f"WITH {OWNED} SELECT doc_id FROM owned WHERE access_level IN ('public', 'auth') UNION SELECT doc_id FROM owned WHERE user_id = 3")
def accessible_docs(spark, sf_dir):
    return A.accessible_ids(owned_documents(spark, sf_dir), UID)


@query("union_distinct_ids", f"WITH {OWNED} SELECT doc_id FROM owned WHERE access_level = 'public' UNION SELECT doc_id FROM owned WHERE lang = 'en'")
def union_distinct_ids(spark, sf_dir):
    d = owned_documents(spark, sf_dir)
    return d.where("access_level = 'public'").select("doc_id").union(d.where("lang = 'en'").select("doc_id")).distinct()


@query("visible_queries", f"""WITH {QUERY_RUNS}, own AS (SELECT *, 0 AS side FROM query_runs WHERE user_id = 3 ORDER BY ts DESC, id LIMIT 20),
    shared AS (SELECT *, 1 AS side FROM query_runs WHERE access_level IN ('public', 'auth') ORDER BY ts DESC, id LIMIT 20)
    SELECT id, user_id, side FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY side) AS rn FROM (SELECT * FROM own UNION ALL SELECT * FROM shared)) WHERE rn = 1 ORDER BY ts DESC, id LIMIT 20""")
def visible_queries(spark, sf_dir):
    """Own rows override shared ones of the same id; each side is paged before the merge."""
    q, order = query_runs(spark, sf_dir), [F.desc("ts"), F.asc("id")]
    page = lambda rows, side: rows.withColumn("side", F.lit(side)).orderBy(*order).limit(20)
    both = page(q.where(F.col("user_id") == UID), 0).unionByName(page(q.where(F.col("access_level").isin("public", "auth")), 1))
    first = F.row_number().over(Window.partitionBy("id").orderBy("side"))
    return both.withColumn("rn", first).where("rn = 1").orderBy(*order).limit(20).select("id", "user_id", "side")


@query("keyed_union_override", f"""WITH {QUERY_RUNS} SELECT id, min(side) AS side FROM (SELECT id, 0 AS side FROM query_runs WHERE user_id = 3 UNION ALL
    SELECT id, 1 AS side FROM query_runs WHERE access_level = 'public') GROUP BY id""")
def keyed_union_override(spark, sf_dir):
    q = query_runs(spark, sf_dir)
    both = q.where(F.col("user_id") == UID).select("id", F.lit(0).alias("side")).union(q.where("access_level = 'public'").select("id", F.lit(1).alias("side")))
    return both.groupBy("id").agg(F.min("side").alias("side"))


@query("visible_query_by_id", f"WITH {QUERY_RUNS} SELECT id, status FROM query_runs WHERE id IN (1, 2, 3, 4, 5) AND {SEEN}")
def visible_query_by_id(spark, sf_dir):
    return query_runs(spark, sf_dir).where(F.col("id").isin(1, 2, 3, 4, 5) & A.visible_document(UID)).select("id", "status")


@query("visible_analysis_runs", f"""WITH {QUERY_RUNS}, {RUNS} SELECT q.id, q.user_id, r.access_level FROM query_runs q JOIN runs r ON r.run_id = q.id
    WHERE r.access_level IN ('public', 'auth') OR q.user_id = 3""")
def visible_analysis_runs(spark, sf_dir):
    r = runs(spark, sf_dir).select("run_id", F.col("access_level").alias("parent"))
    met = query_runs(spark, sf_dir).join(r, F.col("id") == F.col("run_id"))
    return met.where(F.col("parent").isin("public", "auth") | (F.col("user_id") == UID)).select("id", "user_id", F.col("parent").alias("access_level"))


@query("run_access_check", f"WITH {RUNS} SELECT run_id, {SEEN} AS allowed FROM runs")
def run_access_check(spark, sf_dir):
    return runs(spark, sf_dir).select("run_id", A.visible_document(UID).alias("allowed"))


@query("project_ownership", f"WITH {RUNS}, {PROJECTS} SELECT run_id FROM runs SEMI JOIN (SELECT project_id FROM projects WHERE user_id = 3) USING (project_id)")
def project_ownership(spark, sf_dir):
    return runs(spark, sf_dir).join(A.owned_projects(projects(spark, sf_dir), UID), "project_id", "left_semi").select("run_id")


@query("soft_delete_view", f"WITH {PROJECTS} SELECT project_id, name FROM projects WHERE NOT deleted")
def soft_delete_view(spark, sf_dir):
    return projects(spark, sf_dir).where("NOT deleted").select("project_id", "name")


@query("pending_status_filters", f"WITH {RUNS} SELECT run_id, status FROM runs WHERE status IN ('running', 'failed') AND upload_type = 'email' AND price > 100000 AND created IS NOT NULL")
def pending_status_filters(spark, sf_dir):
    r = runs(spark, sf_dir)
    return r.where(F.col("status").isin("running", "failed") & (F.col("upload_type") == "email") & (F.col("price") > 100000) & F.col("created").isNotNull()).select("run_id", "status")


# joins


@query("join_run_documents", "SELECT l_orderkey AS run_id, p_partkey AS doc_id, p_name AS filename FROM lineitem JOIN part ON l_partkey = p_partkey")
def join_run_documents(spark, sf_dir):
    """The bridge of runs and documents, joined to the documents."""
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("run_id"), F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("filename"))


@query("join_chunks_by_doc", f"WITH {CHUNKS}, {OWNED} SELECT chunk_id, doc_id, run_id FROM chunks SEMI JOIN (SELECT doc_id FROM owned WHERE project_id = 2) USING (doc_id)")
def join_chunks_by_doc(spark, sf_dir):
    """By document, so chunks of other runs of the document are included."""
    return chunks(spark, sf_dir).join(owned_documents(spark, sf_dir).where("project_id = 2"), "doc_id", "left_semi").select("chunk_id", "doc_id", "run_id")


@query("join_wiki_embed", "SELECT c_custkey AS project_id, coalesce(o_orderstatus, 'none') AS wiki_status, coalesce(o_totalprice, 0) AS pages FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def join_wiki_embed(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    found = table(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return found.select(F.col("c_custkey").alias("project_id"), F.coalesce("o_orderstatus", F.lit("none")).alias("wiki_status"), F.coalesce("o_totalprice", F.lit(0.0)).alias("pages"))


LATEST = "latest AS (SELECT user_id, run_id, created FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created DESC, run_id) AS rn FROM runs WHERE status = 'completed') WHERE rn = 1)"


def latest_runs(r):
    """The newest completed run of each user, by an aggregate that is partial before the shuffle."""
    newest = F.max_by(F.struct(*r.columns), F.struct("created", -F.col("run_id")))
    return r.where("status = 'completed'").groupBy("user_id").agg(newest.alias("r")).select("r.*")


@query("latest_per_project", f"WITH {RUNS}, {LATEST} SELECT user_id, run_id FROM latest")
def latest_per_project(spark, sf_dir):
    return latest_runs(runs(spark, sf_dir)).select("user_id", "run_id")


@query("latest_run", f"WITH {RUNS} SELECT user_id, max_by(run_id, struct_pack(a := created, b := -run_id)) AS run_id FROM runs WHERE status = 'completed' GROUP BY user_id")
def latest_run(spark, sf_dir):
    """The same by an aggregate, which is partial before the shuffle."""
    newest = F.max_by("run_id", F.struct("created", -F.col("run_id")))
    return runs(spark, sf_dir).where("status = 'completed'").groupBy("user_id").agg(newest.alias("run_id"))


@query("join_projects_enrich", f"WITH {RUNS}, {PROJECTS}, {LATEST} SELECT p.project_id, coalesce(p.name, 'Unnamed') AS name, l.run_id FROM projects p LEFT JOIN latest l ON l.user_id = p.project_id WHERE NOT p.deleted")
def join_projects_enrich(spark, sf_dir):
    last = latest_runs(runs(spark, sf_dir)).select(F.col("user_id").alias("u"), "run_id")
    return projects(spark, sf_dir).where("NOT deleted").join(last, F.col("project_id") == F.col("u"), "left").select("project_id", F.coalesce("name", F.lit("Unnamed")).alias("name"), "run_id")


@query("join_docname_lookup", f"WITH {CHUNKS}, {OWNED} SELECT chunk_id, coalesce(o.filename, 'document_' || substr(CAST(c.chunk_id AS VARCHAR), 1, 8)) AS filename FROM chunks c LEFT JOIN (SELECT * FROM owned WHERE lang = 'en') o ON o.doc_id = c.doc_id")
def join_docname_lookup(spark, sf_dir):
    names = owned_documents(spark, sf_dir).where("lang = 'en'").select("doc_id", "filename")
    default = F.concat(F.lit("document_"), F.substring(F.col("chunk_id").cast("string"), 1, 8))
    return chunks(spark, sf_dir).join(names, "doc_id", "left").select("chunk_id", F.coalesce("filename", default).alias("filename"))


@query("semi_project_runs", f"WITH {RUNS}, {PROJECTS} SELECT run_id, created FROM runs WHERE project_id IN (SELECT project_id FROM projects WHERE user_id = 3 AND NOT deleted) ORDER BY created DESC, run_id LIMIT 50")
def semi_project_runs(spark, sf_dir):
    mine = A.owned_projects(projects(spark, sf_dir), UID).where("NOT deleted")
    return runs(spark, sf_dir).join(mine, "project_id", "left_semi").orderBy(F.desc("created"), "run_id").limit(50).select("run_id", "created")


@query("trigger_sync_upsert", f"""WITH {RUNS}, {PROJECTS}, old AS (SELECT run_id, project_id, 'old' AS name FROM runs WHERE run_id % 3 = 0),
    new AS (SELECT run_id, project_id, name FROM runs JOIN projects USING (project_id) WHERE status = 'completed' AND run_id % 2 = 0)
    SELECT coalesce(n.run_id, o.run_id) AS run_id, coalesce(n.project_id, o.project_id) AS project_id, coalesce(n.name, o.name) AS name FROM old o FULL JOIN new n ON o.run_id = n.run_id AND o.project_id = n.project_id""")
def trigger_sync_upsert(spark, sf_dir):
    """New rows replace old ones of the same key in a stored table."""
    r = runs(spark, sf_dir)
    old = r.where("run_id % 3 = 0").select("run_id", "project_id", F.lit("old").alias("name"))
    new = r.where("status = 'completed' AND run_id % 2 = 0").join(projects(spark, sf_dir).select("project_id", "name"), "project_id").select("run_id", "project_id", "name")
    name = fresh_name("project_runs")
    upsert_named(old, name, ["run_id", "project_id"])
    upsert_named(new, name, ["run_id", "project_id"])
    return read_keyed(spark, name)


@query("backfill_sync", f"""WITH {RUNS}, {PROJECTS} SELECT run_id, project_id, name FROM runs JOIN projects USING (project_id) WHERE status = 'completed' AND NOT EXISTS (SELECT 1 FROM runs o WHERE o.run_id = runs.run_id AND o.run_id % 3 = 0)""")
def backfill_sync(spark, sf_dir):
    r = runs(spark, sf_dir)
    fresh = r.where("status = 'completed'").join(r.where("run_id % 3 = 0").select("run_id"), "run_id", "left_anti")
    return fresh.join(projects(spark, sf_dir).select("project_id", "name"), "project_id").select("run_id", "project_id", "name")


# pages of results


def page_of(rows, order, limit: int, offset: int, most: int = 100):
    """A page of ordered rows; limit and offset stay within their bounds."""
    limit, offset = RC.page_limit(limit, offset, most)
    return rows.orderBy(*order).offset(offset).limit(limit)


@query("paginate", f"WITH {RUNS} (SELECT 'queries' AS list, run_id, created FROM runs ORDER BY created DESC, run_id LIMIT 100) UNION ALL (SELECT 'runs', run_id, created FROM runs ORDER BY created DESC, run_id LIMIT 50 OFFSET 100)")
def paginate(spark, sf_dir):
    """A list of queries asked for 500 from -3 on, and one of runs asked for 80 from 100 on: the bounds are 100 and 50, and the start."""
    r, order = runs(spark, sf_dir).select("run_id", "created"), [F.desc("created"), F.asc("run_id")]
    first, second = page_of(r, order, 500, -3), page_of(r, order, 80, 100, 50)
    return first.select(F.lit("queries").alias("list"), "*").unionByName(second.select(F.lit("runs").alias("list"), "*"))


DEEP = "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT {limit} OFFSET 40000"


@query("paginate_deep", f"SELECT CASE WHEN n <= 50 THEN 'at' ELSE 'after' END AS page, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS n FROM ({DEEP.format(limit=100)}))")
def paginate_deep(spark, sf_dir):
    """A page from 40,000 on, found by counting ranges, and the page after it by its token."""
    rows, by = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), [By("l_shipdate", True), By("l_orderkey"), By("l_linenumber")]
    first = page_at(rows, by, 50, 40_000)
    token = token_of(first, by)
    second = page_after(rows, by, token, 50) if token else rows.limit(0)
    return first.select(F.lit("at").alias("page"), "l_orderkey", "l_linenumber").unionByName(second.select(F.lit("after").alias("page"), "l_orderkey", "l_linenumber"))


GONE = """u AS (SELECT c_custkey FROM customer WHERE c_nationkey % 5 = 2), s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey % 5 = 2), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM u)),
    l AS (SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM o) AND l_suppkey NOT IN (SELECT * FROM s))"""


@query("cascade_delete", f"""WITH {GONE} SELECT 'nation' AS "table", count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys, CAST(0 AS BIGINT) AS unowned FROM nation WHERE n_nationkey % 5 <> 2 UNION ALL
    SELECT 'customer', count(*), CAST(sum(c_custkey) AS BIGINT), 0 FROM customer WHERE c_custkey NOT IN (SELECT * FROM u) UNION ALL SELECT 'supplier', count(*), CAST(sum(s_suppkey) AS BIGINT), 0 FROM supplier WHERE s_suppkey NOT IN (SELECT * FROM s) UNION ALL
    SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT), 0 FROM orders WHERE o_orderkey NOT IN (SELECT * FROM o) UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT), 0 FROM l UNION ALL
    SELECT 'events', count(*), CAST(sum(event_id) AS BIGINT), count(*) FILTER (user_id IN (SELECT * FROM u)) FROM events""")
def cascade_delete(spark, sf_dir):
    """Nations go, and with them their customers (users) and suppliers, the orders (runs) of these, and the lines (chunks) of either; events of such users lose their reference."""
    primary = {"nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "events": ["event_id"]}
    columns = {"customer": ["c_nationkey"], "supplier": ["s_nationkey"], "orders": ["o_custkey"], "events": ["user_id"]}
    tables = {t: table(spark, sf_dir, t).select(*key, *columns.get(t, [])) for t, key in primary.items()}
    keys = [ForeignKey("customer", "c_nationkey", "nation", "n_nationkey"), ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey"), ForeignKey("orders", "o_custkey", "customer", "c_custkey"),
            ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"), ForeignKey("lineitem", "l_suppkey", "supplier", "s_suppkey"), ForeignKey("events", "user_id", "customer", "c_custkey", "set null")]
    left = cascade(tables, primary, keys, {"nation": tables["nation"].where("n_nationkey % 5 = 2")})
    unowned = lambda t: F.count_if(F.col("user_id").isNull()) if t == "events" else F.lit(0).cast("long")
    counts = [df.agg(F.lit(t).alias("table"), F.count("*").alias("n"), F.sum(F.col(primary[t][0]).cast("long")).alias("keys"), unowned(t).alias("unowned")) for t, df in left.items()]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query("exact_count", f"WITH {RUNS} SELECT run_id, (SELECT count(*) FROM runs WHERE status = 'completed') AS total, 0 + 20 < (SELECT count(*) FROM runs WHERE status = 'completed') AS has_more FROM runs WHERE status = 'completed' ORDER BY created DESC, run_id LIMIT 20")
def exact_count(spark, sf_dir):
    done = runs(spark, sf_dir).where("status = 'completed'")
    total = done.agg(F.count("*").alias("total"))
    page = done.orderBy(F.desc("created"), "run_id").limit(20)
    return page.join(F.broadcast(total)).select("run_id", "total", (F.col("total") > 20).alias("has_more"))  # one row


@query("sort_null_default", f"WITH {RUNS}, {PROJECTS} SELECT project_id, coalesce(l, 0) AS k FROM projects LEFT JOIN (SELECT user_id AS u, max(run_id) AS l FROM runs WHERE status = 'running' GROUP BY 1) ON u = project_id ORDER BY coalesce(l, 0) DESC, project_id LIMIT 30")
def sort_null_default(spark, sf_dir):
    last = runs(spark, sf_dir).where("status = 'running'").groupBy("user_id").agg(F.max("run_id").alias("l")).withColumnRenamed("user_id", "u")
    return projects(spark, sf_dir).join(last, F.col("u") == F.col("project_id"), "left").select("project_id", F.coalesce("l", F.lit(0)).alias("k")).orderBy(F.desc("k"), "project_id").limit(30)


@query("status_priority_sort", """SELECT doc_id, status, CASE status WHEN 'pending_clarification' THEN 1 WHEN 'conditions' THEN 2 WHEN 'risk' THEN 3 WHEN 'missing' THEN 4 ELSE 5 END AS priority
    FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'pending_clarification' WHEN quality = 1 AND toxic = 0 THEN 'found' WHEN quality = 1 THEN 'risk' WHEN toxic = 1 THEN 'conditions' ELSE 'missing' END AS status FROM labels) ORDER BY 3, 1""")
def status_priority_sort(spark, sf_dir):
    """Results of a checklist in the order in which they are shown."""
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    status = F.when(F.col("doc_id") % 9 == 0, "pending_clarification").when(good & ~toxic, "found").when(good, "risk").when(toxic, "conditions").otherwise("missing")
    r = table(spark, sf_dir, "labels").select("doc_id", status.alias("status"))
    return r.withColumn("priority", RC.checklist_priority(F.col("status"))).orderBy("priority", "doc_id")


@query("wiki_initial", f"""WITH {RUNS}, first AS (SELECT project_id, max_by(run_id, struct_pack(a := created, b := run_id)) AS run_id FROM runs WHERE status = 'completed' GROUP BY 1)
    SELECT project_id, run_id, min_by(l_partkey, struct_pack(a := l_linenumber, b := l_partkey)) AS page FROM first JOIN lineitem ON l_orderkey = run_id GROUP BY ALL""")
def wiki_initial(spark, sf_dir):
    """The first page of each project's newest completed run."""
    first = runs(spark, sf_dir).where("status = 'completed'").groupBy("project_id").agg(F.max_by("run_id", F.struct("created", "run_id")).alias("run_id"))
    pages = table(spark, sf_dir, "lineitem").join(first, F.col("l_orderkey") == F.col("run_id"))
    return pages.groupBy("project_id", "run_id").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("page"))


@query("preview_first_n", f"WITH {RUNS} SELECT user_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created, run_id) AS rn FROM runs) WHERE rn <= 3")
def preview_first_n(spark, sf_dir):
    """First within 64 parts of a user's runs, then among the parts' first."""
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("created", "run_id"))
    r = runs(spark, sf_dir).select("user_id", "run_id", "created", F.pmod(F.xxhash64("run_id"), F.lit(64)).alias("part"))
    return r.withColumn("rn", first("user_id", "part")).where("rn <= 3").withColumn("rn", first("user_id")).where("rn <= 3").select("user_id", "run_id")


@query("expiry", f"WITH {RUNS} SELECT upload_type, count(*) AS n FROM runs WHERE created + INTERVAL 30 DAY < TIMESTAMP '1998-01-01' AND status <> 'running' GROUP BY 1")
def expiry(spark, sf_dir, moment: str = "1998-01-01", days: int = 30):
    gone = (F.col("created") + F.make_dt_interval(F.lit(days)) < F.lit(moment).cast("timestamp_ntz")) & (F.col("status") != "running")
    return runs(spark, sf_dir).where(gone).groupBy("upload_type").agg(F.count("*").alias("n"))
