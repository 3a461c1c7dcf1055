"""JSON, maps, configuration values, prompts and wiki measures over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquill.functions import records as RC
from docquill.functions import repair
from docquill.functions.text import DANISH_WORDS, ENGLISH_WORDS
from docquill.operators import wiki as W
from docquill.plans.model import CHUNKS, OWNED, chunks, owned_documents, table
from docquill.plans.text import WORDS
from docquill.registry import query


@query("jsonb_merge", """SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE coalesce(json_extract_string(props, '$.k'), '') END AS k, CASE WHEN value > 50 THEN 'slow' END AS note, coalesce(json_array_length(json_keys(props)), 0)::INT
    + CASE WHEN value > 50 THEN 1 ELSE 0 END + CASE WHEN event_type = 'error' AND json_extract_string(props, '$.k') IS NULL THEN 1 ELSE 0 END AS n FROM events""")
def jsonb_merge(spark, sf_dir):
    """An event's properties with entries that are added under a condition; a key that is in both is replaced."""
    none = F.create_map().cast("map<string,string>")
    entry = lambda ok, k, v: F.when(ok, F.create_map(F.lit(k), F.lit(v))).otherwise(none)
    added = F.map_concat(entry(F.col("event_type") == "error", "k", "failed"), entry(F.col("value") > 50, "note", "slow"))
    m = table(spark, sf_dir, "events").withColumn("m", RC.merged_map(RC.string_map(F.col("props")), added))
    return m.select("event_id", F.coalesce(F.try_element_at("m", F.lit("k")), F.lit("")).alias("k"), F.try_element_at("m", F.lit("note")).alias("note"), F.size("m").alias("n"))


@query("jsonb_array_len", "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n, CAST(0 AS BIGINT) AS of_object FROM documents")
def jsonb_array_len(spark, sf_dir):
    """The lines of a document as a JSON array; an object has none."""
    d = table(spark, sf_dir, "documents").withColumn("lines", F.to_json(F.split("text", "\n", -1))).withColumn("object", F.to_json(F.struct("lang", "source")))
    return d.select("doc_id", RC.array_length(F.col("lines")).alias("n"), RC.array_length(F.col("object")).alias("of_object"))


@query("url_extract", "SELECT page_id, CASE page_id % 4 WHEN 3 THEN CASE WHEN page_id % 8 = 7 THEN NULL ELSE url END ELSE url END AS found FROM pages")
def url_extract(spark, sf_dir):
    """A plain string, or one of the keys of an object."""
    keyed = F.to_json(F.struct(*[F.when(F.col("page_id") % 4 == i, F.col("url")).alias(k) for i, k in enumerate((*RC.URL_KEYS, "other"))]))
    shaped = F.when(F.col("page_id") % 8 == 3, F.col("url")).otherwise(keyed)
    return table(spark, sf_dir, "pages").select("page_id", RC.found_url(shaped).alias("found"))


def _answers(spark, sf_dir):
    """Answers of many shapes around a document's number and text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    obj = F.to_json(F.struct("doc_id", "lang", "text"))
    k = F.col("doc_id") % 6
    return d.withColumn("answer", F.when(k == 0, obj).when(k == 1, F.concat(F.lit("Here it is:\n```json\n"), obj, F.lit("\n```\nDone."))).when(k == 2, F.concat(F.lit("The result "), obj, F.lit(" as asked")))
        .when(k == 3, F.concat(F.lit("["), obj, F.lit(", "), obj, F.lit(', {"doc_id": 1, "la'))).when(k == 4, F.lit("no json here {")).otherwise(F.lit(None).cast("string"))).drop("text")


@query("parse_llm_json", "SELECT doc_id, CASE WHEN doc_id % 6 < 4 THEN doc_id END AS found, CASE WHEN doc_id % 6 < 4 THEN sha256(text) END AS sha FROM documents")
def parse_llm_json(spark, sf_dir):
    """The whole text comes back out of the answer."""
    o = F.from_json("o", "doc_id long, text string")
    found = _answers(spark, sf_dir).withColumn("o", repair.object_in("answer")).withColumn("o", o)
    return found.select("doc_id", F.col("o.doc_id").alias("found"), F.sha2(F.col("o.text").cast("binary"), 256).alias("sha"))


@query("parse_llm_array", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 END AS n FROM documents")
def parse_llm_array(spark, sf_dir):
    """The cut-off array keeps its two whole objects."""
    return _answers(spark, sf_dir).select("doc_id", F.json_array_length(repair.array_in("answer")).alias("n"))


@query("parse_checklist_json", "SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1, 2) THEN lang ELSE substr(text, 1, 100) END AS first FROM documents")
def parse_checklist_json(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    a = _answers(spark, sf_dir).withColumn("answer", F.when(F.col("doc_id") % 6 == 3, "none").otherwise(F.col("answer")))
    found = a.join(d, "doc_id").withColumn("o", repair.checklist_in("answer", "text"))
    parsed = F.from_json("o", "lang string, queries array<string>")
    return found.select("doc_id", F.coalesce(parsed["lang"], F.get(parsed["queries"], F.lit(0))).alias("first"))


@query("parse_cluster_names", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN turn END AS cluster, CASE WHEN turn % 2 = 0 THEN role ELSE 'Temaområde ' || turn END AS name FROM conversations")
def parse_cluster_names(spark, sf_dir):
    """Lines with the word before the number count; others fall back."""
    line = F.concat(F.when(F.col("turn") % 2 == 0, "Klynge ").otherwise("Cluster "), F.col("turn").cast("string"), F.lit(": "), F.col("role"))
    number = F.regexp_extract("line", r"Klynge.*?(\d+)\s*:", 1).try_cast("long")
    c = table(spark, sf_dir, "conversations").withColumn("line", line)
    return c.select("conv_id", "turn", number.alias("cluster"), F.when(number.isNotNull(), F.trim(F.regexp_extract("line", ":(.*)$", 1))).otherwise(F.concat(F.lit("Temaområde "), F.col("turn").cast("string"))).alias("name"))


@query("structure_validate", "SELECT conv_id, CAST(count(*) + CASE WHEN bool_or(role = 'assistant') THEN 0 ELSE 1 END AS INT) AS pages FROM conversations GROUP BY 1")
def structure_validate(spark, sf_dir):
    """The turns of a conversation as planned pages."""
    title = F.when(F.col("role") == "assistant", "Project Overview").otherwise(F.col("role"))
    p = F.transform(F.sort_array(F.collect_list(F.struct("turn", title.alias("title")))), lambda x: F.struct(F.lit(None).cast("string").alias("id"), x["title"].alias("title"), F.lit(None).cast("int").alias("score")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(p.alias("p")).select("conv_id", F.size(W.validated_structure(F.col("p"))).alias("pages"))


@query("compact_step_result", """SELECT doc_id, CAST(len(l) AS INT) AS n, CASE WHEN len(l) > 5 THEN l[1] || '|' || l[2] || '|' || l[-1] ELSE array_to_string(l, '|') END AS samples, CASE WHEN len(l) > 5 THEN len(l) || ' items (showing 2 first + 1 last)' END AS summary,
    CASE WHEN length(text) > 1000 THEN substr(text, 1, 100) || '... [truncated ' || length(text) || ' chars]' ELSE text END AS kept, len(l) || ' chunks processed, avg size: ' || (length(text) - len(l) + 1) // len(l) || ' chars' AS chunks FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)""")
def compact_step_result(spark, sf_dir):
    """Long lists become a count with samples, chunks their statistics, long texts their beginning with a note."""
    lines = F.split("text", "\n", -1)
    c = table(spark, sf_dir, "documents").select("doc_id", RC.compact_list(lines).alias("l"), RC.compact_chunks(lines).alias("c"), RC.compact_text(F.col("text")).alias("kept"))
    samples = F.array_join(F.concat(F.col("l.first_items"), F.when(F.col("l.last_item").isNotNull(), F.array("l.last_item")).otherwise(F.array().cast("array<string>"))), "|")
    return c.select("doc_id", F.col("l.count").alias("n"), samples.alias("samples"), F.col("l.summary").alias("summary"), "kept", F.col("c.summary").alias("chunks"))


@query("clean_metadata", f"WITH {OWNED} SELECT doc_id, 'filename,page_number' || CASE WHEN lang = 'en' THEN ',text_as_html' ELSE '' END AS keys, filename AS name FROM owned")
def clean_metadata(spark, sf_dir):
    """Of a document's own fields only those that elements keep."""
    m = F.create_map(F.lit("filename"), F.col("filename"), F.lit("source"), F.col("source"), F.lit("page_number"), F.col("n_chars").cast("string"), F.lit("raw_text"), F.col("text"), F.lit("lang"), F.col("lang"))
    m = F.when(F.col("lang") == "en", F.map_concat(m, F.create_map(F.lit("text_as_html"), F.col("text")))).otherwise(m)
    d = owned_documents(spark, sf_dir).withColumn("m", RC.kept_keys(m))
    return d.select("doc_id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"), F.element_at("m", "filename").alias("name"))


COUNT = lambda tag: f"CAST(len(regexp_extract_all(html, '(?i)<{tag}[ >]')) AS INT)"


@query("clean_page_analysis", f"SELECT page_id, {COUNT('img')} AS image_count, {COUNT('table')} AS table_count, CASE WHEN {COUNT('img')} > 1 THEN 'complex' ELSE 'simple' END AS complexity, CAST(NULL AS VARCHAR) AS is_fragmented FROM pages")
def clean_page_analysis(spark, sf_dir):
    """Counts of a page with all the listed keys; what was not found out is null, what is not listed goes."""
    count = lambda tag: F.regexp_count("html", F.lit(f"(?i)<{tag}[ >]"))
    m = F.create_map(F.lit("image_count"), count("img").cast("string"), F.lit("table_count"), count("table").cast("string"), F.lit("markup"), F.col("html"), F.lit("complexity"), F.when(count("img") > 1, "complex").otherwise("simple"))
    p = table(spark, sf_dir, "pages").select("page_id", RC.page_analysis(m).alias("p"))
    return p.select("page_id", F.col("p.image_count").cast("int").alias("image_count"), F.col("p.table_count").cast("int").alias("table_count"), "p.complexity", "p.is_fragmented")


@query("essential_metadata", f"WITH {OWNED} SELECT doc_id, filename, CASE WHEN doc_id % 4 > 0 THEN doc_id % 9 END AS page_number FROM owned WHERE NOT (doc_id % 4 = 0 AND filename IS NULL)")
def essential_metadata(spark, sf_dir):
    return owned_documents(spark, sf_dir).select("doc_id", "filename", F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 9).alias("page_number"))


@query("font_of_block", "SELECT l_orderkey AS doc_id, l_linenumber AS block, CASE WHEN l_partkey % 4 = 0 THEN 12.0 ELSE l_quantity END AS font_size, l_partkey % 4 > 0 AND (l_suppkey // 16) % 2 = 1 AS bold FROM lineitem")
def font_of_block(spark, sf_dir):
    """Of the first span of the first line; 12 and not bold where there is none. Bit 4 of the flags is bold."""
    spans = F.when(F.col("l_partkey") % 4 == 0, F.array().cast("array<struct<size:double,flags:bigint>>")).otherwise(F.array(F.struct(F.col("l_quantity").alias("size"), F.col("l_suppkey").alias("flags"))))
    first = F.get(spans, F.lit(0))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("block"), F.coalesce(first["size"], F.lit(12.0)).alias("font_size"), F.coalesce(first["flags"].bitwiseAND(16) > 0, F.lit(False)).alias("bold"))


@query("progress_pct", "SELECT l_orderkey AS run_id, round(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) * 100.0 / 7, 6) AS percentage, CAST((7 - sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)) * 60 AS BIGINT) AS seconds_left FROM lineitem GROUP BY 1")
def progress_pct(spark, sf_dir):
    done = F.count_if(F.col("l_linestatus") == "F")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.round(done * 100.0 / 7, 6).alias("percentage"), ((7 - done) * 60).alias("seconds_left"))


@query("estimate_durations", f"""WITH {OWNED}, c AS (SELECT project_id, CAST(sum(n_chars // 1000 + 1) AS BIGINT) AS n FROM owned GROUP BY 1)
    SELECT project_id, n AS chunks, greatest(10, n // 10) AS metadata, greatest(n * 12, 30) AS enrichment, greatest(5, n // 10) AS chunking, greatest(1, n // 10 + 2) AS embedding, greatest(60, n // 100 * 5 + 30) AS clustering, 60 + n * 5 AS markdown, n * 30 AS retrieval, CAST(floor(3 + n / 2) AS BIGINT) AS generation FROM c""")
def estimate_durations(spark, sf_dir):
    n = owned_documents(spark, sf_dir).groupBy("project_id").agg(F.sum(F.floor(F.col("n_chars") / 1000) + 1).alias("chunks"))
    return n.select("project_id", "chunks", *[RC.estimated_seconds(s, F.col("chunks")).alias(s) for s in ("metadata", "enrichment", "chunking", "embedding", "clustering", "markdown", "retrieval", "generation")])


@query("sink_query_run", "SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'public' ELSE 'private' END AS access_level, value AS response_ms, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status FROM events")
def sink_query_run(spark, sf_dir):
    """Runs are written to a table and read back by its name; those without a user are public."""
    from docquill.sources.tables import append_named, fresh_name, read_named

    user = F.when(F.col("event_id") % 5 > 0, F.col("user_id"))
    runs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), user.alias("user_id"), F.when(user.isNull(), "public").otherwise("private").alias("access_level"), F.col("value").alias("response_ms"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"))
    name = fresh_name("query_runs")
    append_named(runs.where("status = 'completed'"), name)
    append_named(runs.where("status <> 'completed'"), name)
    return read_named(spark, name).select("id", "access_level", "response_ms", "status")


@query("sink_step_result", "SELECT user_id AS run_id, event_type AS step, max_by(value, struct_pack(a := ts, b := event_id)) AS result FROM events GROUP BY ALL")
def sink_step_result(spark, sf_dir):
    """An append-only log, read as the newest result of each step."""
    from docquill.sources.tables import latest_steps

    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("step"), F.struct("ts", "event_id").alias("at"), F.col("value").alias("result"))
    return latest_steps(log).select("run_id", "step", "result")


@query("window_counts", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_counts(spark, sf_dir):
    """The batch form of the streaming windows; an extension."""
    from docquill.streaming.windows import by_window

    w = by_window(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# wikis: the documents of a source are the pages of one


def wiki_pages(spark, sf_dir):
    w = F.split("text", r"[\x09-\x0D\x20]+", 3)
    name = F.lower(F.concat_ws("_", w[0], F.coalesce(F.get(w, F.lit(1)), F.lit(""))))
    mention = F.concat(F.lit("\n- see doc_"), (F.col("doc_id") + 20).cast("string"), F.lit(".pdf and [1, 2] or [x](#"), name, F.lit(")"))
    content = F.concat(F.replace("text", F.lit("\n"), F.lit("\n## ")), F.when(F.col("doc_id") % 2 == 0, mention).otherwise(""))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("wiki_id"), F.col("doc_id").alias("page_id"), name.alias("page_name"), content.alias("content"))


def wiki_sources(spark, sf_dir):
    d = owned_documents(spark, sf_dir)
    return d.select(F.col("source").alias("wiki_id"), "filename"), d.select(F.col("source").alias("wiki_id"), F.col("text").alias("content"))


WIKI = r"""wp AS (SELECT source AS wiki_id, doc_id AS page_id, lower(w[1] || '_' || coalesce(w[2], '')) AS page_name, text, doc_id FROM (SELECT *, string_split_regex(text, '[\x09-\x0D\x20]+') AS w FROM documents)),
    pages_ AS (SELECT wiki_id, page_id, page_name, replace(text, chr(10), chr(10) || '## ') || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '- see doc_' || (doc_id + 20) || '.pdf and [1, 2] or [x](#' || page_name || ')' ELSE '' END AS content FROM wp)"""
RATE = "CASE WHEN {s} >= 0.8 THEN 'Excellent' WHEN {s} >= 0.6 THEN 'Good' WHEN {s} >= 0.4 THEN 'Fair' ELSE 'Poor' END"
COHERENCE = f"""coh AS (SELECT wiki_id, coalesce(avg(CASE WHEN len(s) > 1 THEN len(list_filter(s[2:], lambda x: len(list_filter(t, lambda w: contains(lower(x), w))) > 0)) / (len(s) - 1) END), 0) AS average, avg(len(s)) AS sections, count(*) AS pages
    FROM (SELECT wiki_id, string_split(content, chr(10) || '## ') AS s, list_filter(string_split_regex(page_name, '[_\\s]+'), lambda w: w <> '') AS t FROM pages_) GROUP BY 1)"""


@query("wiki_coherence", f"WITH {WIKI}, {COHERENCE} SELECT wiki_id, round(average, 6)::DOUBLE AS average, round(sections, 6) AS sections, pages, {RATE.format(s='average')} AS rating FROM coh")
def wiki_coherence(spark, sf_dir):
    return W.coherence(W.page_measures(wiki_pages(spark, sf_dir))).select("wiki_id", F.round("average", 6).alias("average"), F.round("sections", 6).alias("sections"), "pages", "rating")


LONG = "list_transform(list_filter(string_split_regex({c}, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-zA-ZæøåÆØÅ]{{8,}}$')), lambda w: lower(w))"
COVERAGE = f"""lowered AS (SELECT wiki_id, lower(content) AS content FROM pages_), docs_ AS (SELECT source AS wiki_id, 'doc_' || doc_id || '.pdf' AS f FROM documents),
    dc AS (SELECT wiki_id, count(*) AS documents, count(CASE WHEN EXISTS (SELECT 1 FROM lowered l WHERE l.wiki_id = docs_.wiki_id AND contains(l.content, f)) THEN 1 END) AS referenced FROM docs_ GROUP BY 1),
    terms AS (SELECT DISTINCT source AS wiki_id, unnest({LONG.format(c='text')}[1:5]) AS term FROM documents),
    tc AS (SELECT wiki_id, count(*) AS terms, count(CASE WHEN EXISTS (SELECT 1 FROM lowered l WHERE l.wiki_id = terms.wiki_id AND contains(l.content, term)) THEN 1 END) AS covered FROM terms GROUP BY 1),
    sz AS (SELECT wiki_id, w / (s * 10) AS size_ratio FROM (SELECT wiki_id, sum(length(content)) AS w FROM pages_ GROUP BY 1) JOIN (SELECT source AS wiki_id, sum(length(text)) AS s FROM documents GROUP BY 1) USING (wiki_id)),
    cov AS (SELECT *, referenced / documents AS ds, coalesce(covered / terms, 1) AS ts FROM dc LEFT JOIN tc USING (wiki_id) JOIN sz USING (wiki_id))"""


@query("wiki_coverage", f"WITH {WIKI}, {COVERAGE} SELECT wiki_id, documents, referenced, coalesce(terms, 0) AS terms, coalesce(covered, 0) AS covered, round(size_ratio, 6) AS size_ratio, {RATE.format(s='(ds + ts) / 2')} AS rating FROM cov")
def wiki_coverage(spark, sf_dir):
    return W.coverage(wiki_pages(spark, sf_dir), *wiki_sources(spark, sf_dir)).select("wiki_id", "documents", "referenced", "terms", "covered", F.round("size_ratio", 6).alias("size_ratio"), "rating")


STRUCTURE = """st AS (SELECT wiki_id, avg(CASE WHEN contains(content, chr(10) || '## ') THEN 1.0 ELSE 0 END + CASE WHEN contains(content, chr(10) || '### ') THEN 0.5 ELSE 0 END) AS depth, bool_or(regexp_matches(page_name, 'overview|index|indhold')) AS contents, count(*) AS pages,
    1 - CASE WHEN count(*) > 1 THEN stddev_samp(length(content)) / avg(length(content)) ELSE 1 END AS balance FROM pages_ GROUP BY 1)"""
STRUCTURE_RATE = RATE.format(s="(depth / 1.5 * 0.5 + CASE WHEN contents THEN 0.3 ELSE 0 END + balance * 0.2)")


@query("wiki_structure", f"WITH {WIKI}, {STRUCTURE} SELECT wiki_id, round(depth, 6)::DOUBLE AS depth, contents, pages, round(balance, 6) AS balance, {STRUCTURE_RATE} AS rating FROM st")
def wiki_structure(spark, sf_dir):
    return W.structure(W.page_measures(wiki_pages(spark, sf_dir))).select("wiki_id", F.round("depth", 6).alias("depth"), "contents", "pages", F.round("balance", 6).alias("balance"), "rating")


CITATION = r"""ci AS (SELECT wiki_id, CAST(sum(len(regexp_extract_all(content, '\[[\d,\s]+\]'))) AS BIGINT) AS bracket, CAST(sum(len(regexp_extract_all(content, '\[\^[\d]+\]'))) AS BIGINT) AS footnote, CAST(sum(len(regexp_extract_all(content, '\([^)]*\d{4}[^)]*\)'))) AS BIGINT) AS inline_, count(*) AS pages FROM pages_ GROUP BY 1)"""
CITATION_RATE = RATE.format(s="(least(1, (bracket + footnote + inline_) / pages / 5) * 0.7 + ds * 0.3)")


@query("wiki_citation", f"WITH {WIKI}, {COVERAGE}, {CITATION} SELECT wiki_id, bracket, footnote, inline_ AS inline_citations, {CITATION_RATE} AS rating FROM ci JOIN cov USING (wiki_id)")
def wiki_citation(spark, sf_dir):
    pages = wiki_pages(spark, sf_dir)
    c = W.citations(W.page_measures(pages), W.coverage(pages, *wiki_sources(spark, sf_dir)))
    return c.select("wiki_id", *[F.col(x).cast("long").alias(x) for x in ("bracket", "footnote")], F.col("inline").cast("long").alias("inline_citations"), "rating")


LISTED = lambda names: ", ".join(repr(n) for n in names)
LANGUAGE = rf"""votes AS (SELECT wiki_id, content, len(list_filter(w, lambda x: x IN ({LISTED(DANISH_WORDS)}))) AS da, len(list_filter(w, lambda x: x IN ({LISTED(ENGLISH_WORDS)}))) AS en FROM (SELECT wiki_id, content, ({WORDS.replace('text', 'lower(content)')})[1:200] AS w FROM pages_)),
    voted AS (SELECT wiki_id, CASE WHEN da > en * 2 THEN 'danish' WHEN en > da * 2 THEN 'english' ELSE 'mixed' END AS vote, CASE WHEN contains(content, '## ') OR contains(content, '### ') THEN 1 ELSE 0 END + CASE WHEN contains(content, chr(10) || '- ') OR contains(content, chr(10) || '* ') OR contains(content, chr(10) || '1. ') THEN 1 ELSE 0 END
        + CASE WHEN contains(content, '```') THEN 1 ELSE 0 END + CASE WHEN contains(content, chr(10) || '|') THEN 1 ELSE 0 END AS formats FROM votes),
    tally AS (SELECT wiki_id, count(CASE WHEN vote = 'danish' THEN 1 END) AS da, count(CASE WHEN vote = 'english' THEN 1 END) AS en, count(CASE WHEN vote = 'mixed' THEN 1 END) AS mi, sum(formats) AS formats, count(*) AS pages FROM voted GROUP BY 1),
    la AS (SELECT wiki_id, CASE WHEN da >= en AND da >= mi THEN 'danish' WHEN en >= mi THEN 'english' ELSE 'mixed' END AS prim, greatest(da, en, mi) / pages AS share, formats / (4 * pages) AS formatting FROM tally)"""
LANGUAGE_RATE = RATE.format(s="(share * 0.7 + formatting * 0.3)")


@query("wiki_language", f"WITH {WIKI}, {LANGUAGE} SELECT wiki_id, prim AS \"primary\", round(share, 6) AS share, round(formatting, 6)::DOUBLE AS formatting, {LANGUAGE_RATE} AS rating FROM la")
def wiki_language(spark, sf_dir):
    return W.language(W.page_measures(wiki_pages(spark, sf_dir))).select("wiki_id", "primary", F.round("share", 6).alias("share"), F.round("formatting", 6).alias("formatting"), "rating")


NUMBER = lambda c: f"CASE {c} WHEN 'Excellent' THEN 1.0 WHEN 'Good' THEN 0.75 WHEN 'Fair' THEN 0.5 ELSE 0.25 END"
FAMILIES = (("coherence", 0.25), ("coverage", 0.30), ("structure", 0.20), ("citations", 0.15), ("language", 0.10))
OVERALL = f"""rated AS (SELECT wiki_id, {RATE.format(s='average')} AS coherence, {RATE.format(s='(ds + ts) / 2')} AS coverage, {STRUCTURE_RATE} AS structure, {CITATION_RATE.replace('pages', 'ci.pages')} AS citations, {LANGUAGE_RATE} AS language
    FROM coh JOIN cov USING (wiki_id) JOIN st USING (wiki_id) JOIN ci USING (wiki_id) JOIN la USING (wiki_id)), summed AS (SELECT *, round({' + '.join(f'{NUMBER(c)} * {w}' for c, w in FAMILIES)}, 6)::DOUBLE AS score FROM rated)"""


@query("wiki_overall", f"WITH {WIKI}, {COHERENCE}, {COVERAGE}, {STRUCTURE}, {CITATION}, {LANGUAGE}, {OVERALL} SELECT wiki_id, coherence, coverage, structure, citations, language, score, {RATE.format(s='score')} AS overall FROM summed")
def wiki_overall(spark, sf_dir):
    return W.overall(wiki_pages(spark, sf_dir), *wiki_sources(spark, sf_dir)).select("wiki_id", "coherence", "coverage", "structure", "citations", "language", "score", "overall")


@query("structure_prompt", f"""WITH {CHUNKS}, {OWNED}, s AS (SELECT project_id, 0 AS section, doc_id // 500 AS part, doc_id AS place, '- ' || filename || ' (' || n_chars // 3000 + 1 || ' pages, ' || n_chars || ' bytes)' AS line FROM owned
    UNION ALL SELECT o.project_id, 1, 0, c.run_id, '- Cluster ' || c.run_id || ' (' || count(*) || ' chunks)' FROM chunks c JOIN owned o USING (doc_id) GROUP BY o.project_id, c.run_id)
    SELECT project_id, section, part, count(*) AS n, string_agg(line, chr(10) ORDER BY place) AS lines FROM s GROUP BY 1, 2, 3""")
def structure_prompt(spark, sf_dir):
    """The documents of a project and its clusters, as a prompt lists them: in numbered parts of a bounded size, so that no list is one row however long."""
    d = owned_documents(spark, sf_dir)
    pages = (F.floor(F.col("n_chars") / 3000) + 1).cast("string")
    line = F.concat(F.lit("- "), F.col("filename"), F.lit(" ("), pages, F.lit(" pages, "), F.col("n_chars").cast("string"), F.lit(" bytes)"))
    documents = d.select("project_id", F.lit(0).alias("section"), F.floor(F.col("doc_id") / 500).alias("part"), F.col("doc_id").alias("place"), line.alias("line"))
    c = chunks(spark, sf_dir).select("doc_id", "run_id").join(d.select("doc_id", "project_id"), "doc_id").groupBy("project_id", "run_id").agg(F.count("*").alias("n"))
    clusters = c.select("project_id", F.lit(1).alias("section"), F.lit(0).cast("long").alias("part"), F.col("run_id").cast("long").alias("place"), F.concat(F.lit("- Cluster "), F.col("run_id").cast("string"), F.lit(" ("), F.col("n").cast("string"), F.lit(" chunks)")).alias("line"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
    return documents.unionByName(clusters).groupBy("project_id", "section", "part").agg(F.count("*").alias("n"), lines.alias("lines"))


@query("query_variations", "SELECT item_id AS query_id, kind, CASE WHEN kind = 'original' OR split_part(text, chr(10), -1) = '' THEN text ELSE split_part(text, chr(10), -1) END AS text FROM benchmark, (SELECT unnest(['original', 'semantic', 'hyde', 'formal']) AS kind)")
def query_variations(spark, sf_dir):
    """The original and a row for each of the three rewrites, by a test double that answers with the last line, and the original's text where it has no answer."""
    from docquill.sources import providers as P

    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return P.rewritten(P.query_variants(q, P.REWRITES), [P.EchoTextDouble()]).select("query_id", "kind", "text")


@query("answer_prompt", "SELECT item_id, 'Answer in English, from the excerpts only, and name the document and page of each statement.' || chr(10) || 'Question: ' || substr(text, 1, 50) || chr(10) || 'Excerpts:' || chr(10) || text AS prompt FROM benchmark")
def answer_prompt(spark, sf_dir):
    from docquill.sources import providers as P

    return table(spark, sf_dir, "benchmark").select("item_id", P.answer_prompt(F.substring("text", 1, 50), F.col("text")).alias("prompt"))


@query("model_fallback", "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'no answer' ELSE split_part(text, chr(10), -1) END AS answer FROM benchmark")
def model_fallback(spark, sf_dir):
    """Prompts that no provider answers get the canned text; the provider is a test double."""
    from docquill.sources import providers as P

    p = table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 3 > 0, F.col("text")).alias("prompt"))
    return P.complete(p, [P.EchoTextDouble()], "item_id", "prompt", "no answer")


@query("embed_chunks")
def embed_chunks(spark, sf_dir):
    """Chunk texts through the provider interface with a test double."""
    from docquill.sources import providers as P

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return P.embed(d, P.HashEmbeddingDouble(32)).select("chunk_id", F.size("vector").alias("dims"), F.round(F.get("vector", F.lit(0)).cast("double"), 5).alias("first"))
