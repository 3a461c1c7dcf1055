"""Text scalars and filters over the elements of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquill.functions import text as T
from docquill.plans.model import ELEMENTS, OWNED, elements, owned_documents, table
from docquill.registry import query

B = r"[\x09-\x0D\x1C-\x20\x85\p{Z}]"
STRIP = rf"regexp_replace(text, '^{B}+|{B}+$', '', 'g')"
WORDS = rf"list_filter(string_split_regex({STRIP}, '{B}+'), lambda w: w <> '')"
W = r"[^\p{L}\p{N}_]"
HAS_NUMBERS = rf"""(regexp_matches(text, '(?i)\d+[.,]?\d*{B}*(?:mm|cm|m|ft|in|inches|″|′|")') OR regexp_matches(text, '\d+[.,]\d+')
    OR regexp_matches(text, '(?:^|{W})[A-Z]{{2,}}{B}*\d+(?:{W}|$)') OR regexp_matches(text, '[A-Z]-?\d+')
    OR len(list_filter(string_split_regex(text, '{W}+'), lambda x: regexp_matches(x, '^\d{{2,}}$'))) >= 2)"""
STARTS = rf"regexp_matches({STRIP}, '^\d+(?:\.\d+)*\.?{B}')"
TITLE = rf"^.{{0,15}}?(\d+(?:\.\d+)*\.?){B}+(.{{3,}})"
TITLE_SQL = rf"""CASE WHEN category NOT IN ('FigureCaption', 'Footer') AND regexp_matches({STRIP}, '{TITLE}') AND strpos({STRIP}, regexp_extract({STRIP}, '{TITLE}', 1)) <= 8
    THEN regexp_extract({STRIP}, '{TITLE}', 1) || ' ' || regexp_replace(regexp_extract({STRIP}, '{TITLE}', 2), '^{B}+|{B}+$', '', 'g') END"""
DIAGRAM = rf"""(regexp_matches(text, '^{B}*[-•*]{B}+') OR regexp_matches(text, '(?i)[a-z]\){B}+') OR len(regexp_extract_all(text, '\d+\.')) >= 2
    OR regexp_matches(lower(text), 'tilbud|licitation|værktøjer|sagsstørrelse|tilstande'))"""
MAJOR = rf"""(category NOT IN ('FigureCaption', 'Footer', 'ListItem') AND {STARTS} AND NOT ends_with({STRIP}, '-') AND NOT ends_with({STRIP}, '..')
    AND NOT {DIAGRAM} AND length({STRIP}) > 10)"""
SMALL = rf"""(regexp_matches(regexp_replace({STRIP}, '[.,]', '', 'g'), '^[0-9]+$') OR regexp_matches({STRIP}, '^[A-Z]{{1,3}}$') OR regexp_matches({STRIP}, '^[0-9]+[A-Z]$')
    OR regexp_matches({STRIP}, '^[A-Z][0-9]+$') OR regexp_matches({STRIP}, '^[IVX]+$'))"""


def _element_scalar(name, column, sql):
    """A query that gives a scalar for every element."""

    @query(name, f"WITH {ELEMENTS} SELECT doc_id, seq, {sql} AS value FROM elements")
    def run(spark, sf_dir):
        return elements(spark, sf_dir).select("doc_id", "seq", column().alias("value"))


COMPLEXITY = rf"""CASE WHEN len({WORDS}) = 0 THEN 'simple' ELSE ['simple', 'medium', 'complex', 'complex'][1
        + CAST(list_sum(list_transform({WORDS}, lambda w: length(regexp_replace(w, '^[.,!?;:]+|[.,!?;:]+$', '', 'g')))) / len({WORDS}) > 6 AS INT)
        + CAST(len({WORDS}) / greatest(len(list_filter(string_split(text, '.'), lambda s: regexp_replace(s, '^{B}+|{B}+$', '', 'g') <> '')), 1) > 20 AS INT)
        + CAST({HAS_NUMBERS} AS INT)] END"""


_element_scalar("has_numbers", lambda: T.has_numbers(F.col("text")), HAS_NUMBERS)
_element_scalar("starts_with_number", lambda: T.starts_with_number(F.col("text")), STARTS)
_element_scalar("numbered_title", lambda: T.numbered_title(F.col("text"), F.col("category")), TITLE_SQL)
_element_scalar("diagram_patterns", lambda: T.has_diagram_patterns(F.col("text")), DIAGRAM)
_element_scalar("is_major_section", lambda: T.is_major_section(F.col("text"), F.col("category")), MAJOR)
_element_scalar("meaningful_small", lambda: T.is_meaningful_small(F.col("text")), SMALL)
_element_scalar("caption_word_count", lambda: T.caption_word_count(F.col("text")).cast("long"), f"len({WORDS})")
_element_scalar("token_estimate", lambda: T.token_estimate(F.col("text")), "CAST(floor(length(text) * 1.8) AS BIGINT)")
_element_scalar("truncate_preview", lambda: T.preview(F.col("text"), 50), "CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END")
_element_scalar("file_hash", lambda: F.sha2(F.col("text").cast("binary"), 256), "sha256(text)")
_element_scalar(
    "text_complexity", lambda: T.text_complexity(F.col("text")),
    COMPLEXITY,
)
_element_scalar(
    "text_category", lambda: T.text_category(F.col("text"), (F.col("seq") % 3 + 11).cast("double")),
    rf"""CASE WHEN length({STRIP}) < 100 AND regexp_matches(text, '\p{{Lu}}') AND seq % 3 + 11 > 12 THEN 'Title'
        WHEN regexp_matches({STRIP}, '^(•|-|\*|1\.|2\.|3\.|a\.|b\.|c\.)') THEN 'ListItem' ELSE 'NarrativeText' END""",
)
_element_scalar(
    "wiki_filename", lambda: T.wiki_filename(F.substring("text", 1, 60)),
    r"regexp_replace(regexp_replace(regexp_replace(substr(text, 1, 60), '[^A-Za-z0-9_\s-]', '', 'g'), '[-\s]+', '_', 'g'), '^_+|_+$', '', 'g')",
)


def _document_scalar(name, column, sql):
    @query(name, f"WITH {OWNED} SELECT doc_id, {sql} AS value FROM owned")
    def run(spark, sf_dir):
        return owned_documents(spark, sf_dir).select("doc_id", column().alias("value"))


def _name():
    return F.concat(F.col("source"), F.when(F.col("doc_id") % 3 == 0, " - ").when(F.col("doc_id") % 3 == 1, "_").otherwise("plan"), F.col("lang"), F.lit("/" ), F.when(F.col("doc_id") % 4 == 0, F.lit(".pdf")).otherwise(F.lit("?.PDF")))
_NAME = "source || CASE doc_id % 3 WHEN 0 THEN ' - ' WHEN 1 THEN '_' ELSE 'plan' END || lang || '/' || CASE WHEN doc_id % 4 = 0 THEN '.pdf' ELSE '?.PDF' END"
_PLAIN = f"replace({_NAME}, '/', '')"


def _plain():
    return F.replace(_name(), F.lit("/"))


_document_scalar("filename_checks", lambda: T.filename_problem(F.when(F.col("doc_id") % 5 == 0, _name()).when(F.col("doc_id") % 5 == 1, F.col("source")).otherwise(_plain())),
    rf"""(SELECT CASE WHEN contains(n, '..') OR contains(n, '/') OR contains(n, '\') THEN 'path' WHEN NOT ends_with(lower(n), '.pdf') THEN 'extension'
        WHEN regexp_matches(n, '[<>:"|?*]') THEN 'special' END FROM (SELECT CASE doc_id % 5 WHEN 0 THEN {_NAME} WHEN 1 THEN source ELSE {_PLAIN} END AS n))""")  # fmt: skip
_document_scalar("project_name", lambda: T.project_name(_plain()),
    f"""(SELECT CASE WHEN contains(n, ' - ') AND length(trim(split_part(n, ' - ', 1))) > 3 THEN upper(substr(trim(split_part(n, ' - ', 1)), 1, 1)) || lower(substr(trim(split_part(n, ' - ', 1)), 2))
        WHEN contains(n, '_') AND length(split_part(n, '_', 1)) > 3 THEN upper(substr(n, 1, 1)) || lower(substr(split_part(n, '_', 1), 2))
        ELSE upper(substr(n, 1, 1)) || lower(substr(split_part(n, '.', 1), 2)) END FROM (SELECT {_PLAIN} AS n))""")  # fmt: skip
_document_scalar("sanitize_filename", lambda: T.sanitized_filename(_plain()),
    rf"""(SELECT regexp_replace(regexp_replace(regexp_replace(left(n, length(n) - 4), '[^A-Za-z0-9_.-]', '_', 'g'), '[_-]*_[_-]*', '_', 'g'), '^[_.-]+|[_.-]+$', '', 'g') || right(n, 4) FROM (SELECT {_PLAIN} AS n))""")
_document_scalar("content_type", lambda: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in (("pdf", "application/pdf"), ("png", "image/png"), ("md", "text/markdown"), ("json", "application/json")) for x in kv]), F.substring_index(_name(), ".", -1)), F.lit("application/octet-stream")),
    f"CASE WHEN split_part({_NAME}, '.', 2) = 'pdf' THEN 'application/pdf' ELSE 'application/octet-stream' END")
_document_scalar("language_vote", lambda: T.language_vote(F.col("text")),
    rf"""(SELECT CASE WHEN da > en * 2 THEN 'danish' WHEN en > da * 2 THEN 'english' ELSE 'mixed' END FROM (SELECT
        len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in T.DANISH_WORDS)}))) AS da, len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in T.ENGLISH_WORDS)}))) AS en
        FROM (SELECT ({WORDS.replace('text', 'lower(text)')})[1:200] AS w)))""")  # fmt: skip
_document_scalar("table_hint", lambda: T.likely_table(F.replace("text", F.lit(" | "), F.lit("  |  "))),
    """(SELECT length(t) > 100 AND (regexp_matches(s, '  \\|  |\\t\\t|│|─|┌|├') OR (length(s) - length(replace(s, '  ', ''))) / 2 > 10)
        FROM (SELECT replace(text, ' | ', '  |  ') AS t, substr(replace(text, ' | ', '  |  '), 1, 1000) AS s))""")  # fmt: skip


@query("security_scan", """SELECT page_id, array_to_string(list_filter(['/EmbeddedFile', '/OpenAction', '/SubmitForm', '/ImportData'], lambda p: contains(html, p)), ',') AS critical,
    array_to_string(list_filter(['/JavaScript', '/JS', '/Launch', '/AA', '/URI'], lambda p: contains(html, p)), ',') AS warning FROM pages""")
def security_scan(spark, sf_dir):
    found = lambda p: F.array_join(T.patterns_found(F.col("html"), p), ",")
    return table(spark, sf_dir, "pages").select("page_id", found(T.CRITICAL_PATTERNS).alias("critical"), found(T.WARNING_PATTERNS).alias("warning"))


@query("toc_extract", r"""WITH md AS (SELECT page_id, unnest(list_filter(string_split(regexp_replace(html, '<h([1-6])[^>]*>([^<\n]*)', chr(10) || '#\1 \2' || chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '^#[1-6] .+$'))) AS line FROM pages)
    SELECT page_id, CAST(substr(line, 2, 1) AS INT) AS level, substr(line, 4) AS title,
        regexp_replace(regexp_replace(regexp_replace(lower(substr(line, 4)), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g') AS slug FROM md""")
def toc_extract(spark, sf_dir):
    """Headings of the pages, by way of Markdown."""
    marked = F.regexp_replace("html", r"<h([1-6])[^>]*>([^<\n]*)", "\n#$1 $2\n")
    for level in range(6, 0, -1):
        marked = F.regexp_replace(marked, rf"\n#{level} ", "\n" + "#" * level + " ")
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(T.headings(marked)).alias("h"))
    return found.select("page_id", "h.level", "h.title", "h.slug")


@query("filter_text_elements", rf"""WITH {ELEMENTS}, t AS (SELECT doc_id, seq, page, category, {STRIP} AS trimmed, {SMALL} AS small FROM elements)
    SELECT doc_id, seq, page, category, trimmed AS text FROM t
    WHERE (length(trimmed) >= 10 OR small) AND NOT (NOT regexp_matches(trimmed, '^[\p{{L}}\p{{N}}]+$') AND length(trimmed) < 5)""")
def filter_text_elements(spark, sf_dir):
    e = elements(spark, sf_dir).withColumn("text", T.strip(F.col("text")))
    short = F.length("text") < 10
    odd = ~F.col("text").rlike(r"^[\p{L}\p{N}]+$") & (F.length("text") < 5)
    return e.where((~short | T.is_meaningful_small(F.col("text"))) & ~odd)


@query("noise_filter", rf"""WITH {ELEMENTS} SELECT category, CASE WHEN category IN ('Header', 'Footer', 'PageBreak', 'Title') THEN 'category'
        WHEN category = 'UncategorizedText' AND length({STRIP}) < 20 THEN 'short' ELSE 'kept' END AS reason, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM elements GROUP BY ALL""")
def noise_filter(spark, sf_dir):
    from docquill.operators.chunking import noise_reason

    e = elements(spark, sf_dir).withColumn("reason", noise_reason(F.col("category"), F.col("text")))
    return e.groupBy("category", "reason").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))


@query("query_validation", """SELECT conv_id, turn, trim(text) AS query_text FROM conversations WHERE role = 'user' AND length(trim(text)) BETWEEN 1 AND 1000""")
def query_validation(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.trim("text").alias("query_text"))
    return c.where(F.length("query_text").between(1, 1000))


@query("scan_html", r"""SELECT page_id, CAST(length(html) AS BIGINT) AS html_chars, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages""")
def scan_html(spark, sf_dir):
    from docquill.sources.html import visible_text

    return table(spark, sf_dir, "pages").select("page_id", F.length("html").cast("long").alias("html_chars"), visible_text(F.col("html")).alias("text"))


REPETITION = rf"""w AS (SELECT doc_id, length(text) AS chars, {WORDS} AS w FROM documents),
    g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, len(w) - 4 AS last, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS gram FROM w),
    c AS (SELECT doc_id, gram, any_value(mid) AS mid, count(CASE WHEN i < last THEN 1 END) AS n FROM (SELECT *, array_to_string(string_split(gram, ' ')[2:4], ' ') AS mid FROM g) GROUP BY doc_id, gram),
    often AS (SELECT doc_id, mid FROM (SELECT doc_id, array_to_string(string_split(gram, ' ')[2:4], ' ') AS mid FROM g) GROUP BY ALL HAVING count(*) > 2),
    r AS (SELECT doc_id, sum(n) AS many FROM (SELECT c.doc_id, c.n FROM c JOIN often USING (doc_id, mid) JOIN (SELECT doc_id, text FROM documents) d ON d.doc_id = c.doc_id WHERE (length(d.text) - length(replace(d.text, gram, ''))) / length(gram) > 2) GROUP BY doc_id),
    scores AS (SELECT w.doc_id, CASE WHEN chars < 100 OR len(w) = 0 THEN 0.0 ELSE round((1 - len(list_distinct(w)) / len(w)) * 0.7 + least(1.0, coalesce(many, 0) / 10) * 0.3, 6) END AS value
    FROM w LEFT JOIN r ON r.doc_id = w.doc_id)"""


@query("repetition_score", f"WITH {REPETITION} SELECT doc_id, value FROM scores")
def repetition_score(spark, sf_dir):
    from docquill.operators.validation import repetition_scores

    return repetition_scores(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.round("score", 6).alias("value"))
