"""Quality of generated wikis, by wiki: coherence, coverage, structure, citations, language, and their weighted sum.

Pages: wiki_id, page_id, page_name, content. Every family is an aggregate of the pages' measures (:func:`page_measures`).
"""

from __future__ import annotations

from functools import reduce

import ahocorasick
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquill.functions.text import language_vote
from docquill.scratch import materialize

#: Weights of the families and numbers of the ratings (fixed values).
WEIGHTS = {"coherence": 0.25, "coverage": 0.30, "structure": 0.20, "citations": 0.15, "language": 0.10}
RATINGS = (("Excellent", 0.8, 1.0), ("Good", 0.6, 0.75), ("Fair", 0.4, 0.5))

#: Characters of pages and patterns that one task looks through.
PAGE_CHARS, PATTERNS = 1 << 24, 100_000


def rating(score: Column) -> Column:
    out = F.lit("Poor")
    for name, least, _ in reversed(RATINGS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def rating_number(label: Column) -> Column:
    out = F.lit(0.25)
    for name, _, number in RATINGS:
        out = F.when(label == name, number).otherwise(out)
    return out


LONG_WORD = r"(?<![\p{L}\p{N}_])([a-zA-ZæøåÆØÅ]{8,})(?![\p{L}\p{N}_])"


def long_words(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(LONG_WORD), F.lit(1)), F.lower)


def page_measures(pages: DataFrame) -> DataFrame:
    """What the families of measures need of each page (wiki_id, page_name, content), without its content; columns that are not used are not worked out."""
    c, n = F.col("content"), F.length("content")
    sections = F.split("content", "\n## ", -1)
    title = F.filter(F.split(F.lower("page_name"), r"[_\s]+"), lambda w: w != "")
    body = F.slice(sections, 2, F.greatest(F.size(sections) - 1, F.lit(0)))
    relevant = F.size(F.filter(body, lambda s: F.exists(title, lambda w: F.contains(F.lower(s), w))))
    found = lambda p: F.regexp_count("content", F.lit(p))
    return pages.select(
        "wiki_id", "page_name", F.size(sections).alias("sections"), F.when(F.size(sections) > 1, relevant / (F.size(sections) - 1)).alias("share"),
        F.regexp_extract_all("content", F.lit(r"\[[^\]]+\]\(#([^\)]+)\)"), F.lit(1)).alias("links"),
        (F.when(c.contains("\n## "), 1.0).otherwise(0.0) + F.when(c.contains("\n### "), 0.5).otherwise(0.0)).alias("depth"), n.alias("length"),
        found(r"\[[\d,\s]+\]").alias("bracket"), found(r"\[\^[\d]+\]").alias("footnote"), found(r"\([^)]*\d{4}[^)]*\)").alias("inline"), language_vote(c).alias("vote"),
        (c.contains("## ") | c.contains("### ")).alias("headers"), (c.contains("\n- ") | c.contains("\n* ") | c.contains("\n1. ")).alias("lists"), c.contains("```").alias("code"), c.contains("\n|").alias("tables"),
    )


def coherence(measures: DataFrame) -> DataFrame:
    """The mean share of a page's sections that have a word of its title; links to pages that exist and that do not."""
    scored = measures.groupBy("wiki_id").agg(F.coalesce(F.avg("share"), F.lit(0.0)).alias("average"), F.avg("sections").alias("sections"), F.count("*").alias("pages"))
    links = measures.select("wiki_id", F.explode("links").alias("page_name"))
    names = measures.select("wiki_id", "page_name").distinct().withColumn("known", F.lit(True))
    found = links.join(names, ["wiki_id", "page_name"], "left").groupBy("wiki_id").agg(F.count("known").alias("references"), F.count_if(F.col("known").isNull()).alias("broken"))
    both = scored.join(found, "wiki_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("references", "broken")})
    return both.withColumn("rating", rating(F.col("average")))


#: What parts the words of a page: ASCII that is no letter, digit, ``_``, ``.`` or ``-``. Patterns of these that begin and end with something else lie within one word.
APART, EDGE = r"[\x00-,/:-@\[-^`{-\x7f]+", "_.-"
WITHIN = r"(?s)^(?![_.\-])[^\x00-,/:-@\[-^`{-\x7f]+(?<![_.\-])$"


def page_words(pages: DataFrame, least: int) -> DataFrame:
    """(wiki_id, content) of the distinct words of ``least`` characters or more in the lower-cased contents of a wiki; those of a batch are reduced before the shuffle."""
    kind = pages.schema["wiki_id"].dataType

    def run(batches):
        for batch in batches:
            words = pc.split_pattern_regex(batch.column("content"), APART)
            flat, owner = pc.utf8_trim(words.flatten(), characters=EDGE), pc.list_parent_indices(words)
            long = pc.greater_equal(pc.utf8_length(flat), max(1, least))
            found = pa.table({"wiki_id": batch.column("wiki_id").take(owner.filter(long)), "content": flat.filter(long)})
            yield from found.group_by(["wiki_id", "content"]).aggregate([]).select(["wiki_id", "content"]).to_batches()

    text = pages.select("wiki_id", F.lower("content").alias("content")).where("content <> ''")
    return text.mapInArrow(run, f"wiki_id {kind.simpleString()}, content string").distinct()


def mentioned(pages: DataFrame, patterns: DataFrame, page_chars: int = PAGE_CHARS, block: int = PATTERNS) -> DataFrame:
    """The (wiki_id, pattern) of ``patterns`` that occur in the lower-cased content of a page of the wiki, in any place of it.

    A pattern that is a whole word of a page is found by a join with the wiki's
    distinct words. Of the others, those that can only lie within a word are
    searched for in these words, and those with spaces and the like in the pages.
    So what every block of patterns reads is left to patterns that no page has as
    a word.
    """
    asked = patterns.where("pattern <> ''")
    least = asked.agg(F.coalesce(F.min(F.length("pattern")), F.lit(1))).first()[0]
    words = materialize(page_words(pages, least), "page-words")
    whole = words.select("wiki_id", F.col("content").alias("pattern"), F.lit(True).alias("whole"))
    asked = materialize(asked.join(whole, ["wiki_id", "pattern"], "left").withColumn("inner", F.col("pattern").rlike(WITHIN)), "asked-patterns")
    found = [asked.where("whole"), searched(words, asked.where("whole IS NULL AND inner").select("wiki_id", "pattern"), page_chars, block, True)]
    others = asked.where("whole IS NULL AND NOT inner").select("wiki_id", "pattern")
    if not others.isEmpty():
        found.append(searched(pages.select("wiki_id", F.lower("content").alias("content")), others, page_chars, block))
    return reduce(DataFrame.unionByName, [df.select("wiki_id", "pattern") for df in found]).distinct()


def searched(texts: DataFrame, patterns: DataFrame, page_chars: int = PAGE_CHARS, block: int = PATTERNS, lines: bool = False) -> DataFrame:
    """The (wiki_id, pattern) of ``patterns`` that occur in a content of ``texts`` (wiki_id, content), in any place of it. With ``lines`` no pattern holds a line break, and contents are read together.

    The patterns of a wiki become automata of up to about ``block`` of them, each
    reading every text once; the texts go in blocks of about ``page_chars``
    characters, so that a task has a bounded part of a wiki of any size.
    """
    sizes = texts.groupBy("wiki_id").agg(F.ceil(F.sum(F.length("content").cast("long")) / page_chars).alias("parts"))
    sizes = sizes.join(patterns.groupBy("wiki_id").agg(F.ceil(F.count("*") / block).alias("blocks")), "wiki_id")
    in_part = F.pmod(F.xxhash64("content"), F.greatest("parts", F.lit(1)))
    p = texts.where("content <> ''").join(sizes, "wiki_id").select("wiki_id", in_part.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "content")
    w = patterns.join(sizes, "wiki_id").select("wiki_id", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("parts", F.lit(1)) - 1)).alias("part"), F.pmod(F.xxhash64("pattern"), F.col("blocks")).alias("block"), "pattern")

    def find(contents: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        found: set[str] = set()
        if len(contents) and len(words):
            automaton = ahocorasick.Automaton()
            for word in words["pattern"]:
                automaton.add_word(word, word)
            automaton.make_automaton()
            for content in ["\n".join(contents["content"])] if lines else contents["content"]:
                found.update(word for _, word in automaton.iter(content))
        return pd.DataFrame({"wiki_id": [words["wiki_id"].iloc[0]] * len(found) if found else [], "pattern": sorted(found)}, dtype=object)

    keys = ["wiki_id", "part", "block"]
    kind = texts.schema["wiki_id"].dataType.simpleString()
    return p.groupBy(*keys).cogroup(w.groupBy(*keys)).applyInPandas(find, f"wiki_id {kind}, pattern string").distinct()


def coverage(pages: DataFrame, documents: DataFrame, chunks: DataFrame, per_chunk: int = 5) -> DataFrame:
    """Shares of documents (wiki_id, filename) that pages name, and of long words of chunks (wiki_id, content) that pages have, in any place of a page; and the pages' characters to ten times the chunks'."""
    docs = documents.select("wiki_id", F.lower("filename").alias("pattern"), F.lit(True).alias("named")).distinct()
    terms = chunks.select("wiki_id", F.explode(F.slice(long_words(F.col("content")), 1, per_chunk)).alias("pattern"), F.lit(False).alias("named")).distinct()
    asked = materialize(docs.unionByName(terms), "coverage-patterns")
    seen = mentioned(pages, asked.select("wiki_id", "pattern").distinct()).withColumn("seen", F.lit(True))
    count = lambda named, what: F.count(F.when(F.col("named") == named, F.col(what)))
    both = asked.join(seen, ["wiki_id", "pattern"], "left").groupBy("wiki_id").agg(
        count(True, "pattern").alias("documents"), count(True, "seen").alias("referenced"), count(False, "pattern").alias("terms"), count(False, "seen").alias("covered"),
    ).where("documents > 0")
    chars = lambda df, name: df.groupBy("wiki_id").agg(F.sum(F.coalesce(F.length("content"), F.lit(0)).cast("long")).alias(name))
    both = both.join(chars(pages, "wiki_chars"), "wiki_id", "left").join(chars(chunks, "source_chars"), "wiki_id", "left")
    ratio = F.coalesce(F.try_divide(F.coalesce("wiki_chars", F.lit(0)), F.when(F.col("source_chars") > 0, F.col("source_chars") * 10).otherwise(F.col("wiki_chars") * 5)), F.lit(0.0))
    both = both.withColumns({"document_share": F.col("referenced") / F.col("documents"), "term_share": F.coalesce(F.try_divide("covered", "terms"), F.lit(1.0)), "size_ratio": ratio})
    return both.withColumn("rating", rating((F.col("document_share") + F.col("term_share")) / 2))


def structure(measures: DataFrame) -> DataFrame:
    """Mean depth of headings, a contents page, and how even the pages' lengths are."""
    low, n = F.lower("page_name"), F.col("length")
    g = measures.groupBy("wiki_id").agg(
        F.avg("depth").alias("depth"), F.bool_or(low.contains("overview") | low.contains("index") | low.contains("indhold")).alias("contents"), F.count("*").alias("pages"),
        (1 - F.when((F.count("*") > 1) & (F.avg(n) > 0), F.stddev_samp(n) / F.avg(n)).otherwise(1.0)).alias("balance"), F.min(n).alias("shortest"), F.max(n).alias("longest"),
    )
    return g.withColumn("rating", rating(F.col("depth") / 1.5 * 0.5 + F.when(F.col("contents"), 0.3).otherwise(0.0) + F.col("balance") * 0.2))


def citations(measures: DataFrame, covered: DataFrame) -> DataFrame:
    """Citations by form, per page, and the share of documents (of :func:`coverage`) that are named."""
    g = measures.groupBy("wiki_id").agg(*[F.sum(c).alias(c) for c in ("bracket", "footnote", "inline")], F.count("*").alias("pages"))
    g = g.join(covered.select("wiki_id", "document_share"), "wiki_id", "left").withColumn("total", F.col("bracket") + F.col("footnote") + F.col("inline"))
    most = F.greatest("bracket", "footnote", "inline")
    style = F.when(F.col("total") == 0, "none").when(F.col("bracket") == most, "bracket").when(F.col("footnote") == most, "footnote").otherwise("inline")
    share = F.coalesce("document_share", F.lit(0.0))
    return g.withColumn("style", style).withColumn("rating", rating(F.least(F.lit(1.0), F.col("total") / F.col("pages") / 5) * 0.7 + share * 0.3))


def language(measures: DataFrame) -> DataFrame:
    """The language of most pages, its share, and the mean share of pages with each kind of formatting."""
    g = measures.groupBy("wiki_id").agg(*[F.count_if(F.col("vote") == x).alias(x) for x in ("danish", "english", "mixed")], *[F.count_if(F.col(k)).alias(k) for k in ("headers", "lists", "code", "tables")], F.count("*").alias("pages"))
    most = F.greatest("danish", "english", "mixed")
    primary = F.when(F.col("danish") == most, "danish").when(F.col("english") == most, "english").otherwise("mixed")
    g = g.withColumns({"primary": primary, "share": most / F.col("pages"), "formatting": (F.col("headers") + F.col("lists") + F.col("code") + F.col("tables")) / (4 * F.col("pages"))})
    return g.withColumn("rating", rating(F.col("share") * 0.7 + F.col("formatting") * 0.3))


def overall(pages: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """The weighted sum of the families' ratings, each as its number. Pages are read once; their measures are written and shared by the families."""
    measures = materialize(page_measures(pages), "page-measures")
    covered = materialize(coverage(pages, documents, chunks), "coverage")
    families = {"coherence": coherence(measures), "coverage": covered, "structure": structure(measures), "citations": citations(measures, covered), "language": language(measures)}
    joined = None
    for name, df in families.items():
        one = df.select("wiki_id", F.col("rating").alias(name))
        joined = one if joined is None else joined.join(one, "wiki_id")
    total = sum((rating_number(F.col(k)) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return joined.withColumn("score", F.round(total, 6)).withColumn("overall", rating(F.col("score")))


def validated_structure(pages: Column) -> Column:
    """Pages of a planned wiki with defaults, and an overview page first if none is called so."""
    whole = F.transform(pages, lambda p, i: F.struct(
        F.coalesce(p["id"], F.concat(F.lit("page-"), (i + 1).cast("string"))).alias("id"), F.coalesce(p["title"], F.concat(F.lit("Page "), (i + 1).cast("string"))).alias("title"),
        F.coalesce(p["score"], F.lit(5)).alias("score")))
    overview = F.array(F.struct(F.lit("page-1").alias("id"), F.lit("Project Overview").alias("title"), F.lit(10).alias("score")))
    named = F.exists(whole, lambda p: F.lower(p["title"]).rlike("overview|oversigt"))
    return F.when(named, whole).otherwise(F.concat(overview, whole))


