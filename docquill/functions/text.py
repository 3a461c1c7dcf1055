"""Text scalars as Column functions; they run in the JVM, but for names that are not ASCII."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What Unicode counts as white space, for Java and for RE2.
BLANK = r"[\x09-\x0D\x1C-\x20\x85\p{Z}]"

#: Units of length after a number, any case (fixed values).
MEASUREMENT = r"(?i)\d+[.,]?\d*" + BLANK + r"*(?:mm|cm|m|ft|in|inches|″|′|\")"
#: Words of Danish tender documents that mark diagrams (fixed values).
DIAGRAM_WORDS = ("tilbud", "licitation", "værktøjer", "sagsstørrelse", "tilstande")
#: Stop words of the language vote (fixed values).
DANISH_WORDS = ("og", "er", "af", "til", "på", "med", "for", "som", "har", "kan", "skal", "være", "denne", "deres")
ENGLISH_WORDS = ("the", "and", "is", "of", "to", "in", "with", "for", "that", "has", "can", "be", "this", "their")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def words(c: Column) -> Column:
    """The words between white space; none for a blank text."""
    return F.filter(F.split(strip(c), BLANK + "+"), lambda w: w != "")


def starts_with_number(c: Column) -> Column:
    return strip(c).rlike(r"^\d+(?:\.\d+)*\.?" + BLANK)


def numbered_title(c: Column, category: Column) -> Column:
    """``number text`` where a section number stands within the first eight characters; null for captions and footers."""
    t = strip(c)
    pattern = r"^.{0,15}?(\d+(?:\.\d+)*\.?)" + BLANK + r"+(.{3,})"
    number = F.regexp_extract(t, pattern, 1)
    rest = F.regexp_extract(t, pattern, 2)
    found = t.rlike(pattern) & ~category.isin("FigureCaption", "Footer") & (F.position(number, t) <= 8)
    return F.when(found, F.concat(number, F.lit(" "), strip(rest)))


def has_diagram_patterns(c: Column) -> Column:
    low = F.lower(c)
    keyword = low.contains(DIAGRAM_WORDS[0])
    for w in DIAGRAM_WORDS[1:]:
        keyword = keyword | low.contains(w)
    return c.rlike("^" + BLANK + "*[-•*]" + BLANK + "+") | c.rlike(r"(?i)[a-z]\)" + BLANK + "+") | (F.regexp_count(c, F.lit(r"\d+\.")) >= 2) | keyword


def is_major_section(c: Column, category: Column) -> Column:
    """A numbered heading that is long enough, not cut off and not part of a diagram or list."""
    t = strip(c)
    long_heading = t.rlike(r"(?i)^.{0,15}?(\d+(?:\.\d+)?\.?)" + BLANK + r"+([A-ZÆØÅæøå].{10,})")
    return ~category.isin("FigureCaption", "Footer", "ListItem") & starts_with_number(c) & ~t.endswith("-") & ~t.endswith("..") & ~has_diagram_patterns(t) & (long_heading | (F.length(t) > 10))


def has_numbers(c: Column) -> Column:
    """Measurements, decimals, codes, or two whole numbers of two digits or more; a text without a digit has none."""
    return c.rlike("[0-9]") & (
        c.rlike(r"\d+[.,]\d+") | c.rlike(r"[A-Z]-?\d+") | c.rlike(r"(?<![\p{L}\p{N}_])[A-Z]{2,}" + BLANK + r"*\d+(?![\p{L}\p{N}_])")
        | (F.regexp_count(c, F.lit(r"(?<![\p{L}\p{N}_])\d{2,}(?![\p{L}\p{N}_])")) >= 2) | c.rlike(MEASUREMENT)
    )


def text_complexity(c: Column) -> Column:
    """Long words, long sentences, numbers: two of them make a text complex, one medium. Counted on the text as it is, without splitting it."""
    inner = BLANK[1:-1]
    n = F.regexp_count(c, F.lit(f"[^{inner}]+"))
    # what is left without white space and without the marks at the ends of words
    letters = F.length(F.regexp_replace(c, f"(?:^|{BLANK}+)[.,!?;:]*|[.,!?;:]+(?={BLANK}|$)", ""))
    sentences = F.regexp_count(c, F.lit(f"[^.{inner}][^.]*"))
    score = (letters / n > 6).cast("int") + (n / F.greatest(sentences, F.lit(1)) > 20).cast("int") + has_numbers(c).cast("int")
    return F.when(n == 0, "simple").when(score >= 2, "complex").when(score == 1, "medium").otherwise("simple")


def is_meaningful_small(c: Column) -> Column:
    """Numbers, short codes and Roman numerals, which stay however short."""
    t = strip(c)
    return F.regexp_replace(t, "[.,]", "").rlike("^[0-9]+$") | t.rlike("^[A-Z]{1,3}$") | t.rlike("^[0-9]+[A-Z]$") | t.rlike("^[A-Z][0-9]+$") | t.rlike("^[IVX]+$")


def text_category(c: Column, font_size: Column) -> Column:
    t = strip(c)
    item = t.rlike(r"^(•|-|\*|1\.|2\.|3\.|a\.|b\.|c\.)")
    return F.when((F.length(t) < 100) & c.rlike(r"\p{Lu}") & (font_size > 12), "Title").when(item, "ListItem").otherwise("NarrativeText")


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) * F.lit(1.8).cast("decimal(2,1)")).cast("long")


def caption_word_count(c: Column) -> Column:
    return F.size(words(c))


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def wiki_filename(title: Column) -> Column:
    kept = F.regexp_replace(title, r"[^A-Za-z0-9_\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[-\s]+", "_"), "^_+|_+$", "")


@F.pandas_udf(StringType())
def _decomposed(names: pd.Series) -> pd.Series:
    """The ASCII part of the compatible decomposition, for the few names that have other characters."""
    return names.map(lambda n: unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode("ascii"), na_action="ignore")


def sanitized_filename(name: Column, longest: int = 200) -> Column:
    """A storage-safe file name. Characters outside ASCII are decomposed, and what is left of them outside ASCII goes."""
    ext = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    s = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    s = F.coalesce(_decomposed(F.when(s.rlike(r"[^\x00-\x7F]"), s)), s)
    # what is replaced, in this order (fixed values)
    for pattern, by in (("_{2,}", "_"), ("-{2,}", "-"), (r"\s+", "_"), (r'[<>:"/\\|?*]', "_"), (r"[\x00-\x1f\x7f]", ""), (r"[^A-Za-z0-9_.-]", "_"), ("[_-]*_[_-]*", "_"), ("-{2,}", "-"), (r"^[_.-]+|[_.-]+$", "")):
        s = F.regexp_replace(s, pattern, by)
    s = F.when(s == "", "file").otherwise(s)
    cut = F.when(F.length(s) + F.length(ext) > longest, F.substring(s, F.lit(1), longest - F.length(ext) - 3)).otherwise(s)
    return F.when(name == "", "unnamed_file").otherwise(F.concat(cut, ext))


def project_name(filename: Column) -> Column:
    """The first part of over three characters before a separator, in title case; else up to 30 characters of the name."""
    result = F.when(F.length(filename) > 30, F.concat(strip(F.substring(filename, 1, 30)), F.lit("..."))).otherwise(strip(F.regexp_replace(filename, r"\.pdf|\.PDF", "")))
    for separator in (" ", ".", "-", "_", " - "):
        part = strip(F.substring_index(filename, separator, 1))
        result = F.when(filename.contains(separator) & (F.length(part) > 3), F.initcap(F.lower(part))).otherwise(result)
    return result


def headings(markdown: Column) -> Column:
    """(level, title, slug) of each heading line."""
    lines = F.filter(F.split(markdown, "\n", -1), lambda x: x.rlike(r"^#{1,6}\s+.+$"))
    title = lambda x: F.regexp_extract(x, r"^#{1,6}\s+(.+)$", 1)
    slug = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^a-z0-9\s-]", ""), r"\s+", "-"), "-+", "-")
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_extract(x, "^(#{1,6})", 1)).alias("level"), title(x).alias("title"), slug(title(x)).alias("slug")))


def language_vote(c: Column, first: int = 200) -> Column:
    w = F.slice(words(F.lower(c)), 1, first)
    votes = lambda known: F.size(F.filter(w, lambda x: x.isin(*known)))
    da, en = votes(DANISH_WORDS), votes(ENGLISH_WORDS)
    return F.when(da > en * 2, "danish").when(en > da * 2, "english").otherwise("mixed")


def filename_problem(name: Column) -> Column:
    """path, extension, special, or null if there is none."""
    return (
        F.when(name.contains("..") | name.contains("/") | name.contains("\\"), "path")
        .when(~F.lower(name).endswith(".pdf"), "extension").when(name.rlike(r'[<>:"|?*]'), "special")
    )


def likely_table(c: Column) -> Column:
    sample = F.substring(c, 1, 1000)
    marks = sample.contains("  |  ") | sample.contains("\t\t")
    for m in "│─┌├":
        marks = marks | sample.contains(m)
    doubles = (F.length(sample) - F.length(F.replace(sample, F.lit("  "), F.lit("")))) / 2
    return (F.length(c) > 100) & (marks | (doubles > 10))


#: Byte patterns of risky documents (fixed values): the first reject, the others warn.
CRITICAL_PATTERNS = ("/EmbeddedFile", "/OpenAction", "/SubmitForm", "/ImportData")
WARNING_PATTERNS = ("/JavaScript", "/JS", "/Launch", "/AA", "/URI")


def patterns_found(content: Column, patterns: tuple[str, ...]) -> Column:
    """The patterns that occur, in their order."""
    return F.filter(F.array(*[F.lit(p) for p in patterns]), lambda p: F.contains(content, p))
