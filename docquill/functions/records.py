"""JSON, maps and lists of the application's records, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is kept of an element's metadata and of a page's analysis (fixed values).
METADATA_KEYS = ("page_number", "filename", "image_path", "bbox", "font_size", "font_name", "is_bold", "extraction_method", "processing_strategy", "table_id", "text_as_html")
PAGE_KEYS = ("image_count", "table_count", "meaningful_images", "drawing_items", "has_vector_drawings", "complexity", "needs_extraction", "is_fragmented")
#: Keys under which a storage answer may hold its address, in their order (fixed values).
URL_KEYS = ("signedURL", "signedUrl", "url")


def string_map(json: Column) -> Column:
    """A JSON object as a map of strings; empty where it is null or malformed."""
    return F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>"))


def merged_map(first: Column, second: Column) -> Column:
    """Both maps' entries; of a key in both the second map's."""
    later = F.map_keys(second)
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.array_contains(later, k)), second)


def array_length(json: Column) -> Column:
    """Items of a JSON array; 0 where it is null, malformed or no array."""
    return F.coalesce(F.json_array_length(json), F.lit(0)).cast("long")


def kept_keys(entries: Column, keys: tuple[str, ...] = METADATA_KEYS, nulls: bool = True) -> Column:
    """Of a map only the listed keys, in their order; with ``nulls`` those that are there without a value too."""
    return F.map_filter(entries, lambda k, v: k.isin(*keys) & (F.lit(nulls) | v.isNotNull()))


def page_analysis(entries: Column) -> Column:
    """A struct of all the listed keys of a page's analysis (map), null where one is missing."""
    return F.struct(*[F.try_element_at(entries, F.lit(k)).alias(k) for k in PAGE_KEYS])


def found_url(answer: Column) -> Column:
    """The address in a storage answer: a plain string, or the first of its keys in an object."""
    plain = F.when(~F.ltrim(answer).startswith("{"), answer)
    return F.coalesce(plain, *[F.get_json_object(answer, f"$.{k}") for k in URL_KEYS])


def compact_list(items: Column, longest: int = 5) -> Column:
    """A list of more than ``longest`` items as its count, the first two and the last one; a shorter one as it is, in ``first_items``."""
    n = F.size(items)
    long = n > longest
    return F.struct(
        n.alias("count"), F.when(long, F.slice(items, 1, 2)).otherwise(items).alias("first_items"), F.when(long, F.element_at(items, -1)).alias("last_item"),
        F.when(long, F.concat(n.cast("string"), F.lit(" items (showing 2 first + 1 last)"))).alias("summary"),
    )


def compact_chunks(contents: Column) -> Column:
    """Chunks as their number, total size, mean size and a line that says so."""
    n, total = F.size(contents), F.aggregate(contents, F.lit(0).cast("long"), lambda s, c: s + F.length(F.coalesce(c, F.lit(""))))
    mean = F.when(n > 0, F.floor(total / n)).otherwise(0).cast("long")
    said = F.concat(n.cast("string"), F.lit(" chunks processed, avg size: "), mean.cast("string"), F.lit(" chars"))
    return F.struct(n.alias("count"), total.alias("total_size_chars"), mean.alias("avg_size_chars"), said.alias("summary"))


def compact_text(text: Column, longest: int = 1000, kept: int = 100) -> Column:
    note = F.concat(F.substring(text, 1, kept), F.lit("... [truncated "), F.length(text).cast("string"), F.lit(" chars]"))
    return F.when(F.length(text) > longest, note).otherwise(text)


def sample_list(items: Column, most: int = 2) -> Column:
    """At most ``most`` items and how many more there are."""
    more = F.array(F.concat(F.lit("... and "), (F.size(items) - most).cast("string"), F.lit(" more items")))
    return F.when(F.size(items) > most, F.concat(F.slice(items, 1, most), more)).otherwise(items)


def extracted_text(caption: Column, text: Column, original: Column, narrative: Column, items: Column, html: Column, content_type: Column) -> Column:
    """An element's text: the model's caption, its own text, the original element's, its narrative and list items, its table's markup, or a placeholder for a page image.

    A text of its own counts even if it is empty; a part that is null is not there.
    """
    has, listed = F.coalesce(narrative, F.lit("")) != "", F.coalesce(F.size(items), F.lit(0)) > 0
    lines = F.array_join(items, "\n")
    parts = F.when(has & listed, F.concat(narrative, F.lit("\n\n"), lines)).when(has, narrative).when(listed, lines)
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(filled(caption), text, original, parts, filled(html), F.when(content_type == "full_page_with_images", "[IMAGE PAGE]"), F.lit(""))


def current_step(steps: tuple[str, ...], is_done: dict[str, Column]) -> Column:
    """The first step in order that is not done, or completed."""
    found = F.lit("completed")
    for s in reversed(steps):
        found = F.when(~F.coalesce(is_done[s], F.lit(False)), s).otherwise(found)
    return found


def page_limit(limit: int, offset: int, most: int = 100) -> tuple[int, int]:
    """Limit and offset of a page of results within their bounds."""
    return max(0, min(limit, most)), max(0, offset)


#: States of a checklist result in the order in which they are shown (fixed values).
CHECKLIST_ORDER = ("pending_clarification", "conditions", "risk", "missing", "found")


def checklist_priority(status: Column) -> Column:
    """1 for what needs an answer first, 5 for what was found."""
    return F.array_position(F.array(*[F.lit(s) for s in CHECKLIST_ORDER]), status).cast("int")


def estimated_seconds(step: str, n: Column) -> Column:
    """Seconds that a step will take, by the number of its elements, chunks, pages or results."""
    whole = lambda c: F.floor(c).cast("long")
    tenth = F.floor(n / 10)
    return {
        "metadata": F.greatest(F.lit(10), tenth), "enrichment": F.greatest(n * 12, F.lit(30)), "chunking": F.greatest(F.lit(5), tenth), "embedding": F.greatest(F.lit(1), tenth + 2),
        "clustering": F.greatest(F.lit(60), F.floor(n / 100) * 5 + 30), "markdown": 60 + n * 5, "retrieval": n * 30, "generation": whole(3 + n / 2),
    }[step].cast("long")
