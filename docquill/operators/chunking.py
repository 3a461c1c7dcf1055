"""From elements to chunks: filter, group lists, merge small ones, compose, split.

All order-sensitive steps work on running values over (doc_id, seq), which
split documents that are too large for a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquill.functions.text import strip
from docquill.operators.elements import inherit_sections
from docquill.operators.segments import SEGMENT_BITS, by_segment, parted, running
from docquill.scratch import materialize

#: Effective sizes (fixed values): items in a list group, least composed size, most before a split, size and overlap of pieces, least text of an uncategorised element.
LIST_ITEMS, SMALL, LARGE, PIECE, OVERLAP, LEAST_TEXT = 10, 100, 1500, 1000, 200, 20


def noise_reason(category: Column, text: Column) -> Column:
    """category or short for what the noise filter drops, else kept."""
    return (
        F.when(category.isin("Header", "Footer", "PageBreak", "Title"), "category")
        .when((category == "UncategorizedText") & (F.length(strip(text)) < LEAST_TEXT), "short").otherwise("kept")
    )


def filter_noise(elements: DataFrame) -> DataFrame:
    return elements.where(noise_reason(F.col("category"), F.col("text")) == "kept")


def group_lists(elements: DataFrame, most: int = LIST_ITEMS, big: DataFrame | None = None) -> DataFrame:
    """A narrative element and up to ``most`` list items right after it become one List element; the rest stays as it is.

    Rows: doc_id, seq, page, category, text; seq is that of the narrative. ``big``
    has the documents that are too large for a task (:mod:`segments`).
    """
    item = F.coalesce(F.col("category") == "ListItem", F.lit(False))
    head = F.when(~item, F.struct("__n", "seq", "category"))  # the last element that is no item
    e = running(elements, ["doc_id"], ["seq"], big, "__n", {"__head": head})
    member = item & (F.col("__head.category") == "NarrativeText") & (F.col("__n") - F.col("__head.__n") <= most)
    # an element that is in no group is a group of its own, so that one pass makes both
    at = F.when(member, F.col("__head.seq")).otherwise(F.col("seq"))
    m = e.groupBy("doc_id", at.alias("seq")).agg(F.sort_array(F.collect_list(F.struct("seq", "page", "category", "text"))).alias("m"))
    first, items, grouped = F.col("m")[0], F.array_join(F.transform(F.slice("m", 2, most), lambda x: x["text"]), "\n"), F.size("m") > 1
    return m.select(
        "doc_id", "seq", first["page"].alias("page"), F.when(grouped, "List").otherwise(first["category"]).alias("category"),
        F.when(grouped, F.concat(first["text"], F.lit("\n\n"), items)).otherwise(first["text"]).alias("text"),
    )


def in_section(content: Column, section: Column | None, word: str = "Section") -> Column:
    """The content below its section's title, where titles are wanted."""
    return content if section is None else F.concat(F.lit(f"{word}: "), F.coalesce(section, F.lit("Unknown Section")), F.lit("\n\n"), content)


def composed(category: Column, text: Column, element_type: Column | None = None, section: Column | None = None, context: bool = True) -> Column:
    """The content of a chunk by category and type of element.

    With ``section`` the inherited title stands first: as ``Context:`` of tables,
    images and references, as ``Section:`` of lists, narrative and uncategorised
    text and of what was merged; other categories stay as they are. Without
    ``context`` tables and images are their text alone.
    """
    kind = F.lit("text") if element_type is None else element_type
    mentions = F.lower(text).rlike("tabel|table|figur|figure")
    typed = lambda name, label: in_section(F.concat(F.lit(f"Type: {name}\n\n{label}: "), text), section, "Context")
    return (
        F.when(category.isin("List", "NarrativeText", "MergedContent"), in_section(F.when(text == "", "[Empty list]").otherwise(text) if section is not None else text, section))
        .when((kind == "table") | (category == "Table"), typed("Table", "Summary") if context else text)
        .when((kind == "full_page_image") | (category == "Image"), typed("Image", "Summary") if context else text)
        .when(category == "ListItem", in_section(text, section))
        .when(category == "UncategorizedText", F.when(mentions, typed("Reference", "Content")).otherwise(in_section(text, section))).otherwise(text)
    )


def merge_small(elements: DataFrame, least: int = SMALL, big: DataFrame | None = None) -> DataFrame:
    """Consecutive elements whose composed content is below ``least`` become one MergedContent, across pages; one alone stays.

    ``big`` has the documents that are too large for a task (:mod:`segments`).
    """
    small = F.coalesce(F.length(composed(F.col("category"), F.col("text"))) < least, F.lit(False))
    e = running(elements.withColumn("__small", small), ["doc_id"], ["seq"], big, last={"__wall": F.when(~F.col("__small"), F.col("seq"))})
    kept = [c for c in elements.columns if c not in ("doc_id", "seq")]
    # small ones meet after the last one that is not; that one is a group of its own, so that one pass makes both
    m = e.groupBy("doc_id", "__small", "__wall").agg(F.sort_array(F.collect_list(F.struct("seq", *kept))).alias("m"))
    merged = F.col("__small") & (F.size("m") >= 2)
    texts = F.filter(F.transform("m", lambda x: strip(x["text"])), lambda t: t != "")
    first = F.col("m")[0]
    new = {"category": F.when(merged, "MergedContent").otherwise(first["category"]), "text": F.when(merged, F.array_join(texts, "\n\n")).otherwise(first["text"])}
    return m.select("doc_id", first["seq"].alias("seq"), *[new.get(c, first[c]).alias(c) for c in kept], F.size("m").cast("long").alias("merged"))


def _merged(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Parts put together up to ``size`` characters; the last ones that fit into ``overlap`` begin the next piece."""
    held: list[str] = []
    length = 0
    for p in parts:
        if held and length + len(p) > size:
            yield "".join(held).strip()
            while length > overlap or (length + len(p) > size and length > 0):
                length -= len(held.pop(0))
        held.append(p)
        length += len(p)
    if held:
        yield "".join(held).strip()


def split_text(text: str, size: int = PIECE, overlap: int = OVERLAP, separators: tuple[str, ...] = ("\n\n", "\n", " ")) -> list[str]:
    """Pieces of up to ``size`` characters: cut at the first separator that occurs, and what is still too long by the separators after it.

    Parts keep the separator before them. Those that are small enough are put
    together with an overlap, on their own level only; a part that no separator
    cuts is cut at ``size`` characters.
    """
    level = next((i for i, s in enumerate(separators) if s in text), None)
    if level is None:
        windows = range(0, max(1, len(text) - overlap), max(1, size - overlap))
        return [p for p in (text[i : i + size].strip() for i in windows) if p]
    mark, rest = separators[level], separators[level + 1 :]
    parts = [mark * (i > 0) + p for i, p in enumerate(text.split(mark))]
    pieces: list[str] = []
    small: list[str] = []
    for p in filter(None, parts):
        if len(p) < size:
            small.append(p)
            continue
        pieces += [*_merged(small, size, overlap), *split_text(p, size, overlap, rest)]
        small = []
    return [p for p in [*pieces, *_merged(small, size, overlap)] if p]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else split_text(t) for t in texts])


def split_large(chunks: DataFrame, large: int = LARGE) -> DataFrame:
    """Chunks above ``large`` characters in pieces: piece (from 0) and total; the others have one piece, and only large texts go to Python."""
    cut = F.coalesce(_split(F.when(F.length("text") > large, F.col("text"))), F.array("text"))
    whole = chunks.withColumn("pieces", F.when(F.size(cut) > 1, cut).otherwise(F.array("text")))
    return whole.select(*[c for c in chunks.columns if c != "text"], F.size("pieces").alias("total"), F.posexplode("pieces").alias("piece", "text"))


def chunk_elements(elements: DataFrame, section_titles: bool = False, big: DataFrame | None = None) -> DataFrame:
    """The whole chain: doc_id, seq, piece, total, page, category, content and a chunk_id that depends on place only.

    With ``section_titles`` elements need a phase (see :func:`inherit_sections`),
    and the inherited title, here ``section``, stands before each content; a
    content that is split has it once, at its beginning. ``big`` has the documents
    that are too large for a task (:mod:`segments`).
    """
    kept = filter_noise(elements)
    if section_titles:
        sections = inherit_sections(elements, big).select("doc_id", "seq", "section")
    merged = merge_small(group_lists(kept, big=big), big=big)
    if section_titles:
        merged = merged.join(sections, ["doc_id", "seq"], "left")
    title = F.col("section") if section_titles else None
    content = merged.where(strip(F.col("text")) != "").withColumn("text", composed(F.col("category"), F.col("text"), None, title))
    c = split_large(content.drop("merged")).withColumnRenamed("text", "content")
    return c.withColumn("chunk_id", F.sha2(F.concat_ws("|", "doc_id", "seq", "piece").cast("binary"), 256))


def token_batches(texts: DataFrame, group: str, ceiling: int = 100_000, most: int = 100, big: DataFrame | None = None, bits: int = SEGMENT_BITS) -> DataFrame:
    """``texts`` (group, seq, tokens) with ``batch``: a batch of a group starts where the next text would exceed the ceiling or the number of texts.

    A fold over the texts of a group in order, read as a stream. The groups in
    ``big`` are many tasks: where a batch that starts at a text ends depends on the
    next ``most`` texts only, so each segment of a group gives, for every place at
    which the first batch that starts in it may start, where the first one of the
    next segment does and how many there are between; these maps are followed from
    segment to segment, and each segment then numbers its own batches.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: tuple = (None, 0, 0, 0)
        for frame in frames:
            numbers = []
            for g, t in zip(frame[group].tolist(), frame["tokens"].tolist(), strict=True):
                last, tokens, count, batch = state
                if g != last:
                    tokens, count, batch = 0, 0, 0
                elif tokens + t > ceiling or count >= most:
                    tokens, count, batch = 0, 0, batch + 1
                state = (g, tokens + t, count + 1, batch)
                numbers.append(batch)
            yield frame.assign(batch=numbers)

    ordinary, apart = parted(texts, big)
    ordered = ordinary.repartition(F.col(group)).sortWithinPartitions(group, "seq")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    folded = ordered.mapInPandas(fold, f"{fields}, batch int")
    return folded if apart is None else folded.unionByName(_batches_of_giants(apart, group, ceiling, most, max(bits, (most - 1).bit_length())))


def next_starts(tokens: np.ndarray, ceiling: int, most: int) -> np.ndarray:
    """For each text the one at which the next batch starts, if a batch starts at it; a text alone may exceed the ceiling."""
    sums = np.concatenate(([0], np.cumsum(tokens)))
    start = np.arange(len(tokens))
    fits = np.searchsorted(sums, sums[:-1] + ceiling, side="right") - 1
    return np.minimum(np.maximum(fits, start + 1), start + most)


def _batches_of_giants(texts: DataFrame, group: str, ceiling: int, most: int, bits: int) -> DataFrame:
    size = 1 << bits
    kind = texts.schema[group].dataType.simpleString()
    placed = materialize(running(texts, [group], ["seq"], texts.select(group).distinct(), "__n", bits=bits).withColumn("__n", F.col("__n") - 1), "placed-texts")
    # the first texts of a segment are also seen by the one before it, whose last batch may reach into it
    segment, offset = F.shiftright("__n", bits), F.col("__n") % size
    seen = F.when((offset < most) & (segment > 0), F.array(segment - 1, segment)).otherwise(F.array(segment))
    rows = placed.select(group, "__n", "tokens", F.explode(seen).alias("segment"))

    def followed(frame: pd.DataFrame) -> tuple[int, np.ndarray]:
        frame = frame.sort_values("__n")
        own = int((frame["__n"].to_numpy() >> bits == frame["segment"].iloc[0]).sum())
        return own, next_starts(frame["tokens"].to_numpy(np.int64), ceiling, most)[:own]

    def mapped(frame: pd.DataFrame) -> pd.DataFrame:
        own, after = followed(frame)
        leave, between = after.copy(), np.ones(own, np.int64)
        for i in range(own - 1, -1, -1):  # from the end, so that every place but the last has its way out
            if after[i] < own:
                leave[i], between[i] = leave[after[i]], between[after[i]] + 1
        few = min(most, own)
        return pd.DataFrame({group: [frame[group].iloc[0]], "segment": [frame["segment"].iloc[0]], "leave": [(leave[:few] - own).tolist()], "between": [between[:few].tolist()]})

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: tuple = (None, 0, 0)
        for frame in frames:
            entries, numbers = [], []
            for g, leave, between in zip(frame[group].tolist(), frame["leave"].tolist(), frame["between"].tolist(), strict=True):
                last, entry, number = at
                entry, number = (entry, number) if g == last else (0, 0)
                entries.append(entry)
                numbers.append(number)
                at = (g, leave[entry], number + between[entry]) if entry < len(leave) else (g, entry - len(leave), number)
            yield pd.DataFrame({group: frame[group], "segment": frame["segment"], "entry": entries, "number": numbers})

    maps = by_segment(rows, group, "segment").applyInPandas(mapped, f"`{group}` {kind}, segment long, leave array<long>, between array<long>")
    entries = materialize(maps.repartition(F.col(group)).sortWithinPartitions(group, "segment").mapInPandas(walk, f"`{group}` {kind}, segment long, entry long, number long"), "batch-entries")

    def numbered_rows(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__n")
        own, after = followed(frame)
        starts, i = np.zeros(own, np.int64), int(frame["entry"].iloc[0])
        while i < own:
            starts[i] = 1
            i = int(after[i])
        return pd.DataFrame({group: frame[group].iloc[:own], "__n": frame["__n"].iloc[:own], "batch": frame["number"].iloc[0] - 1 + np.cumsum(starts)})

    found = by_segment(rows.join(entries, [group, "segment"]), group, "segment").applyInPandas(numbered_rows, f"`{group}` {kind}, __n long, batch int")
    return placed.join(found, [group, "__n"]).select(*texts.columns, "batch")
