"""Secret scans with multipart credential linking, in DataFrame operations only.

Three base patterns are always reported. The method adds spans from weak
patterns, which alone say little: identifiers, unlabelled secrets, short
labelled values and endpoints. Parts are placed on the document's axis in
buckets of one scope and joined as intervals; a weak part is reported only if a
complementary part (an identifier for a secret, a secret for an identifier,
both for an endpoint) starts within the scope. Parts have a least length, so a
bucket holds a bounded number of them and a join never pairs a whole document.

Positions come from one split and one extraction per pattern: the lengths of the
pieces between matches and of the matches add up to the code point offsets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquill.llm.common import id_and_text
from docquill.scratch import materialize

#: Code points between the starts of two parts of one credential.
SCOPE = 256


@dataclass(frozen=True)
class Kind:
    """A pattern; matches count from ``least`` code points of ``group`` on. ``role``: what part of a credential it is."""

    name: str
    pattern: str
    group: int
    least: int
    role: str
    weak: bool
    #: What every match of the pattern has in it; cheap to look for.
    hint: str


ASSIGN_HINT = "[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr]|[Tt][Oo][Kk][Ee]|[Aa][Pp][Ii]_?[Kk]"
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: In the order that breaks ties between spans that start together.
KINDS = (
    Kind("assign", ASSIGN, 2, 8, "secret", False, ASSIGN_HINT),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 16, "id", False, "AKIA"),
    Kind("hex", r"[0-9a-f]{32,}", 0, 32, "secret", False, "[A-Za-z0-9+/=_-]{20}"),
    Kind("short", ASSIGN, 2, 4, "secret", True, ASSIGN_HINT),
    Kind("ident", r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{12,32}(?![A-Za-z0-9])", 0, 12, "id", True, "[A-Z0-9]{12}"),
    Kind("opaque", r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/=_-]*[0-9])(?=[a-z0-9+/=_-]*[A-Z])(?=[A-Z0-9+/=_-]*[a-z])[A-Za-z0-9+/=_-]{20,}", 0, 20, "secret", True, "[A-Za-z0-9+/=_-]{20}"),
    Kind("endpoint", r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?", 0, 12, "endpoint", True, "https?://"),
)


def _pieces(kind: Kind, number: int) -> Column:
    """(kind, index, gap before the match, length of the match, length of the group) of each match in ``text``."""
    pattern = F.lit(kind.pattern)
    lengths = lambda group: F.transform(F.regexp_extract_all("text", pattern, F.lit(group)), F.length)
    zipped = F.arrays_zip(
        F.transform(F.split("text", kind.pattern, -1), F.length).alias("gap"),
        lengths(0).alias("size"),
        lengths(kind.group).alias("value"),
    )
    found = F.transform(F.filter(zipped, lambda z: z["size"].isNotNull()), lambda z, i: F.struct(F.lit(number).alias("kind"), i.alias("i"), z["gap"].alias("gap"), z["size"].alias("size"), z["value"].alias("value")))
    empty = F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,value:int>>")
    return F.when(F.col("text").rlike(kind.pattern), found).otherwise(empty)


def credential_parts(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """One row per document of (doc_id, text): doc_id, a row number, and the pieces of all patterns."""
    shared = {k.pattern: n for n, k in reversed(list(enumerate(kinds)))}  # a pattern that two kinds share runs once
    pieces = F.concat(*[_pieces(kinds[n], n) for n in sorted(shared.values())])
    # most texts have no match: one look for all patterns' hints spares them a look for each pattern
    hint = "|".join(dict.fromkeys(k.hint for k in kinds))
    pieces = F.when(F.col("text").rlike(hint), pieces).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,value:int>>"))
    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), pieces.alias("pieces"))


def _placed(parts: DataFrame, kinds: tuple[Kind, ...]) -> DataFrame:
    """(row, kind, start, end) of the matches that are long enough."""
    piece = parts.where(F.size("pieces") > 0).select("row", F.explode("pieces").alias("p")).select("row", "p.*")
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    placed = piece.select("row", "kind", "value", (end - F.col("size")).alias("start"), end.alias("end"))
    chosen = F.lit(None).cast("int")
    for n, k in reversed(list(enumerate(kinds))):
        first = next(i for i, other in enumerate(kinds) if other.pattern == k.pattern)
        chosen = F.when((F.col("kind") == first) & (F.col("value") >= k.least), n).otherwise(chosen)
    return placed.withColumn("kind", chosen).where("kind IS NOT NULL").drop("value")


def linked_spans(spans: DataFrame, kinds: tuple[Kind, ...] = KINDS, scope: int = SCOPE) -> DataFrame:
    """The weak spans of (row, kind, start, end) that have their complement within ``scope`` and overlap no base span, however long."""
    by_role = lambda role: [n for n, k in enumerate(kinds) if k.role == role]
    weak = spans.where(F.col("kind").isin([n for n, k in enumerate(kinds) if k.weak]))
    near = F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("start") + scope) / scope))
    looking = weak.select("row", "kind", "start", "end", F.explode(near).alias("bucket"))
    there = spans.where(F.col("kind").isin(by_role("id") + by_role("secret"))).select(
        F.col("row").alias("r"), F.floor(F.col("start") / scope).alias("b"), F.col("start").alias("s"), F.col("kind").isin(by_role("id")).alias("is_id")
    )
    met = looking.join(there, (F.col("row") == F.col("r")) & (F.col("bucket") == F.col("b")) & (F.abs(F.col("s") - F.col("start")) <= scope))
    seen = met.groupBy("row", "kind", "start", "end").agg(F.bool_or("is_id").alias("id"), F.bool_or(~F.col("is_id")).alias("secret"))
    role = lambda r: F.col("kind").isin(by_role(r))
    complete = seen.where((role("secret") & F.col("id")) | (role("id") & F.col("secret")) | (role("endpoint") & F.col("id") & F.col("secret"))).select("row", "kind", "start", "end")
    # a span is in every bucket that it covers, so that an overlap meets in one of them
    covered = F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope)))
    sure = spans.where(F.col("kind").isin([n for n, k in enumerate(kinds) if not k.weak])).select(F.col("row").alias("r"), covered.alias("b"), F.col("start").alias("s"), F.col("end").alias("e"))
    known = complete.select("row", "kind", "start", "end", covered.alias("bucket")).join(sure, (F.col("row") == F.col("r")) & (F.col("bucket") == F.col("b")) & (F.col("s") < F.col("end")) & (F.col("e") > F.col("start")))
    return complete.join(known.select("row", "kind", "start").distinct(), ["row", "kind", "start"], "left_anti")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, scope: int = SCOPE) -> DataFrame:
    """One row per input row: doc_id and ``spans``, an array of (start, order, kind, end, weak) sorted by start, then order.

    Offsets are code points, the end exclusive. Matches of a kind are leftmost
    and do not overlap; a match that is too short is dropped. Null text counts
    as empty; a text without a match has an empty array; texts of any length are
    scanned whole; rows that repeat are scanned each on its own. Other columns
    are not looked at; an empty table gives an empty result.
    """
    parts = materialize(credential_parts(id_and_text(docs, id_col, text_col), kinds), "parts")
    spans = _placed(parts, kinds)
    base = spans.where(F.col("kind").isin([n for n, k in enumerate(kinds) if not k.weak]))
    every = base.unionByName(linked_spans(spans, kinds, scope))
    names = F.array(*[F.lit(k.name) for k in kinds])
    weak = F.array(*[F.lit(k.weak) for k in kinds])
    span = F.struct("start", F.col("kind").alias("order"), F.get(names, F.col("kind")).alias("kind"), "end", F.get(weak, F.col("kind")).alias("weak"))
    grouped = every.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))  # as many as one text has
    empty = F.array().cast(grouped.schema["spans"].dataType)
    found = parts.where(F.size("pieces") > 0).join(grouped, "row", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))
    return found.unionByName(parts.where(F.size("pieces") == 0).select("doc_id", empty.alias("spans")))


def written(spans: Column) -> Column:
    """The spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
