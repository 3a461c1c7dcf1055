"""SimHash near-duplicates by a hierarchical index in Gray order.

Fingerprints have 64 bits in five blocks. Two that differ in three bits or fewer
agree in two blocks at least, so each of the ten pairs of blocks is the masked
pattern of an upper node of the index: the fingerprints that share it form the
node, and nodes are dealt over the cluster by their pattern. Within nodes the
fingerprints are sorted by Gray rank, which puts those next to each other that
differ in few bits. Every ``FAN`` neighbours form a lower node and every ``FAN``
lower nodes the next; a lower node keeps the bits that all its members share and
that its parent has not factored out yet. A search goes down level by level for
all fingerprints at once, adds up the differences of the shared bits, and prunes
a whole group when the sum passes three.

Only a spanning forest of each part's links leaves a task, so the links grow with
the documents and not with the square of a group. A node with more than
``TILE_ROWS`` fingerprints is cut into tiles, and each pair of tiles is a part of
its own; no link is lost, and no task gets more than two tiles of a node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquill.llm.bloom import build_filter, filter_words, test_filter
from docquill.llm.common import id_and_text, text_of
from docquill.llm.components import connected_components
from docquill.scratch import materialize, release

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Bits of the five blocks; the children of a node; fingerprints in a tile of an upper node.
BLOCKS, FAN, TILE_ROWS = (13, 13, 13, 13, 12), 16, 20_000
#: Shingles whose bits are counted at a time, and query-node pairs that are held at a time.
PIECE, PAIRS = 1 << 18, 1 << 20


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """For each of the 64 bits, least first, how many of the hashes have it."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The text's SimHash: a bit is set if over half of the shingles' hashes have it (no word: zero)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII is lowered and is space
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1))
    stops = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        pairs = zip(starts[at : at + PIECE].tolist(), stops[at : at + PIECE].tolist(), strict=True)
        counts += _bit_counts(np.array([digest(line[i:j], SEED) for i, j in pairs], np.uint64))
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64)
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(prints.view(np.int64))], [*kept, "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print) of rows with doc_id and text; the print is the 64 bits as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {kind}, print long")


# ---------------------------------------------------------------- the index


def _gray_rank(prints: np.ndarray) -> np.ndarray:
    """The place of each code in the binary reflected Gray order."""
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class _Forest:
    """Union-find over 0..n-1 that takes many links at once; a root is its tree's least member."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if (up == x).all():
                return x
            x = self.parent[up]

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            open_ = a != b
            a, b = np.minimum(a, b)[open_], np.maximum(a, b)[open_]
            np.minimum.at(self.parent, b, a)


def _levels(prints: np.ndarray, first: np.ndarray, bounds: np.ndarray, fan: int = FAN) -> list[tuple[np.ndarray, ...]]:
    """The lower levels from the leaves up: (first child, end of the children, shared bits, mask of the bits that are new here).

    ``bounds``: where the upper nodes begin in the sorted fingerprints; no lower
    node spans two of them. ``first`` is the mask of the upper nodes' patterns.
    """
    starts = np.concatenate([np.arange(a, b, fan) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]) if len(bounds) > 1 else np.zeros(0, np.int64)
    levels, lows, highs, begin = [], prints, prints, starts
    owner = np.searchsorted(bounds, starts, "right") - 1
    while True:
        low, high = np.bitwise_and.reduceat(lows, begin), np.bitwise_or.reduceat(highs, begin)
        levels.append([begin, np.append(begin[1:], len(lows)), low, ~(low ^ high)])
        edges = np.flatnonzero(np.diff(owner)) + 1
        edges = np.concatenate(([0], edges, [len(owner)]))
        if (np.diff(edges) == 1).all():
            break
        begin = np.concatenate([np.arange(a, b, fan) for a, b in zip(edges[:-1], edges[1:], strict=True)])
        lows, highs, owner = low, high, owner[begin]
    above = first[owner]
    for level in reversed(levels):  # what the parent shares is not tested again
        level[3] &= ~above
        if level is not levels[0]:
            above = np.repeat(~(~above & ~level[3]), level[1] - level[0])
    return [tuple(x) for x in levels]


def link_prints(prints: np.ndarray, node: np.ndarray, masks: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For each fingerprint the index of the least one that links reach within its node.

    All arrays are sorted by node, then Gray rank; ``masks`` has the pattern
    bits of each fingerprint's node.
    """
    n = len(prints)
    forest = _Forest(n)
    bounds = np.concatenate(([0], np.flatnonzero(node[1:] != node[:-1]) + 1, [n]))
    if len(bounds) - 1 == n:
        return forest.parent
    levels = _levels(prints, masks[bounds[:-1]], bounds)
    sizes = np.diff(bounds)
    roots = np.repeat(np.arange(len(sizes)), sizes)  # the top level has one lower node for each upper node
    queries = np.flatnonzero(sizes[roots] > 1)
    for at in range(0, len(queries), PAIRS // FAN // 4):
        work = [(len(levels) - 1, queries[at : at + PAIRS // FAN // 4], roots[queries[at : at + PAIRS // FAN // 4]], None)]
        while work:
            depth, q, at_node, so_far = work.pop()
            if len(q) > PAIRS // FAN:
                half = len(q) // 2
                work += [(depth, q[half:], at_node[half:], None if so_far is None else so_far[half:]), (depth, q[:half], at_node[:half], None if so_far is None else so_far[:half])]
                continue
            begin, end, bits, mask = levels[depth]
            apart = np.bitwise_count((prints[q] ^ bits[at_node]) & mask[at_node]).astype(np.uint8)
            if so_far is not None:
                apart += so_far
            near = apart <= distance
            q, at_node, apart = q[near], at_node[near], apart[near]
            many = end[at_node] - begin[at_node]
            parent = np.repeat(np.arange(len(q)), many)
            child = np.arange(len(parent)) - np.repeat(np.cumsum(many) - many, many) + begin[at_node][parent]
            if depth:
                work.append((depth - 1, q[parent], child, apart[parent]))
                continue
            q = q[parent]
            later = child > q
            q, child = q[later], child[later]
            link = np.bitwise_count(prints[q] ^ prints[child]) <= distance
            forest.add(q[link], child[link])
    return forest.roots(np.arange(n))


def _parts(block_bits: tuple[int, ...] = BLOCKS) -> list[int]:
    """The mask of each pair of blocks."""
    cuts = np.cumsum((0, *block_bits))
    one = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(len(block_bits))]
    return [one[i] | one[j] for i in range(len(one)) for j in range(i)]


def _linker(masks: list[int], distance: int):
    table = np.array(masks, np.uint64)
    columns = ["pair", "pattern", "tile", "print", "id"]

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        prints, pair = frame["print"].to_numpy().view(np.uint64), frame["pair"].to_numpy()
        keys = frame[["pair", "pattern", "tile"]].to_numpy()
        change = np.concatenate(([False], (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else np.zeros(0, bool)
        node = np.cumsum(change)
        order = np.lexsort((_gray_rank(prints), node))
        root = link_prints(prints[order], node[order], table[pair[order]], distance)
        ids = frame["id"].to_numpy()[order]
        found = root != np.arange(len(root))
        return pd.DataFrame({"a": ids[found], "b": ids[root[found]]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:  # sorted by node: what may go on in the next batch is held back
            if not len(frame):
                continue
            keys = frame[["pair", "pattern", "tile"]].to_numpy()
            last = int(np.flatnonzero((keys != keys[-1]).any(axis=1)).max(initial=-1)) + 1
            if last or (held and (held[-1][["pair", "pattern", "tile"]].to_numpy()[-1] != keys[0]).any()):
                yield whole(pd.concat([*held, frame[:last]], ignore_index=True)[columns])
                held = []
            held.append(frame[last:])
        if held:
            yield whole(pd.concat(held, ignore_index=True)[columns])

    return run


def near_links(reps: DataFrame, distance: int = DISTANCE, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): links between ids of (id, print) whose chains connect all fingerprints at ``distance`` or fewer bits.

    ``distance`` may be up to 3, for which two of the five blocks must agree.
    """
    if not 0 <= distance <= len(BLOCKS) - 2:
        raise ValueError("two of the blocks must be sure to agree")
    masks = _parts()
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    nodes = reps.select("id", "print", F.posexplode(F.array(*[F.col("print").bitwiseAND(F.lit(m)) for m in signed])).alias("pair", "pattern"))
    sizes = nodes.groupBy("pair", "pattern").count().where("count > 1")
    sizes = materialize(sizes.select("pair", "pattern", F.ceil(F.col("count") / tile_rows).cast("int").alias("tiles")), "nodes")
    met = nodes.join(sizes, ["pair", "pattern"])
    # a fingerprint of tile t is in the parts (t, u) and (u, t) of its node; one tile: one part
    t = F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: F.least(t, u) * F.col("tiles") + F.greatest(t, u))
    dealt = met.select("pair", "pattern", F.explode(tiles).alias("tile"), "print", "id")
    together = dealt.repartition("pair", "pattern", "tile").sortWithinPartitions("pair", "pattern", "tile")
    kind = reps.schema["id"].dataType.simpleString()
    return together.mapInPandas(_linker(masks, distance), f"a {kind}, b {kind}").distinct()


def _components(prints: DataFrame, distance: int) -> DataFrame:
    """(print, root) of all fingerprints of ``prints``: root is the least fingerprint that links reach."""
    distinct = materialize(prints.select("print").distinct(), "distinct-prints")
    found = connected_components(near_links(distinct.select(F.col("print").alias("id"), "print"), distance))
    return materialize(distinct.join(found, F.col("print") == F.col("node"), "left").select("print", F.coalesce("component", "print").alias("root")), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per input row: doc_id, print (long), component_id.

    Documents link where their fingerprints differ in ``distance`` bits or
    fewer; component_id is the smallest id that links reach, the document's own
    included, and null only if no id is reached. Fingerprints are what links
    join, so rows that share an id are documents of their own. Null and empty
    texts have the fingerprint zero and link like any other; texts of any length
    are read whole. Rows that repeat get equal rows. Other columns are not looked
    at; an empty table gives an empty result.
    """
    prints = materialize(fingerprints(id_and_text(docs, id_col, text_col)), "prints")
    roots = _components(prints, distance)
    least = prints.groupBy("print").agg(F.min("doc_id").alias("id"))
    roots = materialize(roots.join(least, "print"), "least-ids")
    named = materialize(roots.groupBy("root").agg(F.min("id").alias("component_id")), "components")
    classes = materialize(roots.join(named, "root").select("print", "component_id"), "classes")
    return prints.join(classes, "print").select("doc_id", "print", "component_id")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row of ``docs`` of each component, with all its columns, whatever their names.

    The row with the smallest id stays, null ids come last; among rows that share
    the id the one with the least hash of its text, and of rows that are equal in
    both exactly one. What goes is found on narrow rows (id and hash) and put into
    a Bloom filter; rows that miss it pass straight through, and only the others
    move with their texts. An empty table gives an empty one.
    """
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("hash").alias("hash"))
    narrow = id_and_text(docs, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    prints = materialize(narrow.mapInArrow(_fingerprints, f"doc_id {kind}, hash long, print long"), "prints")
    roots = _components(prints, distance)
    keys = prints.groupBy("print", "doc_id", "hash").agg(F.count("*").alias("n"))
    known = materialize(keys.join(roots, "print").select("root", key.alias("key"), "n"), "keys")
    first = materialize(known.groupBy("root").agg(F.min("key").alias("first"), F.sum("n").alias("all")).where("all > 1"), "groups")
    h = F.xxhash64("id", "hash")
    judged = known.join(first, "root").select("key.id", "key.hash", (F.col("key") == F.col("first")).alias("stays"), "n").where("n > 1 OR NOT stays")
    judged = materialize(judged.withColumn("h", h), "judged")
    words = filter_words(judged.count())
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_of(text_col)).alias("hash")).withColumn("h", h)
    tested = test_filter(rows, "h", materialize(build_filter(judged, "h", words), "filter"), words, "maybe")
    release(docs.sparkSession, prints, known)
    known = judged.select(F.col("id").alias("j_id"), F.col("hash").alias("j_hash"), F.col("h").alias("j_h"), "stays")
    met = tested.where("maybe").join(known, (F.col("h") == F.col("j_h")) & F.col("id").eqNullSafe(F.col("j_id")) & (F.col("hash") == F.col("j_hash")), "left").where("coalesce(stays, true)")
    twice = met.where("stays").groupBy("id", "hash").agg(F.min_by("row", F.lit(0)).alias("row"))  # rows that are equal in both
    return tested.where("NOT maybe").select("row.*").unionByName(met.where("stays IS NULL").select("row.*")).unionByName(twice.select("row.*"))
