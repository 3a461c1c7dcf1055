"""Byte-level BPE by ranks: long texts are split in overlapping chunks, stitched, encoded by pieces; decoding joins raw bytes.

A text of up to ``chunk`` characters is split into pre-tokens where it is. A
longer one becomes chunks, a row each, that overlap by ``lap`` characters. Every
chunk is split on its own; the first places are wrong where a chunk begins within
a pre-token, but as soon as a chunk and the one before it have a boundary in
common, they agree from there on, since the pattern looks only forward. That
place is where the chunk takes over. A text with two chunks that have none in
common (a pre-token longer than the overlap) is cut anew with larger chunks.
"""

from __future__ import annotations

import base64
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docquill.llm.bpe import BATCH_IDS, KEPT_WORDS, LATIN_SPLIT, SPLIT, Encoder, _gather, _slices
from docquill.llm.common import id_and_text
from docquill.scratch import materialize

#: Characters of a chunk and of its overlap with the next; how much both grow where chunks do not meet.
CHUNK, LAP, GROWTH = 32_768, 512, 8
#: A boundary so near to a chunk's end may depend on what follows: no alternative of the pattern looks further.
LOOK = 8
#: Pieces of more bytes are merged one by one with their pairs in buckets, so that the work follows the merges.
LONG = 512


class Ranks:
    """The bytes of each id; a pair merges if its bytes together are a token, the lowest rank first, from the left."""

    def __init__(self, content: bytes) -> None:
        tokens = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}
        self.index, self.longest = tokens, max(map(len, tokens))
        table = [b""] * (1 + max(tokens.values()))
        for token, rank in tokens.items():
            table[rank] = token
        #: all ids' bytes one after the other, and where each begins and how long it is
        self.blob, self.size = np.frombuffer(b"".join(table), np.uint8), np.array([len(t) for t in table])
        self.begin = np.cumsum(self.size) - self.size
        self.of_byte = np.array([tokens[bytes([b])] for b in range(256)], np.int64)
        self.special: dict[str, int] = {}
        pairs = [(tokens[t[:i]], tokens[t[i:]], rank) for t, rank in tokens.items() for i in range(1, len(t)) if t[:i] in tokens and t[i:] in tokens]
        left, right, merged = np.array(pairs, np.int64).reshape(-1, 3).T
        order = np.argsort(left << 32 | right, kind="stable")
        self.keys, self.merged = (left << 32 | right)[order], merged[order]
        #: tokens that are part of one with a lower rank: what they were merged into may merge at once, before equal pairs further right
        self.hasty = np.zeros(len(table), bool)
        self.hasty[left[left > merged]] = self.hasty[right[right > merged]] = True
        self.never = len(table)

    @classmethod
    def from_file(cls, path: str) -> Ranks:
        with open(path, "rb") as f:
            return cls(f.read())

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges into, or ``never``."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], self.never)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all (non-empty) pieces one after the other, and where each piece begins. A piece that is a token is its id."""
        found: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        short = []
        for i, w in enumerate(words):
            if (rank := self.index.get(w)) is not None:
                found[i] = np.array([rank])
            elif len(w) > LONG:
                found[i] = self.merge_long(w)
            else:
                short.append(i)
        ids, bounds = self.merge_short([words[i] for i in short])
        for i, a, b in zip(short, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            found[i] = ids[a:b]
        return np.concatenate(found) if found else ids, np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int64)

    def merge_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Rounds over all pieces at once: each merges its pairs of lowest rank, only the leftmost of them where the token is hasty."""
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done = [(owner[:0], symbols[:0])]
        while len(symbols):
            rank = np.append(np.where(owner[:-1] == owner[1:], self.of_pairs(symbols[:-1], symbols[1:]), self.never), self.never)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(symbols))))
            open_ = lowest < self.never
            done.append((owner[~open_], symbols[~open_]))
            places = _left_to_right(np.flatnonzero((rank == lowest) & open_))
            leftmost = np.diff(owner[places], prepend=-1) != 0
            places = places[leftmost | ~self.hasty[rank[places]]]
            symbols[places] = rank[places]
            open_[places + 1] = False
            symbols, owner = symbols[open_], owner[open_]
        owner, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.searchsorted(owner[order], np.arange(len(words) + 1))

    def merge_long(self, word: bytes) -> np.ndarray:
        """One piece of any length: linked symbols, and the places of pairs in a bucket for each rank. A round looks at one bucket only."""
        n = len(word)
        symbol = self.of_byte[np.frombuffer(word, np.uint8)]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        rank = np.append(self.of_pairs(symbol[:-1], symbol[1:]), self.never).astype(np.int32)
        alive = np.ones(n, bool)
        buckets: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(places: np.ndarray) -> None:
            places = places[rank[places] < self.never]
            order = np.argsort(rank[places], kind="stable")
            places = places[order]
            for some in np.split(places, np.flatnonzero(np.diff(rank[places])) + 1):
                if len(some):
                    r = int(rank[some[0]])
                    if r not in buckets:
                        buckets[r] = []
                        heapq.heappush(heap, r)
                    buckets[r].append(some)

        put(np.arange(n, dtype=np.int32))
        while heap:
            r = heapq.heappop(heap)
            places = np.unique(np.concatenate(buckets.pop(r)))
            places = places[rank[places] == r]
            if not len(places):
                continue
            if self.hasty[r]:  # what one merge sets off reaches a token's length to each side
                alone = np.diff(places, prepend=-4 * self.longest) > 2 * self.longest
                put(places[~alone])
                places = places[alone]
            else:
                follows = np.append(False, after[places[:-1]] == places[1:])
                places = places[_alternate(~follows)]
            gone = after[places]
            symbol[places] = r
            rank[gone], alive[gone] = self.never, False
            after[places] = after[gone]
            inner = after[places] < n
            before[after[places][inner]] = places[inner]
            changed = np.unique(np.concatenate([places, before[places][before[places] >= 0]]))
            has = after[changed] < n
            rank[changed[~has]] = self.never
            changed = changed[has]
            rank[changed] = self.of_pairs(symbol[changed], symbol[after[changed]])
            put(changed)
        return symbol[alive]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The bytes of the ids between the offsets, as a binary array."""
        data, sizes = _gather(self.blob, self.begin[ids], self.size[ids])
        cuts = np.concatenate(([0], np.cumsum(sizes)))[offsets].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])


def _alternate(starts: np.ndarray) -> np.ndarray:
    """Every other place of each run; ``starts`` marks where runs begin."""
    number = np.arange(len(starts))
    return (number - np.maximum.accumulate(np.where(starts, number, 0))) % 2 == 0


def _left_to_right(places: np.ndarray) -> np.ndarray:
    """Of places in a row every other one, from the left."""
    return places[_alternate(np.diff(places, prepend=-2) != 1)]


@lru_cache(1)
def newer_letters() -> str:
    """Code points that ``regex`` takes for letters or numbers and tiktoken's older Unicode tables do not, as ranges of a pattern's class."""
    import tiktoken

    known = tiktoken.Encoding("classes", pat_str=r"[\p{L}\p{N}]", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    ours = regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000))
    theirs = {c for i in range(0, len(ours), 4096) for c in bytes(known.encode_ordinary("".join(ours[i : i + 4096]))).decode()}
    points = np.array([ord(c) for c in ours if c not in theirs] or [-1])
    runs = np.split(points, np.flatnonzero(np.diff(points) != 1) + 1)
    return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs if r[0] >= 0)


class PieceEncoder(Encoder):
    """Splits by the pattern and encodes pieces; keeps up to ``kept_words`` pieces that it has met."""

    def __init__(self, ranks: Ranks, pattern: str, newer: str, kept_words: int = KEPT_WORDS) -> None:
        self.vocabulary, self.kept_words = ranks, kept_words
        self.pattern, self.newer = regex.compile(pattern), regex.compile(f"[{newer}]") if newer else None
        self.latin_split = re.compile(LATIN_SPLIT) if pattern == SPLIT else None
        self._forget()

    def _split(self, text: str) -> tuple:
        """The pattern that splits the text as the library does, and the text that it is to be matched with."""
        try:
            if self.latin_split:
                text.encode("latin-1")
                return self.latin_split, text
        except UnicodeEncodeError:
            pass
        return self.pattern, self.newer.sub("\ufffd", text) if self.newer else text

    def words(self, item: str | tuple[str, int, int]) -> list[str]:
        """The pieces of a text; of (text, start, stop) those between two boundaries, matched with what follows them in view."""
        if isinstance(item, str):
            pattern, shown = self._split(item)
            return pattern.findall(item) if shown is item or shown == item else [item[m.start() : m.end()] for m in pattern.finditer(shown)]
        text, start, stop = item
        pattern, shown = self._split(text)
        found = []
        for m in pattern.finditer(shown, start):
            if m.start() >= stop:
                break
            found.append(text[m.start() : m.end()])
        return found

    def boundaries(self, text: str) -> np.ndarray:
        pattern, shown = self._split(text)
        return np.fromiter((m.end() for m in pattern.finditer(shown)), np.int32)


def encode_by_ranks(docs: DataFrame, ranks: str, pattern: str = SPLIT, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, lap: int = LAP) -> DataFrame:
    """One row per input row: doc_id and ``ids``, as the rank file encodes each match of ``pattern`` in the text.

    The file is read on the driver; tasks get its tables. Texts above ``chunk``
    characters are chunks that move between tasks, the others stay where they
    are. ``pattern`` may look ahead by up to ``LOOK`` characters beyond a run of
    one class, and not back. Null text counts as empty and has no ids; texts of
    any length are encoded whole; rows that repeat are encoded each; other columns
    are not looked at; an empty table gives an empty result.
    """
    read = id_and_text(docs, id_col, text_col)
    context = read.sparkSession.sparkContext.broadcast((Ranks.from_file(ranks), pattern, newer_letters()))  # tables of some MB
    kind = read.schema["doc_id"].dataType.simpleString()

    def whole(batches):
        encoder = PieceEncoder(*context.value)
        for batch in batches:
            for part in _slices(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), BATCH_IDS):
                ids, offsets = encoder.encode(batch.column("text")[part].to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part], _lists(ids, offsets)], ["doc_id", "ids"])

    short = read.where(F.length("text") <= chunk).mapInArrow(whole, f"doc_id {kind}, ids array<int>")
    long = read.where(F.length("text") > chunk)
    return short.unionByName(_encode_long(long, context, kind, chunk, lap))


def _lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


def _encode_long(texts: DataFrame, context, kind: str, chunk: int, lap: int) -> DataFrame:
    """The long texts' ids: in rounds, each with the texts whose chunks did not meet in the one before."""
    done = None
    rows = texts.withColumn("row", F.monotonically_increasing_id())
    while True:
        parts = materialize(_split_chunks(rows, context, kind, chunk, lap), "text-chunks")
        size = F.lit(chunk)
        # where a chunk takes over: the first boundary that it and the one before it have in the overlap
        before = parts.select("row", (F.col("chunk") + 1).alias("chunk"), "tail")
        meets = parts.select("row", "chunk", "head").join(before, ["row", "chunk"], "left")
        start = F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", "tail")))
        bounds = materialize(meets.select("row", "chunk", start.alias("start")), "chunk-bounds")
        apart = bounds.where("start IS NULL").select("row").distinct()
        until = bounds.select("row", (F.col("chunk") - 1).alias("chunk"), (F.col("start") + size).alias("stop"))
        pieces = parts.drop("head", "tail").join(bounds, ["row", "chunk"]).join(until, ["row", "chunk"], "left").join(apart, "row", "left_anti")
        coded = pieces.withColumn("stop", F.coalesce("stop", F.length("text"))).mapInArrow(_encoding(context), f"row long, doc_id {kind}, chunk int, ids array<int>")
        found = coded.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
        found = found.select("doc_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
        done = found if done is None else done.unionByName(found)
        if not apart.take(1):
            return done
        # the texts of chunks that do not meet, whole again
        fresh = F.when(F.col("last"), F.col("text")).otherwise(F.substring("text", 1, chunk))
        again = parts.join(apart, "row", "left_semi").groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk", fresh.alias("text")))).alias("parts"))
        rows = again.select("doc_id", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), "row")
        chunk, lap = chunk * GROWTH, lap * GROWTH


def _split_chunks(rows: DataFrame, context, kind: str, chunk: int, lap: int) -> DataFrame:
    """(row, doc_id, chunk, last, text, head, tail): the chunks of the texts, dealt out by row and number, with their boundaries in the overlaps."""
    many = F.greatest(F.ceil((F.length("text") - lap) / chunk), F.lit(1)).cast("int")
    numbered = rows.select("row", "doc_id", "text", many.alias("many")).select("*", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("chunk"))
    cut = F.substring(F.col("text"), F.col("chunk") * chunk + 1, F.when(F.col("chunk") == F.col("many") - 1, F.length("text")).otherwise(F.lit(chunk + lap)))
    cuts = numbered.select("row", "doc_id", "chunk", (F.col("chunk") == F.col("many") - 1).alias("last"), cut.alias("text")).repartition("row", "chunk")

    def run(batches):
        encoder = PieceEncoder(*context.value)
        for batch in batches:
            heads, tails = [], []
            for k, last, text in zip(batch.column("chunk").to_pylist(), batch.column("last").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ends = encoder.boundaries(text)
                heads.append(np.concatenate(([0], ends[ends < lap])) if k else [])
                tails.append([] if last else ends[(ends >= chunk) & (ends <= len(text) - LOOK)] - chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], [*batch.schema.names, "head", "tail"])

    return cuts.mapInArrow(run, f"row long, doc_id {kind}, chunk int, last boolean, text string, head array<int>, tail array<int>")


def _encoding(context):
    def run(batches):
        encoder = PieceEncoder(*context.value)
        for batch in batches:
            for part in _slices(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), BATCH_IDS):
                some = batch.slice(part.start, part.stop - part.start)
                items = list(zip(*(some.column(c).to_pylist() for c in ("text", "start", "stop")), strict=True))
                ids, offsets = encoder.encode(items)
                yield pa.RecordBatch.from_arrays([some.column("row"), some.column("doc_id"), some.column("chunk"), _lists(ids, offsets)], ["row", "doc_id", "chunk", "ids"])

    return run


def decode_by_ranks(encoded: DataFrame, ranks: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``bytes``: the ids' bytes joined, valid UTF-8 or not.

    Null ids count as none and give no bytes; rows that repeat are decoded each; an
    empty table gives an empty result.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(Ranks.from_file(ranks))
    kind = encoded.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def run(batches):
        for batch in batches:
            lists = batch.column("ids").fill_null([])
            for part in _slices(lists.value_lengths().to_numpy(zero_copy_only=False), BATCH_IDS):
                some = lists[part]
                offsets = some.offsets.to_numpy()
                data = shared.value.decode(some.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part].cast(id_type), some, data], ["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind.simpleString()}, ids array<int>, bytes binary")


def default_ranks() -> str:
    """The installed rank file of 50,256 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")

