"""Byte-level BPE: encoding by batched merge rounds in numpy, and decoding.

The distinct words of a batch of texts lie in one flat array of symbols. A round
looks up all neighbouring pairs by binary search over the sorted pair keys, takes
each word's pair of lowest rank and merges all its occurrences from the left; it
ends when no word has a pair that merges. Words that a task has met before come
from a table of bounded size.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from docquill.llm.common import id_and_text

#: The split before merges that the published byte-level vocabularies were made with (a fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words that a task keeps; characters that are split at a time; bytes of text, or ids, that are coded at a time.
KEPT_WORDS, PIECE_CHARS, BATCH_IDS = 100_000, 1 << 20, 500_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` one after the other, and their sizes."""
    at = np.repeat(begin - (np.cumsum(size) - size), size)
    at += np.arange(len(at))
    return flat[at], size


class Vocabulary:
    """A byte-level BPE vocabulary: the ids of bytes, the pairs that merge, the bytes of ids, and the special tokens."""

    def __init__(self, content: str) -> None:
        data = json.loads(content)
        ids = data["model"]["vocab"]
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        self.of_byte = np.array([ids[c] for c in letters], np.int64)
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special = special
        table = [b""] * (1 + max([*ids.values(), *special.values()]))
        for token, i in ids.items():
            table[i] = bytes(of_letter[c] for c in token)
        for token, i in special.items():
            table[i] = token.encode()
        #: all ids' bytes one after the other, and where each begins and how long it is
        self.blob, self.size = np.frombuffer(b"".join(table), np.uint8), np.array([len(t) for t in table])
        self.begin = np.cumsum(self.size) - self.size
        merges = [tuple(m.split(" ")) if isinstance(m, str) else m for m in data["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        #: sorted pair keys with their ranks and the ids they merge into
        self.keys, self.ranks, self.merged = keys[order], order, np.array([ids[a + b] for a, b in merges], np.int64)[order]

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all (non-empty) words one after the other, and where each word begins."""
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_owner = [], []
        never = len(self.keys)
        while len(symbols):
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), never - 1)
            rank = np.where((self.keys[at] == pair) & (owner[:-1] == owner[1:]), self.ranks[at], never)
            rank, at = np.append(rank, never), np.append(at, 0)  # a place for every symbol
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(symbols)))
            best_here = np.repeat(best, sizes)
            ended = best_here == never
            done_symbols.append(symbols[ended])
            done_owner.append(owner[ended])
            chosen = (rank == best_here) & ~ended
            # in a row of equal symbols every other pair merges, from the left
            places = np.flatnonzero(chosen)
            starts = np.diff(places, prepend=-2) != 1
            since = np.arange(len(places)) - np.maximum.accumulate(np.where(starts, np.arange(len(places)), 0))
            places = places[since % 2 == 0]
            symbols = symbols.copy()
            symbols[places] = self.merged[at[places]]
            keep = ~ended
            keep[places + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        symbols, owner = np.concatenate(done_symbols or [symbols]), np.concatenate(done_owner or [owner])
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.searchsorted(owner[order], np.arange(len(words) + 1))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of the ids between the offsets; bytes that are not UTF-8 become the replacement character."""
        data, sizes = _gather(self.blob, self.begin[ids], self.size[ids])
        data, cuts = data.tobytes(), np.concatenate(([0], np.cumsum(sizes)))[offsets].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def unassigned() -> re.Pattern:
    """Code points without a category. Unicode versions differ in them, so they are split as what they were: no letter, number or space."""
    ranges, start = [], None
    for c in range(0x110001):
        free = c < 0x110000 and unicodedata.category(chr(c)) == "Cn"
        if free and start is None:
            start = c
        elif not free and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile("[" + "".join(ranges) + "]")


#: Letters, numbers and space of Latin-1, as Unicode has them: texts within it take a faster pattern that splits alike.
_LETTER, _NUMBER, _BLANK = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\x09-\x0D\x20\x85\xa0"
LATIN_SPLIT = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"


class Encoder:
    """Encodes texts with a vocabulary; keeps up to ``kept_words`` words that it has met."""

    def __init__(self, vocabulary: Vocabulary, kept_words: int = KEPT_WORDS) -> None:
        self.vocabulary, self.kept_words = vocabulary, kept_words
        self.split, self.latin_split = regex.compile(SPLIT), re.compile(LATIN_SPLIT)
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.safe_cut = re.compile(r"(?<=[0-9A-Za-z])\x20(?=[0-9A-Za-z])")
        self._forget()

    @cached_property
    def free(self) -> re.Pattern:
        """Needed only for texts beyond Latin-1."""
        return unassigned()

    def _forget(self) -> None:
        """Start with the special tokens only; no other word is spelt like one, as texts are cut at them."""
        self.index = {t: i for i, t in enumerate(self.vocabulary.special)}
        self.flat = np.array(list(self.vocabulary.special.values()), np.int32)
        self.begin, self.size = np.arange(len(self.flat)), np.ones(len(self.flat), np.int64)

    def _learn(self, new: list[str]) -> None:
        ids, bounds = self.vocabulary.merge_words([w.encode("utf-8", "surrogatepass") for w in new])
        self.index.update(zip(new, range(len(self.begin), len(self.begin) + len(new)), strict=True))
        self.begin = np.concatenate([self.begin, bounds[:-1] + len(self.flat)])
        self.size = np.concatenate([self.size, np.diff(bounds)])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])

    def _words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return self.latin_split.findall(text)
        except UnicodeEncodeError:
            pass
        if not self.free.search(text):
            return self.split.findall(text)
        stand_in = self.free.sub("\ufffd", text)
        return [text[m.start() : m.end()] for m in self.split.finditer(stand_in)]

    def words(self, text: str) -> list[str]:
        """The text's words and special tokens. Long stretches are cut before a single space inside a line, where a word begins in any case."""
        found = []
        for i, part in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                found.append(part)
                continue
            while len(part) > PIECE_CHARS and (cut := self.safe_cut.search(part, PIECE_CHARS)):
                found += self._words(part[: cut.start()])
                part = part[cut.start() :]
            found += self._words(part)
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the offsets between them."""
        words, counts = [], [0]
        for t in texts:
            words += self.words(t)
            counts.append(len(words))
        if len(self.index) > self.kept_words:
            self._forget()
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            self._learn(list({words[i] for i in missing}))
            at[missing] = [self.index[words[i]] for i in missing]
        ids, sizes = _gather(self.flat, self.begin[at], self.size[at])
        return ids, np.concatenate(([0], np.cumsum(sizes)))[counts]


def _slices(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Rows of about ``most`` characters or ids together."""
    if len(sizes):
        number = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(sizes)]
        yield from (slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """One row per input row: doc_id and ``ids``, as the vocabulary file ``tokenizer`` encodes the text.

    The file is read on the driver; tasks get its tables. Special tokens that
    stand in a text are one id; none is added. With ``decode`` the ids are
    decoded again where they were made, as ``text``. Null text counts as empty
    and has no ids; texts of any length are encoded whole; rows that repeat are
    encoded each; other columns are not looked at; an empty table gives an empty
    result.
    """
    read = id_and_text(docs, id_col, text_col)
    shared = read.sparkSession.sparkContext.broadcast(Vocabulary.from_file(tokenizer))  # tables of some MB

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            for part in _slices(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), BATCH_IDS):
                ids, offsets = encoder.encode(batch.column("text")[part].to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                columns = [batch.column("doc_id")[part], lists]
                if decode:
                    columns.append(pa.array(shared.value.decode(ids, offsets), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "text"][: len(columns)])

    return read.mapInArrow(run, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, ids array<int>{', text string' * decode}")


def decode_texts(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``text``: the decoded ids, special tokens included. Null ids count as none."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.from_file(tokenizer))
    kind = encoded.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def run(batches):
        for batch in batches:
            lists = batch.column("ids").fill_null([])
            for part in _slices(lists.value_lengths().to_numpy(zero_copy_only=False), BATCH_IDS):
                some = lists[part]
                offsets = some.offsets.to_numpy()
                texts = shared.value.decode(some.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part].cast(id_type), batch.column("ids")[part], pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind.simpleString()}, ids array<int>, text string")


def default_tokenizer() -> str:
    """The installed byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


