"""Language-model scoring with a log-bilinear neural model.

The model predicts a token from the three before it: the context's vectors, each
scaled by a vector of its place, are added up, and a token's score is its own
vector times that sum plus its bias. It is trained in numpy by noise-contrastive
estimation. Tokens are classes: the words that occur often enough to learn a
vector of their own, whose number grows with the corpus up to a bound, the end of
a text, and for the rarer words as many classes as ``RARE``, to which a word
belongs by its hash and within which it has its smoothed share of the class's
count. So every word has a vector, and the probabilities of all words sum to one.
Classes are normalised in two levels, groups and members, by batched matrix
products.

All training documents take part. Words are counted by Spark over the whole
table. Documents are then dealt into parts by a hash, as many as the tokens need;
each part trains from the same start (biases at the logarithm of the class's
share), and the models are averaged by tokens, parameter by parameter, in Spark.
Parts, and the order in them, depend on the rows and not on how the table is
stored, and so do the scores.

Counts of frequent words go to the tasks as a table of bounded size
(``head_words``); rarer words are looked up by a join with the whole table of
counts, so nothing that is broadcast grows with the corpus.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docquill.llm.common import text_of
from docquill.llm.word_counts import word_counts, words_of
from docquill.scratch import materialize

#: Most classes of single words, and from which count on a word is one; classes of rarer words by hash; members of a group.
CLASSES, OWN_COUNT, RARE, GROUP = 8000, 150, 500, 96
#: Length of the vectors; words of the context; words whose counts tasks hold.
DIMENSIONS, CONTEXT, HEAD_WORDS = 16, 3, 50_000
#: Training: positions in a step, noise tokens in a step, step size; tokens of a part.
STEP, NOISE, RATE, PART_TOKENS = 8192, 32, 0.05, 2_000_000
#: Rounds of averaging, each on rows of its own; parts of a round at most.
ROUNDS, MOST_PARTS = 2, 2048

#: The end of a text as a token; no word is empty.
END = b""


class Model:
    """vectors (classes x d) and bias, of what is predicted and of the context; above and above_bias, of the groups of classes; place (context x d).

    The classes are cut into groups of ``group`` neighbours. A class's probability
    is that of its group times its share in the group, so that two short sums
    normalise it and not one over all classes.
    """

    def __init__(self, vectors: np.ndarray, bias: np.ndarray, above: np.ndarray, above_bias: np.ndarray, place: np.ndarray, group: int) -> None:
        self.vectors, self.bias, self.above, self.above_bias, self.place = (np.asarray(x, np.float32).copy() for x in (vectors, bias, above, above_bias, place))
        self.group = group

    @classmethod
    def start(cls, shares: np.ndarray, dimensions: int = DIMENSIONS, context: int = CONTEXT, group: int = GROUP, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        mass = np.add.reduceat(shares, np.arange(0, len(shares), group))
        return cls(rng.normal(0, 0.1, (len(shares), dimensions)), np.log(shares), rng.normal(0, 0.1, (len(mass), dimensions)), np.log(mass), np.full((context, dimensions), 0.1), group)

    def rows(self) -> np.ndarray:
        """All parameters as rows of one length, to be averaged."""
        return np.concatenate([np.column_stack([self.vectors, self.bias]), np.column_stack([self.above, self.above_bias]), np.column_stack([self.place, np.zeros(len(self.place))])])

    def of_rows(self, rows: np.ndarray) -> Model:
        """A model of this one's shape from its rows."""
        n, g = len(self.bias), len(self.above_bias)
        return Model(rows[:n, :-1], rows[:n, -1], rows[n : n + g, :-1], rows[n : n + g, -1], rows[n + g :, :-1], self.group)

    def wanted(self, contexts: np.ndarray) -> np.ndarray:
        """The sums of the contexts' vectors, each scaled by its place."""
        out = self.vectors[contexts[:, 0]] * self.place[0]
        for k in range(1, contexts.shape[1]):
            out += self.vectors[contexts[:, k]] * self.place[k]
        return out

    def log10_probabilities(self, contexts: np.ndarray, tokens: np.ndarray, block: int = 2048) -> np.ndarray:
        """log10 of the normalised probability of each token after its context (a row of classes), by one matrix product for the groups and one for each group's members."""
        group = tokens // self.group
        order = np.argsort(group.astype(np.uint16) if len(self.above) < 1 << 16 else group, kind="stable")  # short numbers are sorted by their digits
        wanted = self.wanted(contexts[order])
        longest = np.sqrt(max((self.vectors**2).sum(axis=1).max(), (self.above**2).sum(axis=1).max()) * (wanted**2).sum(axis=1).max(initial=0))
        safe = longest + max(np.abs(self.bias).max(), np.abs(self.above_bias).max()) < 60  # float32 holds exp(60)
        wanted = np.column_stack([wanted, np.ones(len(order), np.float32)])
        group, tokens = group[order], tokens[order]
        logs = np.empty(len(order), np.float32)
        upper = np.column_stack([self.above, self.above_bias]).T.copy()
        for i in range(0, len(order), block):
            logs[i : i + block] = _shares(wanted[i : i + block] @ upper, group[i : i + block], safe)
        lower = np.column_stack([self.vectors, self.bias])
        cuts = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            first = int(group[a]) * self.group
            members = lower[first : first + self.group].T.copy()
            for i in range(a, b, block):
                j = min(b, i + block)
                logs[i:j] += _shares(wanted[i:j] @ members, tokens[i:j] - first, safe)
        out = np.empty(len(order))
        out[order] = logs
        return out / math.log(10)

    def train(self, contexts: np.ndarray, tokens: np.ndarray, shares: np.ndarray, rng: np.random.Generator, rate: float = RATE) -> None:
        """One pass of noise-contrastive estimation, of classes and of their groups; noise is drawn from ``shares`` and used by a whole step."""
        mass = np.add.reduceat(shares, np.arange(0, len(shares), self.group))
        levels = [(self.vectors, self.bias, np.log(shares * NOISE).astype(np.float32), np.cumsum(shares)), (self.above, self.above_bias, np.log(mass * NOISE).astype(np.float32), np.cumsum(mass))]
        for i in range(0, len(tokens), STEP):
            c, w = contexts[i : i + STEP], tokens[i : i + STEP]
            seen = [self.vectors[c[:, k]] for k in range(c.shape[1])]
            wanted = seen[0] * self.place[0]
            for s, p in zip(seen[1:], self.place[1:], strict=True):
                wanted += s * p
            d_wanted, steps = np.zeros_like(wanted), []
            for (vectors, bias, log_noise, bounds), aim in zip(levels, (w, w // self.group), strict=True):
                noise = np.minimum(np.searchsorted(bounds, rng.random(NOISE) * bounds[-1]), len(bounds) - 1)
                aims, others = vectors[aim], vectors[noise]
                true = np.einsum("ij,ij->i", wanted, aims) + bias[aim] - log_noise[aim]
                false = wanted @ others.T + (bias[noise] - log_noise[noise])
                up = 1 / (1 + np.exp(np.clip(true, -30, 30)))  # of the data: to be raised
                down = -1 / (1 + np.exp(-np.clip(false, -30, 30)))  # of the noise: to be lowered
                d_wanted += up[:, None] * aims + down @ others
                steps.append((aim, up, noise, down))
            inner = [(x, d_wanted * p) for x, p in zip(c.T, self.place, strict=True)]
            for (vectors, bias, _, _), (aim, up, noise, down), more in zip(levels, steps, (inner, []), strict=True):
                # the gradients of all vectors that occur, summed by class and dimension
                where = np.concatenate([aim, *[x for x, _ in more]])
                what = np.concatenate([up[:, None] * wanted, *[d for _, d in more]])
                cell = where[:, None] * vectors.shape[1] + np.arange(vectors.shape[1])
                sums = np.bincount(cell.ravel(), what.ravel(), vectors.size).reshape(vectors.shape)
                np.add.at(sums, noise, down.T @ wanted)
                slope = np.bincount(aim, up, len(bias)) + np.bincount(noise, down.sum(axis=0), len(bias))
                # frequent classes take shorter steps
                scale = (rate / np.sqrt(np.maximum(np.bincount(where, minlength=len(bias)), NOISE / 4))).astype(np.float32)
                vectors += scale[:, None] * np.clip(sums, -50, 50).astype(np.float32)
                bias += (0.1 * scale * slope).astype(np.float32)
            self.place += rate / len(w) * np.stack([np.einsum("ij,ij->j", d_wanted, s) for s in seen])


def _shares(scores: np.ndarray, chosen: np.ndarray, safe: bool) -> np.ndarray:
    """The logarithm of the chosen entry's share in each row's exponentials; ``scores`` is overwritten, and shifted first unless that is not needed."""
    if not safe:
        scores -= scores.max(axis=1, keepdims=True)
    picked = scores[np.arange(len(scores)), chosen]
    return picked - np.log(np.exp(scores, out=scores).sum(axis=1))


def rare_class(word: bytes) -> int:
    return zlib.crc32(word) % RARE


class Lexicon:
    """Counts and classes of the frequent words, of bounded size; ``total`` tokens and ``distinct`` ones in training.

    ``rare``: for each class of rarer words the tokens and the distinct words
    that are not in ``head``.
    """

    def __init__(self, head: list[tuple[bytes, int]], total: int, distinct: int, ends: int, classes: int = CLASSES, rare: np.ndarray | None = None, own_count: int = OWN_COUNT) -> None:
        self.total, self.distinct = total, distinct
        self.words = [w for w, _ in head]
        self.index = {w: i + 1 for i, w in enumerate(self.words)}
        self.counts = np.array([ends, *[n for _, n in head], 0], np.int64)  # the end, the words, then any other word
        self.single = min(classes, sum(n >= own_count for _, n in head)) + 1  # the end, then the most frequent words
        self.classes = self.single + RARE
        tokens, words = np.zeros((2, RARE), np.int64) if rare is None else np.asarray(rare, np.int64)
        beyond = head[self.single - 1 :]
        hashed = np.array([rare_class(w) for w, _ in beyond], np.int64)
        tokens = tokens + np.bincount(hashed, [n for _, n in beyond], RARE).astype(np.int64)
        words = words + np.bincount(hashed, minlength=RARE)
        weight = np.concatenate([self.counts[: self.single], tokens]) + 1.0
        self.shares = weight / weight.sum()
        #: log10 of what a word's count plus one is divided by within its class of rarer words; room for one word that was never seen
        self.log_within = np.log10(tokens + words + 1.0)
        self.class_of = np.concatenate([np.arange(self.single), self.single + hashed]).astype(np.int64)  # of the end and the head's words

    def codes(self, text: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """The text's tokens as places in ``counts``, the end last; their classes; and its words."""
        words = words_of(text)
        get, unknown = self.index.get, len(self.counts) - 1
        codes = np.fromiter(map(get, words, repeat(unknown)), np.int64, len(words))
        known = codes < unknown
        classes = np.empty(len(words), np.int64)
        classes[known] = self.class_of[codes[known]]
        rest = np.flatnonzero(~known)
        classes[rest] = [self.single + rare_class(words[i]) for i in rest.tolist()]
        return codes, classes, words

    def contexts(self, classes: list[np.ndarray], context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray]:
        """Contexts and classes of all tokens of some texts; before its first token a text has ends."""
        all_contexts, all_tokens = [], []
        for c in classes:
            tokens = np.append(c, 0)
            padded = np.concatenate([np.zeros(context, np.int64), tokens])
            all_contexts.append(np.stack([padded[context - 1 - k : len(padded) - 1 - k] for k in range(context)], axis=1))
            all_tokens.append(tokens)
        if not all_tokens:
            return np.zeros((0, context), np.int64), np.zeros(0, np.int64)
        return np.concatenate(all_contexts), np.concatenate(all_tokens)


#: Tokens whose contexts are held at a time; a longer text is cut with its context kept.
HELD_TOKENS = 1 << 18


def _groups(batches: Iterator[pa.RecordBatch], lexicon: Lexicon):
    """Texts of about HELD_TOKENS tokens together: the rows' other columns, codes, classes and words."""
    held, size = ([], [], [], []), 0
    for batch in batches:
        for row in batch.to_pylist():
            found = lexicon.codes(row.pop("text"))
            for column, value in zip(held, (row, *found), strict=True):
                column.append(value)
            size += len(found[0]) + 1
            if size >= HELD_TOKENS:
                yield held
                held, size = ([], [], [], []), 0
    if size:
        yield held


def _trainer(lexicon: Lexicon, start: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rng, seen = start.of_rows(start.rows()), np.random.default_rng(11), 0
        for _, _, classes, _ in _groups(batches, lexicon):
            contexts, tokens = lexicon.contexts(classes, len(start.place))
            order = rng.permutation(len(tokens))
            model.train(contexts[order], tokens[order], lexicon.shares, rng)
            seen += len(tokens)
        if seen:
            rows = model.rows().astype(np.float32)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), rows.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(np.full(len(rows), float(seen))), flat], ["i", "weight", "row"])

    return run


def train_model(docs: DataFrame, lexicon: Lexicon, dimensions: int = DIMENSIONS, context: int = CONTEXT, part_tokens: int = PART_TOKENS, rounds: int = ROUNDS, most_parts: int = MOST_PARTS) -> Model:
    """A model trained on all rows of ``docs`` (doc_id, text), each once.

    The rows are dealt to ``rounds`` by hash (one where they make one part), and
    those of a round to parts; a part trains from the mean of the models of the
    round before it, averaged by tokens. A part has ``part_tokens`` tokens, and
    more where ``most_parts`` would be exceeded; it is read as a stream.
    """
    model = Model.start(lexicon.shares, dimensions, context)
    place = F.xxhash64("doc_id", "text")
    rounds = min(rounds, -(-lexicon.total // part_tokens) or 1)
    parts = min(most_parts, -(-lexicon.total // (part_tokens * rounds)) or 1)
    mean = [(F.sum(F.col("row")[j] * F.col("weight")) / F.sum("weight")).alias(f"p{j}") for j in range(dimensions + 1)]
    for r in range(rounds):
        some = docs.select("text", place.alias("place")).where(F.pmod(F.shiftright("place", 40), F.lit(rounds)) == r)
        dealt = some.repartition(parts, "place").sortWithinPartitions("place")
        trained = dealt.select("text").mapInArrow(_trainer(lexicon, model), "i long, weight double, row array<float>")
        rows = trained.groupBy("i").agg(*mean).orderBy("i").collect()  # one row a class, a number that is fixed
        model = model.of_rows(np.array([x[1:] for x in rows])) if rows else model
    return model


def learn_lexicon(counts: DataFrame, ends: int, head_words: int = HEAD_WORDS, classes: int = CLASSES, own_count: int = OWN_COUNT) -> Lexicon:
    """From (word, n) of the training documents and their number: the counts of the ``head_words`` most frequent words.

    A histogram of the counts' logarithms, of some thousand rows, gives the level
    in which that rank lies; words above it all come, and of the level itself the
    first by count, then by word, so that ties neither lose words nor bring more.
    """
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    level = F.floor(F.log2("n") * 64)
    held, least, left = 0, None, 0
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        least, left = row["level"], head_words - held
        held += row["count"]
        if held >= head_words:
            break
    rows = []
    if least is not None:
        rows = counts.where(level > least).collect() + counts.where(level == least).orderBy(F.desc("n"), "word").limit(max(0, left)).collect()
    words = sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda w: (-w[1], w[0]))
    lexicon = Lexicon(words, total + ends, distinct + (ends > 0), ends, classes, None, own_count)
    if len(words) < distinct:
        hashed = (F.crc32("word") % RARE).cast("int").alias("c")
        every = np.zeros((2, RARE), np.int64)
        for r in counts.groupBy(hashed).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():  # RARE rows
            every[:, r["c"]] = r["n"], r["words"]
        for w, n in words:
            every[:, rare_class(w)] -= (n, 1)
        lexicon = Lexicon(words, total + ends, distinct + (ends > 0), ends, classes, every, own_count)
    return lexicon


_SCORED = "held_out boolean, row long, n_tokens long, head_known long, head_log double, class_log double, rare array<binary>, times array<long>"


def _scorer(lexicon: Lexicon, model: Model, id_type: pa.DataType):
    log_counts, context = np.log10(lexicon.counts + 1), len(model.place)
    unknown = len(lexicon.counts) - 1

    def sums(classes: list[np.ndarray]) -> list[float]:
        """The model's log10 probability of each text's classes."""
        lengths = np.array([len(c) + 1 for c in classes])
        contexts, tokens = lexicon.contexts(classes, context)
        logs = np.concatenate([model.log10_probabilities(contexts[i : i + HELD_TOKENS], tokens[i : i + HELD_TOKENS]) for i in range(0, len(tokens), HELD_TOKENS)])
        return np.add.reduceat(logs, np.cumsum(lengths) - lengths).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, codes, classes, words in _groups(batches, lexicon):
            out = {k: [] for k in ("doc_id", "held_out", "row", "n_tokens", "head_known", "head_log", "class_log", "rare", "times")}
            for row, c, k, w, class_log in zip(rows, codes, classes, words, sums(classes), strict=True):
                known = c[c < unknown]
                within = c[(c < unknown) & (k >= lexicon.single)]
                rare = Counter(w[i] for i in np.flatnonzero(c == unknown).tolist())
                for name in ("doc_id", "held_out", "row"):
                    out[name].append(row[name])
                out["n_tokens"].append(len(c) + 1)
                out["head_known"].append(len(known) + int(lexicon.counts[0] > 0))
                out["head_log"].append(float(log_counts[known].sum() + log_counts[0]))
                out["class_log"].append(class_log + float(log_counts[within].sum() - lexicon.log_within[k[k >= lexicon.single] - lexicon.single].sum()))
                out["rare"].append(list(rare.keys()))
                out["times"].append(list(rare.values()))
            kinds = (id_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out.values(), kinds, strict=True)], list(out))

    return run


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS, classes: int = CLASSES, own_count: int = OWN_COUNT) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The counts and the model learn from the rows where ``held_out`` (an
    expression over the columns of ``docs``) is false. ``base_score`` sums
    log10((c + 1) / (N + V + 1)) over the tokens; ``score`` is the model's log10
    probability of the text. Null text counts as empty and has one token, the
    end. Where nothing is left to learn from, all counts are zero. Texts of any
    length are read whole; rows that repeat are scored each on its own; other
    columns are not looked at; an empty table gives an empty result.
    """
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text_of(text_col).alias("text"))
    train = named.where("NOT held_out")
    counts = materialize(word_counts(train), "word-counts")
    lexicon = learn_lexicon(counts, train.count(), head_words, classes, own_count)
    model = train_model(train, lexicon)
    kind = named.schema["doc_id"].dataType
    score = _scorer(lexicon, model, to_arrow_type(kind))
    scored = named.withColumn("row", F.monotonically_increasing_id()).mapInArrow(score, f"doc_id {kind.simpleString()}, {_SCORED}")
    scored = materialize(scored, "scores")
    rare = scored.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    met = rare.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rest = met.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_log"),
    )
    total, size = lexicon.total, lexicon.total + lexicon.distinct + 1
    none = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + none("rare_known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_log") + none("rare_log") - F.col("n_tokens") * math.log10(size)).alias("base_score"),
        (F.col("class_log") + none("rare_log")).alias("score"),
    )
