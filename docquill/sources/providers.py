"""Model calls behind interfaces: what is sent and how it is batched is ours, the call is the provider's."""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class EmbeddingProvider(ABC):
    dimensions: int
    name: str

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class TextProvider(ABC):
    name: str

    @abstractmethod
    def complete(self, prompts: list[str]) -> list[str | None]: ...


class HashEmbeddingDouble(EmbeddingProvider):
    """A test double: vectors from word hashes. It is no model."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions, self.name = dimensions, f"test-double-{dimensions}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dimensions)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dimensions] += 1 if h >> 63 else -1
            out.append((v / (np.linalg.norm(v) or 1)).tolist())
        return out


class EchoTextDouble(TextProvider):
    """A test double: repeats the prompt's last line."""

    name = "test-double-echo"

    def complete(self, prompts: list[str]) -> list[str | None]:
        return [p.rsplit("\n", 1)[-1] if p else None for p in prompts]


def embed(chunks: DataFrame, provider: EmbeddingProvider, id_col: str = "chunk_id", text_col: str = "content", batch: int = 100) -> DataFrame:
    """(id, vector) of every chunk, ``batch`` texts a call, where the chunks are."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame[at : at + batch]
                yield pd.DataFrame({id_col: part[id_col], "vector": provider.embed(part[text_col].fillna("").tolist())})

    kind = chunks.schema[id_col].dataType.simpleString()
    return chunks.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, vector array<float>")


def complete(prompts: DataFrame, providers: list[TextProvider], id_col: str, prompt_col: str, canned: str, batch: int = 5) -> DataFrame:
    """(id, answer): the first provider that answers, else the canned text; ``batch`` prompts a call."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame[at : at + batch]
                answers: list[str | None] = [None] * len(part)
                for p in providers:
                    open_ = [i for i, a in enumerate(answers) if a is None]
                    if not open_:
                        break
                    for i, a in zip(open_, p.complete([part[prompt_col].iloc[i] or "" for i in open_]), strict=True):
                        answers[i] = a
                yield pd.DataFrame({id_col: part[id_col], "answer": [canned if a is None else a for a in answers]})

    kind = prompts.schema[id_col].dataType.simpleString()
    return prompts.select(id_col, prompt_col).mapInPandas(run, f"{id_col} {kind}, answer string")


def answer_prompt(question: Column, context: Column, language: str = "English") -> Column:
    return F.concat_ws("\n", F.lit(f"Answer in {language}, from the excerpts only, and name the document and page of each statement."), F.concat(F.lit("Question: "), question), F.lit("Excerpts:"), context)


def caption_prompt(kind: Column, context: Column, most: int = 1500) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Describe this "), kind, F.lit(" of a document.")), F.concat(F.lit("Text around it: "), F.substring(F.coalesce(context, F.lit("")), 1, most)))


def query_variants(queries: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, kind, text): the original and each rewrite that is switched on, to be filled by a provider; none is by default."""
    return queries.select("query_id", "text", F.explode(F.array(*[F.lit(k) for k in ("original", *kinds)])).alias("kind"))


#: The rewrites of a query, each of which may be switched on.
REWRITES = ("semantic", "hyde", "formal")


def rewritten(variants: DataFrame, providers: list[TextProvider], batch: int = 5) -> DataFrame:
    """``variants`` (query_id, kind, text) with the rewrites' texts from the first provider that answers; without an answer the original's text stays."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            wanted = [i for i, kind in enumerate(frame["kind"]) if kind != "original"]
            for at in range(0, len(wanted), batch):
                open_ = wanted[at : at + batch]
                for p in providers:
                    answers = p.complete([f"Rewrite the question ({frame['kind'].iloc[i]}).\n{frame['text'].iloc[i]}" for i in open_])
                    for i, a in zip(open_, answers, strict=True):
                        texts[i] = a or texts[i]
                    open_ = [i for i, a in zip(open_, answers, strict=True) if not a]
                    if not open_:
                        break
            yield frame.assign(text=texts)

    return variants.select("query_id", "kind", "text").mapInPandas(run, variants.select("query_id", "kind", "text").schema)
