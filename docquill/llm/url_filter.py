"""URL filters: rules first, then logistic regression on hashed character n-grams.

Host and path give n-grams of 3 to 5 characters, with marks around each part so
that a beginning or an end counts; an n-gram is hashed to one of ``buckets``
weights. The model is fitted in numpy on a small labelled table of URLs, which
is a parameter. Scoring is one vectorised pass over a batch: rolling hashes of
all places at once, weights by lookup, and sums by URL.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquill.llm.url_table import labelled_urls


@dataclass(frozen=True)
class Rule:
    """``allow`` or block for a host with its subdomains, where the path begins with the rule's."""

    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (Rule("org", "/", True), Rule("example.org", "/es/", False), Rule("example.org", "/en/1", False), Rule("com", "/fr/", True), Rule("com", "/de/", False))

SIZES, BUCKETS, THRESHOLD = (3, 4, 5), 1 << 16, 0.5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _ngrams(texts: list[bytes], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of the text) of every n-gram of the texts."""
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    hashes, owners = [], []
    for n in sizes:
        if len(data) < n:
            continue
        h = np.zeros(len(data) - n + 1, np.uint64)
        for k in range(n):
            h = (h ^ data[k : len(data) - n + 1 + k]) * _STEP
            h ^= h >> np.uint64(29)
        inside = owner[: len(h)] == owner[n - 1 :]
        hashes.append((h[inside] + np.uint64(n)) % np.uint64(buckets))
        owners.append(owner[: len(h)][inside])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *hashes]).astype(np.int64), np.concatenate([none, *owners])


class UrlModel:
    """Weights of hashed n-grams of hosts and, in buckets of their own, of paths."""

    def __init__(self, sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS) -> None:
        self.sizes, self.buckets = sizes, buckets
        self.weights, self.bias = np.zeros(2 * buckets), 0.0

    def _features(self, hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = []
        for i, texts in enumerate((hosts, paths)):
            marked = [b"\x02" + t.encode("utf-8", "replace") + b"\x03" for t in texts]
            bucket, row = _ngrams(marked, self.sizes, self.buckets)
            parts.append((bucket + i * self.buckets, row))
        bucket, row = (np.concatenate(x) for x in zip(*parts, strict=True))
        return bucket, row, np.sqrt(np.maximum(np.bincount(row, minlength=len(hosts)), 1))

    def probabilities(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Of being unwanted."""
        bucket, row, scale = self._features(hosts, paths)
        margin = np.bincount(row, self.weights[bucket], len(hosts)) / scale + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

    def fit(self, hosts: list[str], paths: list[str], labels: np.ndarray, rounds: int = 150, rate: float = 0.5, penalty: float = 0.01) -> UrlModel:
        """Gradient steps on the logistic loss with a quadratic penalty, scaled by each weight's past gradients; the same table gives the same model."""
        bucket, row, scale = self._features(hosts, paths)
        past, past_bias = np.full(len(self.weights), 1e-8), 1e-8
        for _ in range(rounds):
            error = self.probabilities(hosts, paths) - labels
            slope = np.bincount(bucket, (error / scale)[row], len(self.weights)) + penalty * self.weights
            past, past_bias = past + slope**2, past_bias + error.sum() ** 2
            self.weights -= rate * slope / np.sqrt(past)
            self.bias -= rate * error.sum() / np.sqrt(past_bias)
        return self


def _split(url: str) -> tuple[str, str]:
    rest = url.split("://", 1)[1]
    host = rest.replace("?", "/").replace("#", "/").split("/", 1)[0]
    return host.lower(), rest[len(host) :].split("?", 1)[0].split("#", 1)[0]


def train_url_model(table: list[tuple[str, int]] | None = None) -> UrlModel:
    """A model from (url, 1 for unwanted) rows; the table is small and stays on the driver."""
    table = labelled_urls() if table is None else table
    parts = [_split(u) for u, _ in table]
    return UrlModel().fit([h for h, _ in parts], [p for _, p in parts], np.array([y for _, y in table], float))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, model: UrlModel | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score.

    The longest rule that fits decides; without one the model does: block if the
    probability of being unwanted is ``threshold`` or more. A null url, or one
    without ``://``, has an empty host and path, fits no rule and is judged by
    the model as it stands. Urls of any length are judged whole and rows that
    repeat each; other columns are not looked at; an empty table gives an empty
    result.
    """
    model = train_url_model() if model is None else model

    @F.pandas_udf("double")
    def unwanted(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series(model.probabilities(host.tolist(), path.tolist()), dtype=float)

    url = F.col(f"`{url_col}`")
    parts = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, allow = F.when(fits, r.name).otherwise(rule), F.when(fits, F.lit(r.allow)).otherwise(allow)
    scored = parts.select("*", rule.alias("rule"), allow.alias("allow"), unwanted("host", "path").alias("score"))
    allowed = F.coalesce("allow", F.col("score") < threshold)
    return scored.select("page_id", "host", "path", "rule", F.when(allowed, "allow").otherwise("block").alias("verdict"), "score")
