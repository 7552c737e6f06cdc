"""Quality classifier by positive-unlabelled learning.

A logistic model of style features (shares of neighbouring byte classes, repeats, word length; no
words) is fitted on trusted positives and unlabelled web text by the
non-negative unbiased risk: ``prior * L+(positives) + max(0, L-(unlabelled) - prior * L-(positives))``.
The class prior is estimated from the same two samples, as the smallest ratio of unlabelled to positive
mass over the upper level sets of a first model.  Labels of negatives aren't used.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, release, table, text_or_empty

#: The bound of the two fitting samples, in rows; every text is scored whole.
POSITIVES = 4_000
UNLABELLED = 8_000
THRESHOLD = 0.7
CLASSES = 16


def _class_table() -> bytes:
    kinds = {"A-Z": 1, "0-9": 2, " ": 3, "\n": 4, ".": 5, ",": 6, "!": 7, "?": 8, "|": 9, "'\"`": 10, "-_": 11, "#$%&*+=^~@<>": 12, "()[]{}/\\": 13, ":;": 14}
    table_ = bytearray(256)  # lower-case letters and bytes above 127 are class 0
    table_[:32] = bytes([15]) * 32
    table_[127] = 15
    for chars, kind in kinds.items():
        chars = {"A-Z": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0-9": "0123456789"}.get(chars, chars)
        for c in chars:
            table_[ord(c)] = kind
    return bytes(table_)


_CLASS = _class_table()
N_FEATURES = CLASSES * CLASSES + 4


def features(texts: list[str]) -> np.ndarray:
    """Of each text: shares of pairs of neighbouring character classes, repeats of words, word length, length."""
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    for row, text in zip(out, texts):
        raw = text.encode("utf-8", "replace")
        kinds = np.frombuffer(raw.translate(_CLASS), np.uint8)
        if len(kinds) > 1:
            pairs = np.bincount((kinds[:-1] << 4) | kinds[1:], minlength=CLASSES * CLASSES)
            row[: CLASSES * CLASSES] = np.sqrt(pairs / (len(kinds) - 1))
        words = raw.split()
        n = len(words)
        if n:
            row[-4] = sum(map(eq, words, words[1:])) / n
            row[-3] = min(len(set(words)), 2 * n**0.7) / n**0.7
            row[-2] = np.log1p(len(raw) / n)
        row[-1] = np.log1p(len(raw)) / 10
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class QualityModel:
    """Weights over standardised features."""

    def __init__(self, positives: np.ndarray, unlabelled: np.ndarray):
        both = np.concatenate([positives, unlabelled]).astype(np.float64)
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 0.02
        p, u = self._standard(positives), self._standard(unlabelled)
        first = self._fit(p[::2], u[::2], 0.5, False)
        self.prior = self._estimated_prior(p[1::2] @ first, u[1::2] @ first)
        self.weights = self._fit(p, u, self.prior, True)

    def _standard(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    @staticmethod
    def _estimated_prior(p: np.ndarray, u: np.ndarray) -> float:
        """P(unlabelled above t) >= prior * P(positive above t) for every t; where positives are many."""
        cuts = np.quantile(p, np.linspace(0.02, 0.5, 49)) if len(p) else np.zeros(0)
        ratios = [(u >= t).mean() / max((p >= t).mean(), 1e-9) for t in cuts]
        return float(np.clip(min(ratios, default=0.5), 0.05, 0.98))

    @staticmethod
    def _fit(p: np.ndarray, u: np.ndarray, prior: float, pu: bool, rounds: int = 400) -> np.ndarray:
        w = np.zeros(p.shape[1])
        mean, var = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, rounds + 1):
            sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
            up = -prior * (p.T @ (1 - sp)) / len(p)  # gradient of prior * L+(positives)
            down_u, down_p = (u.T @ su) / len(u), (p.T @ sp) / len(p)
            if pu:
                risk = -np.log(np.maximum(1 - su, 1e-12)).mean() + prior * np.log(np.maximum(1 - sp, 1e-12)).mean()
                grad = up + down_u - prior * down_p if risk >= 0 else prior * down_p - down_u
            else:
                grad = up + (1 - prior) * down_u
            grad += 1e-3 * np.r_[w[:-1], 0]
            mean, var = 0.9 * mean + 0.1 * grad, 0.999 * var + 0.001 * grad**2
            w -= 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.999**t)) + 1e-8)
        return w

    def score(self, texts: list[str]) -> np.ndarray:
        return _sigmoid(self._standard(features(texts)) @ self.weights) if texts else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel | None:
    """A model from trusted positives among the rows that may be learnt from; None where there are none.

    Both samples come in order of a hash of the id, whatever the storage; features are computed where
    the texts are, and only the sample's features come to the driver.
    """
    h = F.xxhash64("doc_id")
    may = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    trusted = labels.filter((F.col("quality") == 1) & may).select("doc_id").distinct().orderBy(h, "doc_id").limit(POSITIVES)

    def of(rows: DataFrame, most: int) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"h": batch["h"], "x": list(features(batch["text"].tolist()))})

        found = bounded_batches(rows).select(h.alias("h"), text_or_empty().alias("text")).mapInPandas(run, "h long, x array<float>").orderBy("h", "x").limit(most).toPandas()
        return np.stack(found["x"].to_list()) if len(found) else np.zeros((0, N_FEATURES), np.float32)

    ids = [r["doc_id"] for r in trusted.collect()]
    chosen = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")  # POSITIVES rows at most
    positives = of(docs.join(F.broadcast(chosen), "doc_id"), POSITIVES)
    last = docs.select(h.alias("h")).orderBy("h").limit(UNLABELLED).agg(F.max("h")).first()[0]
    if last is None or not len(positives):
        return None
    return QualityModel(positives, of(docs.filter(h <= last), UNLABELLED))


def _scores(docs: DataFrame, model: QualityModel | None):
    shared = bounded_batches(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        release()
        if shared.value is None:
            return pd.Series(np.ones(len(text)))
        texts = text.tolist()
        return pd.Series(np.concatenate([shared.value.score(texts[k : k + 1000]) for k in range(0, len(texts), 1000)] or [np.zeros(0)]))

    return score(text_or_empty())


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for each row of *docs*.

    A null text is scored as an empty one.  Where there is no trusted positive to learn from, nothing
    speaks against a text and every score is 1.  Rows with a null id are scored, not held out.
    Very long texts are scored whole.  Rows that tie for the last place of a sample are taken by id and
    features; a score that is exactly the threshold is predicted 1.  Repeated rows give equal results;
    other columns are ignored; an empty table gives none.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    scored = docs.select("doc_id", held_out.alias("held_out"), _scores(docs, fit(docs, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def good_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of *docs* that are predicted good, with all their columns, repeated ones too; nulls and ties as in :func:`score_quality`."""
    return docs.filter(_scores(docs, fit(docs, labels)) >= THRESHOLD)


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
