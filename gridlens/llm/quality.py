"""Quality classifier: a label model over heuristic labellers, and a hashed linear scorer that it teaches.

Eleven heuristics vote good, poor or nothing on each text. Expectation-maximisation over the counts of vote patterns of
*all* documents estimates each labeller's accuracy and the share of poor texts, without any given label. The posterior
of a text's votes is the soft label of a logistic scorer over hashed words, hashed word shapes and binned text
statistics, fitted on a bounded sample.

Cases: null and empty texts get no vote, and as score the scorer's offset; texts are read whole; repeated rows each
get their score; an empty table gives no rows; columns other than the text aren't inputs; one named as the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import unused
from .common import WHITE, Words, encode, give_back, mix64, share, slices, table, tidy, with_columns

STATS = ("repeats", "symbols", "shouts", "capitals", "bars", "variety", "stops", "commonest", "word_length", "marked", "runs")
#: Per statistic: poor at or beyond the first bound, good at or beyond the second, no vote between; and the fewest words for a vote.
VOTES = {
    "repeats": (0.15, 0.03, 5),
    "symbols": (0.03, 0.005, 1),
    "shouts": (0.20, 0.03, 5),
    "capitals": (0.35, 0.12, 5),
    "bars": (0.10, 0.01, 5),
    "variety": (0.15, 0.40, 40),
    "stops": (0.005, 0.03, 40),
    "commonest": (0.35, 0.12, 20),
    "word_length": (16.0, 9.0, 5),
    "marked": (0.15, 0.03, 5),
    "runs": (0.20, 0.03, 5),
}
_LOWER_IS_POOR = frozenset({"variety", "stops"})
_BINS = 16
WORD_BITS, SHAPE_BITS = 15, 12
WIDTH = (1 << WORD_BITS) + (1 << SHAPE_BITS) + _BINS * len(STATS) + 1

_byte = np.arange(256)
_UPPER = (_byte >= 65) & (_byte <= 90)
_LETTER = _UPPER | (_byte >= 97) & (_byte <= 122) | (_byte >= 128)
_DIGIT = (_byte >= 48) & (_byte <= 57)
_MARK = np.isin(_byte, list(b"*%$&#@^~_=+<>\\{}[]"))
_PUNCTUATION = ~(WHITE | _LETTER | _DIGIT)
_CLASS = np.where(WHITE, 32, np.where(_UPPER, 65, np.where(_LETTER, 97, np.where(_DIGIT, 48, np.where(_MARK, 42, _byte))))).astype(np.uint8)


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[first[1:]] - total[first[:-1]]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Statistics (texts x STATS), words per text, and the hashed word and shape index of each word."""
    w = Words(texts)
    n_words = np.diff(w.first)
    n = np.maximum(n_words, 1).astype(np.float64)
    buf = w.buffer
    count = lambda mask: np.concatenate(([0], np.cumsum(mask[buf])))
    bound = np.concatenate((w.starts, [len(buf)]))
    text_at = bound[np.minimum(w.first, len(w.starts))]
    span = lambda c: (c[text_at[1:]] - c[text_at[:-1]]).astype(np.float64)
    letters, upper, marks = span(count(_LETTER)), span(count(_UPPER)), span(count(_MARK))
    shouts, stops, bars = span(count(_byte == 33)), span(count((_byte == 46) | (_byte == 44))), span(count(_byte == 124))
    bytes_in_words = _per_text((w.ends - w.starts).astype(np.float64), w.first)
    chars = np.maximum(bytes_in_words, 1)
    mark_count = count(_MARK)
    marked = _per_text(mark_count[w.ends] > mark_count[w.starts], w.first)
    doubled = np.zeros(len(buf), bool)
    doubled[1:] = (buf[1:] == buf[:-1]) & _PUNCTUATION[buf[1:]]
    runs = span(np.concatenate(([0], np.cumsum(doubled))))
    keys = w.hashes()
    same = np.zeros(len(keys), bool)
    same[1:] = keys[1:] == keys[:-1]
    same[w.first[:-1][w.first[:-1] < len(keys)]] = False
    of = np.repeat(np.arange(len(texts)), n_words)
    order = np.lexsort((keys, of))
    k, o = keys[order], of[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    start = np.flatnonzero(fresh)
    commonest = np.zeros(len(texts))
    np.maximum.at(commonest, o[start], np.diff(np.append(start, len(k))))
    distinct = np.bincount(o[start], minlength=len(texts))
    # the variety of a text falls with its length; the square root evens that out roughly
    variety = distinct / np.minimum(n, np.sqrt(n * 200))
    stats = np.stack((_per_text(same, w.first) / n, marks / chars, shouts / n, upper / np.maximum(letters, 1), bars / n, variety, stops / n, commonest / n, bytes_in_words / n, marked / n, runs / n), axis=1)
    kinds = _CLASS[buf]
    keep = np.ones(len(kinds), bool)
    keep[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == 32)
    shape = object.__new__(Words)
    shape.buffer = kinds[keep]
    at = np.cumsum(keep) - 1
    shape.starts, shape.ends = at[w.starts], at[w.ends - 1] + 1
    shape.first = w.first
    words = (keys >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    shapes = (mix64(shape.hashes()) >> np.uint64(64 - SHAPE_BITS)).astype(np.int64)
    return stats, n_words, words, shapes


def votes(stats: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Per text and labeller: 1 poor, -1 good, 0 nothing."""
    out = np.zeros(stats.shape, np.int8)
    for k, name in enumerate(STATS):
        poor, good, least = VOTES[name]
        x = -stats[:, k] if name in _LOWER_IS_POOR else stats[:, k]
        poor, good = (-poor, -good) if name in _LOWER_IS_POOR else (poor, good)
        out[:, k] = np.where(n_words < least, 0, np.where(x >= poor, 1, np.where(x <= good, -1, 0)))
    return out


def _bins(stats: np.ndarray) -> np.ndarray:
    """Each statistic in one of ``_BINS`` bins, finer near nought, as feature indexes."""
    scaled = np.column_stack([np.sqrt(np.clip(stats[:, k] / (4 * VOTES[n][0] if n not in _LOWER_IS_POOR else 2 * VOTES[n][1]), 0, 0.9999)) for k, n in enumerate(STATS)])
    return (1 << WORD_BITS) + (1 << SHAPE_BITS) + np.arange(len(STATS)) * _BINS + (scaled * _BINS).astype(np.int64)


@dataclass(frozen=True)
class LabelModel:
    """Share of poor texts; per labeller, the chances of voting poor and of voting good, given poor and given good."""

    poor: float
    given_poor: np.ndarray
    given_good: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Chance that a text with these votes is poor. Votes withheld count for neither side."""
        at = v.astype(int) + 1
        k = np.arange(v.shape[1])
        said = at != 1
        odds = np.log(self.poor / (1 - self.poor)) + np.where(said, np.log(self.given_poor[k, at] / self.given_good[k, at]), 0).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, start: float = 0.15, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over vote patterns. It starts from the majority of poor votes, which names the classes."""
    n, m = patterns.shape if len(patterns) else (0, len(STATS))
    given = np.full((2, m, 3), 1 / 3)
    if not n:
        return LabelModel(start, given[0], given[1])
    at = patterns.astype(int) + 1
    p = np.where((patterns == 1).sum(1) >= 1, 0.9, 0.02)
    poor = start
    for _ in range(rounds):
        for side, q in enumerate((p, 1 - p)):
            weight = q * counts
            for v in (0, 1, 2):
                given[side, :, v] = ((at == v) * weight[:, None]).sum(0)
            # a smoothed rate among the votes cast: an unused labeller says nothing about either class
            given[side] += np.array([[2.0, 0.0, 1.0]]) if side else np.array([[1.0, 0.0, 1.0]])
            given[side, :, [0, 2]] /= given[side, :, [0, 2]].sum(0)
        poor = float(np.clip((p * counts).sum() / counts.sum(), 1e-4, 0.5))
        model = LabelModel(poor, given[0].copy(), given[1].copy())
        last, p = p, model.posterior(patterns)
        if np.abs(p - last).max() < 1e-7:
            break
    return model


def _batch(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for lo, hi in slices(texts):
        yield features(texts[lo:hi])


def _row_indexes(n_words: np.ndarray, words: np.ndarray, shapes: np.ndarray, stats: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sparse features of each text: indexes and values."""
    ends = np.cumsum(n_words)
    bins = _bins(stats)
    for i, (e, n) in enumerate(zip(ends, n_words, strict=True)):
        own = np.concatenate((words[e - n : e], (1 << WORD_BITS) + shapes[e - n : e]))
        idx, c = np.unique(own, return_counts=True)
        yield np.concatenate((idx, bins[i])), np.concatenate((c / max(n, 1), np.ones(bins.shape[1])))


def fit_scorer(lengths: np.ndarray, idx: np.ndarray, val: np.ndarray, target: np.ndarray, ridge: float = 1e-4, rounds: int = 300, rate: float = 0.5) -> np.ndarray:
    """Logistic weights by adaptive gradient steps on soft labels; ``lengths``: how many of the features each row has."""
    weights = np.zeros(WIDTH)
    if not len(lengths):
        return weights
    of = np.repeat(np.arange(len(lengths)), lengths)
    idx = idx.astype(np.int64)
    seen = np.full(WIDTH, 1e-6)
    for _ in range(rounds):
        z = np.bincount(of, weights=val * weights[idx], minlength=len(lengths)) + weights[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(lengths)
        grad = np.bincount(idx, weights=val * err[of], minlength=WIDTH) + ridge * weights
        grad[-1] = err.sum()
        seen += grad * grad
        weights -= rate * grad / np.sqrt(seen)
    return weights


@dataclass(frozen=True)
class QualityModel:
    labels: LabelModel
    weights: np.ndarray

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Chance that each text is poor."""
        out = []
        for stats, n_words, words, shapes in _batch(texts):
            first = np.concatenate(([0], np.cumsum(n_words)))
            z = _per_text(self.weights[words] + self.weights[(1 << WORD_BITS) + shapes], first) / np.maximum(n_words, 1)
            out.append(z + np.where(n_words > 0, self.weights[_bins(stats)].sum(1), 0) + self.weights[-1])
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learn(docs: DataFrame, most_rows: int = 6_000, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """The label model from all rows; the scorer from ``most_rows`` rows at most, chosen by a hash of their ids and texts."""
    rows = docs.select(F.xxhash64(docs[id_col], docs[text_col]).alias("key"), docs[text_col].alias("text"))
    m = len(STATS)

    def patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = [((votes(s, n).astype(np.int64) + 1) * 3 ** np.arange(m)).sum(1) for s, n, _, _ in _batch([encode(t) for t in b["text"]])]
            key, count = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
            yield pd.DataFrame({"pattern": key, "n": count})

    # 3 ** 11 patterns at most
    seen = rows.select("text").mapInPandas(tidy(patterns), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toPandas()
    codes = seen["pattern"].to_numpy(dtype=np.int64)
    labels = fit_labels((codes[:, None] // 3 ** np.arange(m) % 3 - 1).astype(np.int8), seen["n"].to_numpy(dtype=float))
    total = int(seen["n"].sum())
    # some more than wanted, as the number that a hash picks varies
    share = min(1.0, 1.1 * most_rows / max(total, 1))
    chosen = rows.where(F.pmod("key", F.lit(1 << 30)) < int(share * (1 << 30)) + 1)

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[int] = set()
        for b in batches:
            b = b[~b["key"].duplicated() & ~b["key"].isin(met)]
            met.update(b["key"].tolist())
            at = 0
            for stats, n_words, words, shapes in _batch([encode(t) for t in b["text"]]):
                got = list(_row_indexes(n_words, words, shapes, stats))
                yield pd.DataFrame({"key": b["key"].to_numpy()[at : at + len(got)], "target": labels.posterior(votes(stats, n_words)), "n": n_words, "idx": [g[0].astype(np.int32) for g in got], "val": [g[1].astype(np.float32) for g in got]})
                at += len(got)

    got = chosen.mapInPandas(tidy(sparse), "key long, target double, n long, idx array<int>, val array<float>").where("n > 0")
    got = got.dropDuplicates(["key"]).orderBy("key").limit(most_rows).select("target", "idx", "val").toArrow().combine_chunks()
    flat = lambda c: np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in got.column(c).chunks] or [np.zeros(0)])
    lengths = np.concatenate([np.diff(x.offsets.to_numpy()) for x in got.column("idx").chunks] or [np.zeros(0, int)])
    weights = fit_scorer(lengths, flat("idx"), flat("val"), got.column("target").to_numpy())
    give_back()
    return QualityModel(labels, weights)


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "poor_score") -> DataFrame:
    """``docs`` with ``poor_score``."""
    shared = share(docs.sparkSession, model)  # of fixed size
    return with_columns(docs, text_col, [T.StructField(score_col, T.DoubleType())], lambda texts: [pa.array(shared().score(texts))])


THRESHOLD = 0.5


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, learn(docs))
    return found.select("doc_id", (1 - F.col("poor_score")).alias("score"), (F.col("poor_score") < THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents judged poor go; all columns stay."""
    named = unused(docs.columns, "poor_score")
    return score(docs, learn(docs), score_col=named).where(F.col(named) < THRESHOLD).drop(named)
