"""Toxicity by maximum-scoring segments of token log-odds, calibrated by an extreme-value law.

Learning: token counts by class come from a bounded sample of labelled texts. A token's share of toxic texts has a
Dirichlet prior centred on the share of tokens with the same first 8 bytes, that one on the same first 6, then 4, then
all; its score is the log-odds against the overall share, less ``drift``; a positive token's repeat within a few words counts
a quarter. Scoring: one linear scan finds all maximal-scoring segments of
a text (Ruzzo and Tompa 1999). Their scores are put on the scale of Gumbel's law for texts of that length, fitted on
clean labelled texts, the significant ones are summed (or the best one counts, if none is), and a logistic curve maps
that to 0..1.

Cases: null and empty texts have no token and get the score of a text without significant segment; texts are read
whole; labels that are null or whose id is null are ignored, and of several labels of one id the highest counts;
repeated rows each get their score; with labels of one class only, or none, every score is the smoothed class share;
an empty table gives no rows; an input column named as a result is replaced. Ids, languages and sources are never inputs
of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import unused
from .common import Words, encode, give_back, materialize, separators, share, slices, table, tidy, with_columns

SEPS = separators(b".,!?;:\"'()[]{}|<>*%$&#/\\+=~`^_-")
#: A repeat within so many words of the token's last occurrence counts by this share.
NEAR, REPEAT = 32, 0.25
#: Bytes of a token's beginnings, the longest last.
ROOTS = (4, 6, 8)


@dataclass(frozen=True)
class SegmentModel:
    """For each of ROOTS and for whole tokens: sorted keys with their toxic and clean text counts. And the calibration."""

    tables: tuple[tuple[np.ndarray, np.ndarray], ...]
    base: float
    weight: float
    drift: float
    scale: float = 1.0
    size: float = 0.1
    slope: float = 1.0
    offset: float = 0.0

    def evidence(self, score: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Natural log of one over the expected number of such segments in a clean text of that length."""
        return self.scale * score - np.log(self.size * np.maximum(length, 1))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.offset, -30, 30)))


def _lookup(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros((len(wanted), 2))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], counts[at], 0)


def token_scores(m: SegmentModel, keys: list[np.ndarray], left_out: np.ndarray | None = None) -> np.ndarray:
    """Log-odds less drift from the keys of beginnings and whole tokens. ``left_out``: the class of each token's text,
    whose own count is taken out (training)."""
    words = keys[-1]
    unique, inverse = np.unique(words if left_out is None else words + left_out.astype(np.uint64), return_inverse=True)
    first = np.zeros(len(unique), dtype=np.int64)
    first[inverse] = np.arange(len(words))
    share = m.base
    for (known, counts), k in zip(m.tables, keys, strict=True):
        seen = _lookup(known, counts, k[first]).astype(float)
        if left_out is not None:
            seen = np.maximum(seen - np.stack((left_out[first] == 1, left_out[first] == 0), axis=1), 0)
        share = (seen[:, 0] + m.weight * share) / (seen.sum(1) + m.weight)
    odds = np.log(share / (1 - share)) - np.log(m.base / (1 - m.base))
    return (odds - m.drift)[inverse]


def _keys(w: Words) -> list[np.ndarray]:
    return [*(w.hashes(n) for n in ROOTS), w.hashes()]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of one sequence, in linear time."""
    up = scores > 0
    if not up.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate(([False], up, [False]))))
    begin, stop = edge[0::2], edge[1::2]
    total = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[list] = []  # start, end, sum before, sum at the end, index of the last one with a smaller sum before
    for s, e, low, high in zip(begin.tolist(), stop.tolist(), total[begin].tolist(), total[stop].tolist(), strict=True):
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append([s, e, low, high, j])
                break
            s, low = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, high - low) for s, e, low, high, _ in found]


def _scan(m: SegmentModel, texts: list[bytes], labels: np.ndarray | None = None) -> Iterator[tuple[int, list[tuple[int, int, float]], Words, int]]:
    """Per text: number of tokens, segments (word indexes within the batch), the batch's words, and its first word."""
    for lo, hi in slices(texts):
        w = Words([t.lower() for t in texts[lo:hi]], SEPS)
        left = None if labels is None else np.repeat(labels[lo:hi], np.diff(w.first))
        keys = _keys(w)
        scores = token_scores(m, keys, left)
        # counts are of texts, so a token's repeat close by says less; further off it is a passage of its own
        up = np.flatnonzero(scores > 0)
        of = np.repeat(np.arange(hi - lo), np.diff(w.first))[up]
        order = np.lexsort((up, keys[-1][up], of))
        again = np.zeros(len(up), bool)
        place, key = up[order], keys[-1][up][order]
        again[1:] = (of[order][1:] == of[order][:-1]) & (key[1:] == key[:-1]) & (place[1:] - place[:-1] <= NEAR)
        scores[place[again]] *= REPEAT
        for i in range(hi - lo):
            a, b = w.first[i], w.first[i + 1]
            yield int(b - a), [(s + a, e + a, v) for s, e, v in maximal_segments(scores[a:b])], w, int(a)


def _counts(sample: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Texts by class that hold a token, or a token's beginning, for all that occur in the sample."""

    def merged(parts: list[tuple]) -> tuple:
        keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, *(np.bincount(at, weights=np.concatenate([p[k] for p in parts]), minlength=len(keys)).astype(np.int64) for k in (1, 2))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list[tuple]] = [[] for _ in range(len(ROOTS) + 1)]
        for b in batches:
            texts, labels = [encode(t).lower() for t in b["text"]], b["label"].to_numpy()
            for lo, hi in slices(texts):
                w = Words(texts[lo:hi], SEPS)
                of = np.repeat(np.arange(hi - lo), np.diff(w.first))
                for kind, keys in enumerate(_keys(w)):
                    order = np.lexsort((of, keys))
                    k, o = keys[order], of[order]
                    once = np.ones(len(k), bool)
                    once[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
                    k, y = k[once], labels[lo:hi][o[once]]
                    if len(k):
                        start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
                        held[kind].append((k[start], np.add.reduceat(y, start), np.diff(np.append(start, len(k)))))
                    # counts of a task meet here before they are sent on
                    if len(held[kind]) >= 16:
                        held[kind] = [merged(held[kind])]
                        if len(held[kind][0][0]) > 300_000:
                            yield out(kind, held[kind].pop())
        for kind, parts in enumerate(held):
            if parts:
                yield out(kind, merged(parts))

    def out(kind: int, part: tuple) -> pd.DataFrame:
        return pd.DataFrame({"kind": kind, "key": part[0].view(np.int64), "toxic": part[1], "n": part[2]})

    counted = sample.select("text", "label").mapInPandas(tidy(run), "kind int, key long, toxic long, n long").groupBy("kind", "key").agg(F.sum("toxic").cast("int").alias("toxic"), F.sum("n").cast("int").alias("n"))
    counted = materialize(counted, "toxic-counts")
    out = []
    for kind in range(len(ROOTS) + 1):
        found = counted.where(F.col("kind") == kind).select("key", "toxic", "n").toArrow()  # as many as the sample's words at most
        keys, toxic, n = (found.column(c).to_numpy() for c in ("key", "toxic", "n"))
        order = np.argsort(keys.view(np.uint64))
        out.append((keys.view(np.uint64)[order], np.stack((toxic, n - toxic), axis=1)[order]))
        give_back()
    return tuple(out)


def _gumbel(best: np.ndarray, length: np.ndarray) -> tuple[float, float]:
    """Scale and size of P(best < s) = exp(-size * length * exp(-scale * s)) by maximum likelihood; no segment counts as s <= 0."""
    length = np.maximum(length, 1).astype(float)
    some = best > 0
    if some.sum() < 20:
        return 1.0, 0.1
    scales, score = np.geomspace(0.05, 20, 121), []
    for lam in scales:
        size = some.sum() / (length[some] * np.exp(-lam * best[some])).sum() if not (~some).any() else some.sum() / ((length[some] * np.exp(-lam * best[some])).sum() + length[~some].sum())
        score.append((np.log(size * length[some] * lam) - lam * best[some] - size * length[some] * np.exp(-lam * best[some])).sum() - (size * length[~some]).sum())
    lam = scales[int(np.argmax(score))]
    return float(lam), float(some.sum() / ((length[some] * np.exp(-lam * best[some])).sum() + length[~some].sum()))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with a slight ridge. A step is halved until it lowers the loss: where classes are
    nearly apart, whole steps lead away from the best fit."""
    a, ridge = np.stack((x, np.ones_like(x)), axis=1), np.array([0.05, 0.01])

    def loss(beta: np.ndarray) -> float:
        z = a @ beta
        return float((np.logaddexp(0, z) - y * z).sum() + (ridge * beta**2).sum() / 2)

    beta = np.zeros(2)
    now = loss(beta)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        down = a.T @ (y - p) - ridge * beta
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), down)
        while (then := loss(beta + step)) > now - 1e-4 * (down @ step) and np.abs(step).max() > 1e-9:
            step /= 2
        if then >= now:
            break
        beta, now = beta + step, then
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def _summed(m: SegmentModel, segments: np.ndarray, length: int) -> float:
    """Sum of the evidence of significant segments; without any, that of the best segment, which is below nought."""
    e = m.evidence(np.append(segments, 0.0), np.full(len(segments) + 1, length))
    return float(e[e > 0].sum() or e.max())


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = 50_000, weight: float = 4.0, drift: float = 2.0, most_bytes: int = 128 << 20) -> SegmentModel:
    """``docs``: doc_id, text; ``labels``: doc_id, label 0/1. At most ``most_rows`` labelled rows with texts of ``most_bytes``
    in all, by a hash of the id, are learned from: some 20 million words, which bounds the model's tables."""
    named = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("long").alias("label"))
    picked = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    named_docs = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # most_rows bounds the broadcast
    # an id that stands on many rows is learned from once
    sample = materialize(named_docs.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label")), "toxic-sample")
    long = F.coalesce(F.octet_length("text"), F.lit(0))
    if (sample.agg(F.sum(long)).first()[0] or 0) > most_bytes:
        upto = F.sum(long).over(Window.partitionBy(F.lit(1)).orderBy(F.xxhash64("doc_id"), "doc_id"))  # most_rows rows, without their texts
        fits = sample.select("doc_id", upto.alias("upto"))
        sample = materialize(sample.join(F.broadcast(fits.where(F.col("upto") <= most_bytes).select("doc_id")), "doc_id"), "toxic-sample")
    classes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    pos, neg = classes.get(1, 0), classes.get(0, 0)
    m = SegmentModel(_counts(sample), (pos + 0.5) / (pos + neg + 1), weight, drift)
    if not pos or not neg:
        return replace(m, tables=tuple((k[:0], c[:0]) for k, c in m.tables), slope=0.0, offset=float(np.log(m.base / (1 - m.base))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            y = b["label"].to_numpy()
            rows = [(n, np.array([s[2] for s in seg])) for n, seg, _, _ in _scan(m, [encode(t) for t in b["text"]], y)]
            yield pd.DataFrame({"label": y, "n": [r[0] for r in rows], "segments": [r[1] for r in rows]})

    seen = materialize(sample.select("text", "label").mapInPandas(tidy(run), "label long, n long, segments array<double>"), "toxic-segments")
    clean = seen.where("label = 0").select("n", F.coalesce(F.array_max("segments"), F.lit(0.0)).alias("best")).toPandas()  # two numbers a row of the sample
    scale, size = _gumbel(clean["best"].to_numpy(), clean["n"].to_numpy())
    m = replace(m, scale=scale, size=size)
    law = replace(m, tables=())

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"label": b["label"], "x": [_summed(law, np.asarray(s, dtype=float), n) for s, n in zip(b["segments"], b["n"], strict=True)]})

    pdf = seen.mapInPandas(tidy(sums), "label long, x double").toPandas()
    slope, offset = _logistic(np.minimum(pdf["x"].to_numpy(), 40), pdf["label"].to_numpy())
    give_back()
    return replace(m, slope=slope, offset=offset)


def score(docs: DataFrame, model: SegmentModel, passages: bool = True, text_col: str = "text", score_col: str = "toxic_score") -> DataFrame:
    """``docs`` with ``toxic_score`` and, if asked for, ``toxic_passages``: array<struct<text, evidence>>."""
    shared = share(docs.sparkSession, model)  # bounded by the words of the sample that learn() takes
    extra = [T.StructField(score_col, T.DoubleType())]
    if passages:
        extra.append(T.StructField("toxic_passages", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("evidence", T.DoubleType())]))))

    def made(texts: list[bytes]) -> list[pa.Array]:
        m = shared()
        sums, found = [], []
        for n, seg, w, _ in _scan(m, texts):
            best = np.array([s[2] for s in seg])
            sums.append(_summed(m, best, n))
            if passages:
                e = m.evidence(best, np.full(len(seg), n))
                found.append([{"text": w.buffer[w.starts[s] : w.ends[t - 1]].tobytes().decode("utf-8", "replace"), "evidence": float(v)} for (s, t, _), v in zip(seg, e, strict=True) if v > 0])
        out = [pa.array(m.probability(np.minimum(np.array(sums, dtype=float), 40)))]
        return [*out, pa.array(found, pa.list_(pa.struct([("text", pa.string()), ("evidence", pa.float64())])))] if passages else out

    return with_columns(docs, text_col, extra, made)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> SegmentModel:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return learn(docs, labels.select("doc_id", F.col("toxic").alias("label")))


THRESHOLD = 0.7


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, trained(spark, docs, sf_dir))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("toxic_passages").alias("n_passages"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents judged toxic go; all columns stay."""
    named = unused(docs.columns, "toxic_score")
    found = score(docs, trained(spark, docs, sf_dir), passages=False, score_col=named)
    return found.where(F.col(named) < THRESHOLD).drop(named)
