"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised by codebooks of their own; a pair of centroids is a cell. A query walks the cells
in the order of their summed distances with a heap until they hold enough vectors; those are ranked by the exact
Euclidean distance in double precision.

Every usable row is indexed. Equal vectors are indexed once with their ``k + 1`` smallest ids, which loses no answer,
as ties go to smaller ids. All cells of one first centroid form a slab, cut into blocks of ``block`` vectors, so that a
crowded cell is many small tasks; a query goes to a block once, with the list of the cells that it visits there.

Cases: vectors that are null, zero, or with null or non-finite components take no part, nor do rows without id; vectors
of different lengths have no distance, so each length is searched on its own; fewer than ``k`` candidates are all returned; a query without candidates returns no row;
repeated rows count once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, tidy


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_squared(x[lo : lo + 4096], c).argmin(1) for lo in range(0, len(x), 4096)] or [np.zeros(0, int)])


def cells_in_order(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray | dict[tuple[int, int], int], enough: int) -> list[tuple[int, int]]:
    """Non-empty cells by ascending ``d1[i] + d2[j]`` until they hold ``enough`` vectors; ``sizes``: how many each holds."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, pushed, found, held = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, a, b = heapq.heappop(heap)
        cell = (int(o1[a]), int(o2[b]))
        if n := int(sizes[cell]) if isinstance(sizes, np.ndarray) else sizes.get(cell, 0):
            found.append(cell)
            held += n
        for step in ((a + 1, b), (a, b + 1)):
            if step[0] < len(o1) and step[1] < len(o2) and step not in pushed:
                pushed.add(step)
                heapq.heappush(heap, (d1[o1[step[0]]] + d2[o2[step[1]]], *step))
    return found


def search(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    sample: int = 16384,
    per_cell: int = 16,
    most_centroids: int = 1024,
    visit: float | None = None,
    least: int = 1024,
    aim: float = 0.96,
    block: int = 2048,
    rounds: int = 12,
    seed: int = 7,
) -> DataFrame:
    """Columns query_id, rank, vec_id, score; ``queries`` is a condition on ``vec_id``.

    The codebooks are fitted on ``sample`` vectors at most, taken by a hash of their ids. They have about
    sqrt(n / per_cell) centroids, ``most_centroids`` at most, so what is broadcast has a fixed bound. A query visits
    cells until they hold the share ``visit`` of the distinct vectors, ``least`` at least. If no share is given, it is
    measured: for 128 of the queries the exact neighbours are sought among all vectors, and the share is chosen that
    finds ``aim`` of them. Vectors without any cluster structure need about half of all; data with clusters do with far less.
    """
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    found = None
    for r in rows.select(F.size("v").alias("dim")).distinct().orderBy("dim").collect():  # one row a length
        one = _search(rows.where(F.size("v") == r["dim"]), queries, r["dim"], kind, k, sample, per_cell, most_centroids, visit, least, aim, block, rounds, seed)
        found = one if found is None else found.union(one)
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if found is None else found


def _needed(index: DataFrame, stands: DataFrame, books: list[np.ndarray], half: int, sizes: np.ndarray, k: int, aim: float, most: int = 128) -> float:
    """The share of vectors to visit that finds ``aim`` of the exact neighbours of ``most`` queries, chosen by a hash."""
    picked = stands.orderBy(F.xxhash64("query_id"), "query_id").limit(most).select("v").collect()
    if not picked:
        return 0.0
    asked = np.array([r["v"] for r in picked], dtype=np.float64)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = _squared(np.stack(b["v"].to_numpy()).astype(np.float64), asked)
                best = np.argsort(d, axis=0)[: k + 1]
                q = np.broadcast_to(np.arange(len(asked)), best.shape)
                yield pd.DataFrame({"q": q.ravel(), "d": d[best, q].ravel(), "c1": b["c1"].to_numpy()[best].ravel(), "c2": b["c2"].to_numpy()[best].ravel()})

    near = index.select("v", "c1", "c2").mapInPandas(tidy(nearest), "q int, d double, c1 int, c2 int")
    place = F.row_number().over(Window.partitionBy("q").orderBy("d"))
    # the nearest is the query itself
    hits = near.withColumn("place", place).where(F.col("place").between(2, k + 1)).select("q", "c1", "c2").collect()
    d1, d2 = _squared(asked[:, :half], books[0]), _squared(asked[:, half:], books[1])
    before = []
    for q in range(len(asked)):
        far = d1[q][:, None] + d2[q][None, :]
        before += [sizes[far <= far[r["c1"], r["c2"]]].sum() for r in hits if r["q"] == q]
    return float(np.quantile(before, aim) / sizes.sum()) if before else 0.0


def _search(
    rows: DataFrame, queries: Column, dim: int, kind: str, k: int, sample: int, per_cell: int, most_centroids: int, visit: float | None, least: int, aim: float, block: int, rounds: int, seed: int
) -> DataFrame:
    """The same over rows (vec_id, v) of one length."""
    spark = rows.sparkSession
    # distinct vectors with their smallest ids; the rank limit is applied before the shuffle as well
    ranked = rows.dropDuplicates(["vec_id", "v"]).withColumn("__at", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("__at") <= k + 1)
    kept = materialize(ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "ann-vectors")
    n = kept.count()
    half = max(1, dim // 2)
    picked = np.array([r["v"] for r in kept.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(sample).select("v").collect()], dtype=np.float64)
    centroids = int(min(most_centroids, max(2, round((n / per_cell) ** 0.5))))
    books = [_kmeans(picked[:, :half], centroids, rounds, seed), _kmeans(picked[:, half:], centroids, rounds, seed + 1)]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy()).astype(np.float64)
                yield b.assign(c1=_nearest(x[:, :half], books[0]), c2=_nearest(x[:, half:], books[1]))

    index = materialize(kept.mapInPandas(tidy(assign), f"v {kind}, ids array<long>, c1 int, c2 int"), "ann-index")
    counted = index.groupBy("c1", "c2").count().toArrow()  # most_centroids squared at most
    sizes = np.zeros((len(books[0]), len(books[1])), dtype=np.int64)
    sizes[counted.column("c1").to_numpy(), counted.column("c2").to_numpy()] = counted.column("count").to_numpy()
    blocks = {c1: -(-int(count) // block) for c1, count in enumerate(sizes.sum(1)) if count}
    shared = spark.sparkContext.broadcast(sizes)
    # queries with equal vectors walk once: the smallest id stands for them
    asking = rows.where(queries).dropDuplicates(["vec_id", "v"])
    stands = asking.groupBy("v").agg(F.min("vec_id").alias("query_id"))
    if visit is None:
        visit = _needed(index, stands, books, half, sizes, k, aim)
    enough = max(least, int(np.ceil(visit * n))) + k

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["v"].to_numpy()).astype(np.float64)
            d1, d2 = _squared(x[:, :half], books[0]), _squared(x[:, half:], books[1])
            for lo in range(0, len(b), 200):
                at, out = [], []
                for q in range(lo, min(lo + 200, len(b))):
                    visited: dict[int, list[int]] = {}
                    for c1, c2 in cells_in_order(d1[q], d2[q], shared.value, enough):
                        visited.setdefault(c1, []).append(c2)
                    for c1, seconds in visited.items():
                        out += [(c1, part, seconds) for part in range(blocks[c1])]
                        at += [q] * blocks[c1]
                yield pd.DataFrame(out, columns=["c1", "part", "seconds"]).assign(q=b["query_id"].to_numpy()[at], qv=b["v"].to_numpy()[at])

    tasks = max(1, -(-stands.count() // 128))
    visits = stands.select("query_id", "v").repartition(tasks, "query_id").mapInPandas(tidy(walk), f"c1 int, part int, seconds array<int>, q long, qv {kind}")
    pieces = F.create_map(*[x for c1, count in sorted(blocks.items()) for x in (F.lit(c1), F.lit(count))])
    dealt = index.withColumn("part", F.pmod(F.xxhash64(F.col("ids")[0]), F.try_element_at(pieces, F.col("c1"))).cast("int"))

    def rank(_: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):  # a block that nobody visits
            return pd.DataFrame({"q": [], "ids": pd.Series([], dtype=object), "score": []})
        x = np.stack(held["v"].to_numpy()).astype(np.float64)
        ids, out = held["ids"].to_numpy(), []
        first, c2 = np.array([i[0] for i in ids]), held["c2"].to_numpy()
        for q, v, seconds in zip(asked["q"], asked["qv"], asked["seconds"], strict=True):
            own = np.flatnonzero(np.isin(c2, seconds))
            score = np.sqrt(((x[own] - np.asarray(v, dtype=np.float64)) ** 2).sum(1))
            keep = np.lexsort((first[own], score))[: k + 1]
            out += [(q, ids[own[i]], score[i]) for i in keep]
        return pd.DataFrame(out, columns=["q", "ids", "score"])

    key = ["c1", "part"]
    near = visits.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInPandas(rank, "q long, ids array<long>, score double")
    best = near.withColumn("__at", F.row_number().over(Window.partitionBy("q").orderBy("score", F.col("ids")[0]))).where(F.col("__at") <= k + 1)
    answers = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("score", "ids"))).alias("hits"))
    pairs = F.flatten(F.transform("hits", lambda h: F.transform(h["ids"], lambda i: F.struct(h["score"].alias("score"), i.alias("vec_id")))))
    mine = F.slice(F.array_sort(F.filter(pairs, lambda p: p["vec_id"] != F.col("query_id"))), 1, k)
    return (
        asking.select(F.col("vec_id").alias("query_id"), "v")
        .join(stands.withColumnRenamed("query_id", "q"), "v")
        .join(answers, "q")
        .select("query_id", F.posexplode(mine).alias("pos", "hit"))
        .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
