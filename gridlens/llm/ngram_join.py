"""N-gram Jaccard join with count-vector R-trees.

A text's set is its distinct word shingles, as 64-bit hashes. Hash groups turn a set into a vector of group counts; the
sum of coordinate minima of two vectors bounds the overlap of the sets. The join runs in these steps, none of which
drops a link between different sets:

1. Equal sets form one class; from here on a class is one row, made from the text of its smallest id.
2. A class emits its first shingles under one fixed order, rare ones first. Two sets at or over the threshold share one
   of them (prefix filter), so every link lies within the bucket of some shingle. The order puts shingles that many
   texts share last; it comes from counts over all texts and only steers the cost, never the result. Buckets of shingles
   that very many texts share are dealt out over several tasks.
3. Buckets of up to ``small`` classes, and a star around one class in larger ones, give first candidates. The count
   bound prunes them, exact overlap of the 64-bit sets confirms them, and confirmed links are contracted into components.
4. In the larger buckets, classes of different components are then compared by packed R-trees over their count
   vectors, one for each block of a band of set sizes: a node holds the coordinate maxima and the range of set sizes of
   what is below it, and is left out if the bound with the query vector falls short. Rounds of growing width go on until
   no unseen pair survives.

Cases: texts without words have an empty set and are linked with nothing; texts of fewer words than a shingle have
their whole word sequence as the one shingle; null texts count as empty; repeated rows fall in one class; a row with
null id has no links and no component; an empty table gives no rows; other columns are ignored; texts are used whole.
Two different sets with equal 64-bit class keys would be taken as one: about n ** 2 / 2 ** 65 such pairs are expected.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import unused
from .common import Words, among, drop_ids, encode, frequent, keep_once, let_go, materialize, mix64, slices, spread_join, table, tidy

GROUPS = 512
_MULTIPLIERS = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Per text, its sorted distinct shingle hashes. ASCII capitals are lower-cased."""
    for lo, hi in slices(texts):
        w = Words([t.lower() for t in texts[lo:hi]])
        h = w.hashes()
        full = np.zeros(max(len(h) - width + 1, 0), np.uint64)
        for k in range(width):
            full += h[k : k + len(full)] * _MULTIPLIERS[k]
        full = mix64(full)
        for i in range(hi - lo):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if b - a >= width:
                yield np.unique(full[a : b - width + 1])
            elif b > a:
                yield mix64((h[a:b] * _MULTIPLIERS[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _sets(texts: pd.Series, width: int, step: int = 500) -> Iterator[np.ndarray]:
    """As above for a column, encoding a few texts at a time."""
    for lo in range(0, len(texts), step):
        yield from shingle_sets([encode(t) for t in texts.iloc[lo : lo + step]], width)


def class_key(s: np.ndarray) -> int:
    return int(mix64(mix64(s ^ _MULTIPLIERS[63]).sum(keepdims=True) + np.uint64(len(s)))[0].view(np.int64))


def group_counts(s: np.ndarray) -> np.ndarray:
    """Members per hash group in one byte each; 255 stands for that many or more."""
    return np.minimum(np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=GROUPS), 255).astype(np.uint8)


def _packed(s: np.ndarray) -> bytes:
    """Count vector for storage; most counts are 0, 1 or 2."""
    return zlib.compress(group_counts(s).tobytes(), 1)


def _vectors(counts: pd.Series, sizes: np.ndarray) -> np.ndarray:
    """Count vectors as a matrix; a full byte becomes the set's size, so that bounds stay bounds."""
    x = np.frombuffer(b"".join(map(zlib.decompress, counts)), np.uint8).reshape(-1, GROUPS)
    if (x == 255).any():
        x = np.where(x == 255, np.asarray(sizes)[:, None], x)
    return x


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


class Threshold:
    """``num / den`` as similarity; overlap(m, n) is the least common count that reaches it."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, m, n):
        return _ceil(self.num * (m + n), self.num + self.den)

    def probe(self, n: int) -> int:
        """Shingles to look up: partners hold num / den of n at least."""
        return n - _ceil(self.num * n, self.den) + 1

    def index(self, n: int) -> int:
        """Shingles that meet partners of n or more."""
        return n - int(self.overlap(n, n)) + 1


class CountTree:
    """Packed R-tree over count vectors, ordered by set size; queries return positions that the bound can't rule out."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, t: Threshold, fan: int = 16):
        lead = counts.argmax(1) if len(counts) else np.zeros(0, int)
        self.order = np.lexsort((lead, sizes))
        self.t, self.fan = t, fan
        self.levels = [(counts[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > fan:
            top, low, high = self.levels[-1]
            at = np.arange(0, len(top), fan)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def query(self, counts: np.ndarray, size: int) -> np.ndarray:
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            bound = np.minimum(top[nodes], counts).sum(1, dtype=np.int64)
            # a partner smaller than the query needs less overlap: the smallest size below the node is the safe one
            floor = np.maximum(low[nodes], _ceil(self.t.num * size, self.t.den))
            nodes = nodes[(bound >= self.t.overlap(floor, size)) & (floor <= high[nodes]) & (low[nodes] * self.t.num <= size * self.t.den)]
            if depth:
                below = (nodes[:, None] * self.fan + np.arange(self.fan)).ravel()
                nodes = below[below < len(self.levels[depth - 1][0])]
        return self.order[nodes]


def _scan(rows: DataFrame, width: int, window: int = 2 << 20) -> DataFrame:
    """id, row, cls, n of each row; and rows with ``times`` set: shingle and how many texts of a window of one task hold it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, seen = [], 0, set()

        def out() -> pd.DataFrame:
            key, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            often = n > 2
            return pd.DataFrame({"id": None, "named": None, "row": None, "cls": None, "n": None, "shingle": key[often].view(np.int64), "times": n[often]})

        for b in batches:
            for lo in range(0, len(b), 1000):
                part, keys, sizes = b.iloc[lo : lo + 1000], [], []
                for s in _sets(part["text"], width):
                    key = class_key(s) if len(s) else None
                    keys.append(key)
                    sizes.append(len(s))
                    if len(s) and key not in seen:
                        seen.add(key)
                        held.append(s)
                        size += len(s)
                    if size >= window:
                        yield out()
                        held, size, seen = [], 0, set()
                yield pd.DataFrame({"id": part["id"].to_numpy(), "named": part["named"].to_numpy(), "row": part["row"].to_numpy(), "cls": pd.array(keys, dtype="Int64"), "n": sizes, "shingle": None, "times": None})
        yield out()

    # nulls would turn a batch's ids into floats
    whole = rows.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNotNull().alias("named"), "row", "text")
    found = whole.mapInPandas(tidy(run), "id long, named boolean, row long, cls long, n long, shingle long, times long")
    return found.withColumn("id", F.when(F.col("named"), F.col("id"))).drop("named")


def _heavy(scanned: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts share, with their counts: the ``most`` most frequent. Steers the order of step 2."""
    counted = scanned.where("times IS NOT NULL").groupBy("shingle").agg(F.sum("times").alias("n"))
    top = counted.orderBy(F.desc("n"), "shingle").limit(most).toPandas()
    keys = top["shingle"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], top["n"].to_numpy(dtype=np.int64)[order]


def _entries(rows: DataFrame, wanted: DataFrame, width: int, t: Threshold, heavy: tuple[np.ndarray, np.ndarray], bucket: int) -> DataFrame:
    """Index entries of the rows in ``wanted``: shingle, cls, mark (twice the set's size, plus one if the shingle is only
    looked up), and deal (which part of a dealt bucket, from 1; else 0) for the first shingles of each. And a row for
    each class, whose ``info`` holds id, row and count vector. Other rows may come with them, and classes repeatedly."""
    shared = rows.sparkSession.sparkContext.broadcast(heavy)  # bounded by the number of heavy shingles

    def first(s: np.ndarray, probe: int, key: int) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = shared.value
        deal = np.zeros(probe, np.int32)
        if not len(keys):
            return s[:probe], deal
        at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
        known = keys[at] == s
        prefix = s[~known][:probe]
        if (rare := len(prefix)) < probe:
            times = counts[at[known]]
            order = np.argsort(times, kind="stable")[: probe - rare]
            prefix = np.concatenate((prefix, s[known][order]))
            parts = np.minimum(times[order] // bucket + 1, 1 << 20)
            deal[rare:] = np.where(parts > 1, int(mix64(np.array([key]))[0] >> np.uint64(2)) % parts + 1, 0)
        return prefix, deal

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.iloc[lo : lo + 500]
                shingle, deal, cls, size, index, info = [], [], [], [], [], []
                for i, row, s in zip(part["id"].tolist(), part["row"].tolist(), _sets(part["text"], width), strict=True):
                    if n := len(s):
                        cls.append(class_key(s))
                        prefix, parts = first(s, t.probe(n), cls[-1])
                        shingle.append(prefix)
                        deal.append(parts)
                        size.append(n)
                        index.append(t.index(n))
                        info.append(np.array([i, row], dtype="<i8").tobytes() + _packed(s))
                if not cls:
                    continue
                many = np.array([len(p) for p in shingle])
                pos = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                mark = np.repeat(np.array(size) * 2, many) + (pos >= np.repeat(index, many))
                yield pd.DataFrame({"shingle": np.concatenate(shingle).view(np.int64), "cls": np.repeat(np.array(cls, dtype=np.int64), many), "mark": mark, "deal": np.concatenate(deal), "info": None})
                yield pd.DataFrame({"shingle": cls, "cls": cls, "mark": np.array(size) * 2, "deal": 0, "info": info})

    placed = among(rows.where("id IS NOT NULL").select("id", "row", "text"), wanted.select(F.col("row").alias("id")), "row")
    return placed.mapInPandas(tidy(run), "shingle long, cls long, mark long, deal int, info binary")


def _first_pairs(entries: DataFrame, small: int, t: Threshold, piece: int = 1 << 16) -> DataFrame:
    """Entries sorted by shingle and deal within partitions. kind 0: candidate pairs a, b; kind 1: members a of a large
    bucket, with its shingle in b; kind 2: the same for the one class that was compared with the others of its deal; kind
    3: classes a with their sizes b, and id, row and counts. A bucket of over ``piece`` entries that wasn't dealt out, as
    nothing told its size, is dealt out here: it is worked on a piece at a time, and its pieces meet as deals do."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []  # the last bucket met so far, and nothing else
        cut: tuple[int, int] | None = None  # the bucket that has been cut into pieces
        for b in batches:
            told = b["info"].notna()
            if told.any():
                c = b[told]
                own = np.frombuffer(b"".join(x[:16] for x in c["info"]), "<i8").reshape(-1, 2)
                yield pd.DataFrame({"kind": 3, "a": c["cls"], "b": c["mark"] // 2, "id": own[:, 0], "row": own[:, 1], "counts": [x[16:] for x in c["info"]]})
                b = b[~told]
            if not len(b):
                continue
            mark = b["mark"].to_numpy(np.int64)
            x = np.stack((b["shingle"].to_numpy(np.int64), mark >> 1, b["cls"].to_numpy(np.int64), 1 - (mark & 1), b["deal"].to_numpy(np.int64)))
            bucket = (int(x[0, -1]), int(x[4, -1]))
            last = int(np.argmax((x[0] == bucket[0]) & (x[4] == bucket[1])))
            if held and (last or (int(held[0][0, 0]), int(held[0][4, 0])) != bucket):
                yield from work(np.concatenate([*held, x[:, :last]], axis=1), cut)
                held, x = [], x[:, last:]
            elif last:
                yield from work(x[:, :last], cut)
                x = x[:, last:]
            held.append(x)
            if sum(h.shape[1] for h in held) > piece:
                cut = bucket
                yield from work(np.concatenate(held, axis=1), cut)
                held = []
        if held:
            yield from work(np.concatenate(held, axis=1), cut)

    def work(x: np.ndarray, cut: tuple[int, int] | None) -> Iterator[pd.DataFrame]:
        if cut is not None and cut[1] == 0:
            x[4, (x[0] == cut[0]) & (x[4] == 0)] = 1
        again = np.zeros(x.shape[1], bool)
        again[1:] = (x[0, 1:] == x[0, :-1]) & (x[2, 1:] == x[2, :-1]) & (x[4, 1:] == x[4, :-1])
        x = x[:, ~again]
        start = np.flatnonzero(np.concatenate(([True], (x[0, 1:] != x[0, :-1]) | (x[4, 1:] != x[4, :-1]))))
        size = np.diff(np.append(start, x.shape[1]))
        run_of = np.repeat(np.arange(len(start)), size)
        dealt = x[4] > 0
        a, b = [], []
        # within a bucket rows are sorted by n, indexing ones first: the earlier one is the smaller set and has to index this shingle
        for step in range(1, min(small, int(size.max(initial=0)))):
            i = np.flatnonzero((run_of[step:] == run_of[:-step]) & (size[run_of[step:]] <= small))
            ok = i[(x[3, i] == 1) & (x[1, i] * t.den >= x[1, i + step] * t.num)]
            a.append(x[2, ok])
            b.append(x[2, ok + step])
        large = (size[run_of] > small) | dealt
        if large.any():
            # the smallest key: the buckets of near copies then mostly agree on one class
            lowest = np.lexsort((x[2], run_of))[start]
            centre = lowest[run_of[large]]
            lo, hi = np.minimum(x[1, centre], x[1, large]), np.maximum(x[1, centre], x[1, large])
            ok = (x[2, centre] != x[2, large]) & (lo * t.den >= hi * t.num)
            a.append(x[2, centre][ok])
            b.append(x[2, large][ok])
        if a and (total := sum(map(len, a))):
            one, two = np.concatenate(a), np.concatenate(b)
            pairs = np.unique(np.stack((np.minimum(one, two), np.maximum(one, two))), axis=1) if total else None
            yield out(0, pairs[0], pairs[1])
        if large.any():
            # a set that doesn't index the shingle only meets smaller ones that do
            last = np.maximum.accumulate(np.where(x[3] == 1, np.arange(x.shape[1]), -1))
            meets = (last >= start[run_of]) & (x[1, last] * t.den >= x[1] * t.num)
            stay = large & (meets | dealt)
            yield out(1, x[2, stay], x[0, stay])
            centres = lowest[dealt[start]]
            yield out(2, x[2, centres], x[0, centres])

    def out(kind: int, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"kind": kind, "a": a, "b": b, "id": None, "row": None, "counts": None})

    return entries.mapInPandas(tidy(run), "kind int, a long, b long, id long, row long, counts binary")


def _likely(pairs: DataFrame, classes: DataFrame, t: Threshold) -> DataFrame:
    """Distinct pairs a, b that the count bound leaves, with the rows that stand for them."""
    pairs = materialize(pairs.select("a", "b").distinct(), "join-pairs")
    if not (total := pairs.count()):
        return pairs.select("a", "b", F.lit(0).cast("long").alias("row_a"), F.lit(0).cast("long").alias("row_b"))
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    classes = among(classes, asked, "cls")  # so that only these are shuffled
    side = lambda k: classes.select(F.col("cls").alias(k), F.col("n").alias(f"n_{k}"), F.col("counts").alias(f"c_{k}"), F.col("row").alias(f"row_{k}"))

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if not len(p):
                continue
            x, y = _vectors(p["c_a"], p["n_a"].to_numpy()), _vectors(p["c_b"], p["n_b"].to_numpy())
            ok = np.minimum(x, y).sum(1, dtype=np.int64) >= t.overlap(p["n_a"].to_numpy(), p["n_b"].to_numpy())
            yield p.loc[ok, ["a", "b", "row_a", "row_b"]]

    often = frequent(pairs, ("a", "b"), total)
    met = spread_join(spread_join(pairs, side("b"), "b", "a", often), side("a"), "a", "b", often)
    return met.select("a", "b", "n_a", "n_b", "c_a", "c_b", "row_a", "row_b").mapInPandas(tidy(bounded), "a long, b long, row_a long, row_b long")


def _confirm(likely: DataFrame, total: int, rows: DataFrame, width: int, t: Threshold) -> DataFrame:
    """Pairs a, b whose sets reach the threshold. Sets are made again where the texts lie; texts are never shuffled."""
    needed = likely.select(F.explode(F.array("row_a", "row_b")).alias("id"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[int] = set()
        for b in batches:
            for lo in range(0, len(b), 500):
                found = {class_key(s): s for s in _sets(b["text"].iloc[lo : lo + 500], width) if len(s)}
                found = {k: s for k, s in found.items() if k not in met}
                met.update(found)
                yield pd.DataFrame({"cls": list(found), "items": [s.astype("<u8").tobytes() for s in found.values()]})

    # the filter lets some others pass: the class key of the text decides in the joins below
    placed = among(rows.where("id IS NOT NULL").select("row", "text"), needed, "row").select("text")
    items = materialize(placed.mapInPandas(tidy(sets), "cls long, items binary"), "join-sets")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ok = []
            for x, y in zip(p["x"], p["y"], strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                ok.append(t.den * common >= t.num * (len(x) + len(y) - common))
            yield p.loc[np.array(ok, bool), ["a", "b"]]

    # the centres of stars have the smaller keys: the other ends first, so that a centre's set isn't shuffled with each of its pairs
    often = frequent(likely, ("a", "b"), total)
    met = spread_join(likely.select("a", "b"), items.select(F.col("cls").alias("b"), F.col("items").alias("y")), "b", "a", often)
    met = spread_join(met, items.select(F.col("cls").alias("a"), F.col("items").alias("x")), "a", "b", often)
    return met.select("a", "b", "x", "y").mapInPandas(tidy(exact), "a long, b long")


def _as_edges(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()


def contract(edges: DataFrame) -> DataFrame:
    """Rounds of large and small stars over edges (u, v < u), as many as it takes until only stars are left.

    Each star is written; a hub's edges are re-pointed to its smallest neighbour, so no list of neighbours is built. A star
    goes through its edges by one join with the nodes' smallest neighbours, whose own new edge comes from the row that holds it.
    """
    edges = materialize(edges.distinct(), "edges")
    while True:
        # stars: every node has one edge to a smaller one, which has none itself
        ends = edges.select(_exploded(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).select("of.*")
        odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("is_low")).where("up > 1 OR up = 1 AND is_low = 0")
        if not odd.limit(1).count():
            return edges
        both = edges.select(_exploded(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).select("of.*")
        met = both.join(both.groupBy("u").agg(F.min("v").alias("low")), "u").withColumn("m", F.least("low", "u"))
        beyond = F.when(F.col("v") > F.col("u"), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        own = F.when((F.col("v") == F.col("low")) & (F.col("u") != F.col("m")), F.struct("u", F.col("m").alias("v")))
        large = materialize(met.select(_exploded(beyond, own)).where("of IS NOT NULL").select("of.*"), "edges")
        met = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        edges = materialize(met.select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).distinct(), "edges")


def _exploded(*rows: Column) -> Column:
    return F.explode(F.array(*rows)).alias("of")


def _roots(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def _apart(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of ``pairs`` whose a and b aren't linked by ``edges``, which are stars."""
    by = [_roots(edges).select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")) for k in ("a", "b")]
    met = pairs.join(by[0], "a", "left").join(by[1], "b", "left")
    return met.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(*pairs.columns)


def _link(edges: DataFrame, likely: DataFrame, rows: DataFrame, width: int, t: Threshold) -> DataFrame:
    """``edges`` with what ``likely`` pairs link, contracted."""
    total = likely.count()
    return contract(edges.union(_as_edges(_confirm(likely, total, rows, width, t)))) if total else edges


def connected(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that each linked node reaches; nodes that are the smallest themselves are left out."""
    return _roots(contract(_as_edges(links)))


def _tree_pairs(named: DataFrame, classes: DataFrame, t: Threshold, width: int, block: int = 2048) -> DataFrame:
    """``named``: shingle, cls, root. Pairs of different components that share a bucket and that R-trees leave.

    Buckets with one largest component form a family: near copies share many shingles, and their buckets would all compare
    the same classes. Members of the largest component needn't ask, as every pair of two components has another end,
    which asks. A family of more than ``block`` classes is cut into bands of set sizes, so that partners lie in one band
    or in neighbouring ones, and bands into blocks, of those asked, with a tree each, and of those that ask. For
    each class and component the ``width`` best pairs are given; a row with ``cut`` names a class and the root of a
    component of which some were left out.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ask, held = pdf[pdf["ask"]], pdf[~pdf["ask"]]
        sizes, cls, root = held["n"].to_numpy(np.int64), held["cls"].to_numpy(), held["root"].to_numpy()
        counts = _vectors(held["counts"], sizes)
        tree = CountTree(counts, sizes, t)
        a, b, cut = [], [], set()
        wanted = _vectors(ask["counts"], ask["n"].to_numpy(np.int64)) if len(ask) else []
        for own, n, r, vector in zip(ask["cls"].tolist(), ask["n"].tolist(), ask["root"].tolist(), wanted, strict=True):
            hit = tree.query(vector, n)
            hit = hit[root[hit] != r]
            if not len(hit):
                continue
            bound = np.minimum(counts[hit], vector).sum(1, dtype=np.int64) / (sizes[hit] + n)
            hit = hit[np.lexsort((cls[hit], -bound))]
            rank = pd.Series(root[hit]).groupby(root[hit]).cumcount().to_numpy()
            cut |= {(own, int(x)) for x in root[hit[rank >= width]]}
            hit = hit[rank < width]
            a += [own] * len(hit)
            b += cls[hit].tolist()
        pairs = np.unique(np.sort(np.array([a, b], dtype=np.int64).reshape(2, -1), axis=0), axis=1)
        left = np.array(sorted(cut), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": np.concatenate((pairs[0], left[:, 0])), "b": np.concatenate((pairs[1], left[:, 1])), "cut": [False] * pairs.shape[1] + [True] * len(left)})

    per = named.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("c"))
    top = per.groupBy("shingle").agg(F.max(F.struct("c", "root")).alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1").select("shingle", F.col("top.root").alias("family"))
    family = materialize(named.join(top, "shingle").select("family", "cls", "root").distinct(), "join-family")
    known = among(classes, family.select(F.col("cls").alias("id")), "cls")
    whole = family.groupBy("family").agg((F.count(F.lit(1)) > block).alias("wide"))
    # a little wider than the threshold asks for, so that rounding doesn't part two partners by more than one band
    band = F.floor(F.log(F.col("n").cast("double")) / (1.001 * math.log(t.den / t.num))).cast("int")
    placed = family.join(known.select("cls", "n"), "cls").join(whole, "family").withColumn("band", F.when(F.col("wide"), band).otherwise(0))
    placed = materialize(placed.select("family", "band", "cls", "root", (F.col("root") != F.col("family")).alias("asks")), "join-placed")
    of = placed.groupBy("family", "band").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"), F.ceil(F.count_if("asks") / block).cast("int").alias("ask_parts"))
    other = of.withColumnRenamed("band", "at").withColumnRenamed("parts", "parts_at").withColumnRenamed("ask_parts", "ask_parts_at")
    both = materialize(of.join(other, "family").where("abs(band - at) <= 1 AND ask_parts_at > 0"), "join-bands")  # a row for each two bands that meet
    part, ask_part = F.pmod(F.xxhash64("cls"), "parts").cast("int"), F.pmod(F.xxhash64(F.lit(1), "cls"), "ask_parts_at").cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = placed.join(both, ["family", "band"]).select("family", "band", part.alias("part"), "at", each("ask_parts_at").alias("ask_part"), "cls", "root", F.lit(False).alias("ask"))
    asking = placed.where("asks").withColumnRenamed("band", "at").join(both, ["family", "at"])
    asking = asking.select("family", "band", each("parts").alias("part"), "at", ask_part.alias("ask_part"), "cls", "root", F.lit(True).alias("ask"))
    rows = held.union(asking).join(known.select("cls", "n", "counts"), "cls")
    return rows.groupBy("family", "band", "part", "at", "ask_part").applyInPandas(run, "a long, b long, cut boolean")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: tuple[int, int] = (3, 4), small: int = 8, heavy: int = 100_000, deal: int = 50_000, block: int = 2048, piece: int = 1 << 16
) -> DataFrame:
    """id, n_shingles, component_id: one row for each row of ``docs``. The last five steer the cost only."""
    found = _components(docs, id_col, text_col, width, threshold, small, heavy, deal, block, piece)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart that share an id but not the text."""
    return F.xxhash64(id_col, text_col)


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: tuple[int, int], small: int = 8, heavy: int = 100_000, deal: int = 50_000, block: int = 2048, piece: int = 1 << 16) -> DataFrame:
    """id, row (its key), n, component_id, root: the component itself, as two of them may share their smallest id."""
    t = Threshold(*threshold)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), _row_key(id_col, text_col).alias("row"))
    scanned = materialize(_scan(rows, width), "join-rows")
    listed = scanned.where("times IS NULL").select("id", "row", "cls", "n")
    wanted = listed.where("id IS NOT NULL AND n > 0").groupBy("cls").agg(F.min(F.struct("id", "row")).alias("low")).select("low.row")
    entries = _entries(rows, wanted, width, t, _heavy(scanned, heavy), deal)
    placed = entries.repartition("shingle", "deal").sortWithinPartitions("shingle", "deal", "mark", "cls")
    first = materialize(_first_pairs(placed, small, t, piece), "join-first")
    classes = first.where("kind = 3").groupBy(F.col("a").alias("cls")).agg(F.min(F.struct("id", "row")).alias("low"), F.first("b").alias("n"), F.first("counts").alias("counts"))
    classes = materialize(classes.select("cls", F.col("low.id").alias("rep"), F.col("low.row").alias("row"), "n", "counts"), "join-classes")
    # the deals of one bucket meet in a star of their centres
    centres = first.where("kind = 2").select(F.col("b").alias("shingle"), F.col("a").alias("cls"))
    stars = centres.join(centres.groupBy("shingle").agg(F.min("cls").alias("low")), "shingle").where("cls != low").select(F.col("low").alias("a"), F.col("cls").alias("b"))
    tried = materialize(_likely(first.where("kind = 0").select("a", "b").union(stars), classes, t), "join-likely")
    none = docs.sparkSession.createDataFrame(pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())}))
    let_go(docs.sparkSession)
    edges = _link(none, tried, rows, width, t)
    members = first.where("kind = 1").select(F.col("a").alias("cls"), F.col("b").alias("shingle"))
    best = 32
    while members.limit(1).count():
        let_go(docs.sparkSession)
        named = members.join(_roots(edges).withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        found = materialize(_tree_pairs(materialize(named, "join-named"), classes, t, best, block), "join-tree")
        pairs = found.where("NOT cut").select("a", "b")
        fresh = materialize(_likely(pairs.join(tried, ["a", "b"], "left_anti"), classes, t), "join-likely")
        let_go(docs.sparkSession)
        edges = _link(edges, fresh, rows, width, t)
        # pairs left out matter only between what is still apart
        cut = found.where("cut").select("a", "b")
        if not cut.limit(1).count():
            break
        again = materialize(_apart(cut, edges).select(F.col("a").alias("cls")).distinct(), "join-apart")
        if not again.limit(1).count():
            break
        tried = tried.union(fresh)
        touched = members.join(again, "cls", "left_semi").select("shingle").distinct()
        members = materialize(members.join(touched, "shingle", "left_semi"), "join-members")
        best *= 8
    named = classes.select("cls", "rep").join(_roots(edges).withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lowest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_class = named.join(lowest, "root").select("cls", "component_id", "root")
    # rows without set join nothing; their key is spread so that they don't meet in one task
    key = F.when(F.col("n") > 0, F.col("cls")).otherwise(F.xxhash64("id"))
    out = listed.select("id", "row", "n", key.alias("cls")).join(by_class, "cls", "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", "row", "n", component.alias("component_id"), "root")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest id stays, once; all columns stay. Rows without id stay.

    Rows are told apart by id and text, so an id on several texts is judged for each of them. Texts without words are
    linked with nothing: of them only repeats of one id and text go.
    """
    found = _components(docs, "doc_id", "text", 5, (3, 4)).where("id IS NOT NULL").select("id", "row", "n", "root")
    found = materialize(found, "join-stage")
    let_go(spark)
    own = unused(docs.columns, "row")
    lowest = found.where("n > 0").groupBy("root").agg(F.min(F.struct("id", "row")).alias("low"))
    gone = materialize(found.where("n > 0").join(lowest, "root").where("row != low.row").select(F.col("row").alias(own)), "join-gone")
    repeated = found.groupBy("row").count().where("count > 1").select(F.col("row").alias(own))
    keyed = docs.withColumn(own, F.when(F.col("doc_id").isNotNull(), _row_key("doc_id", "text")))
    return keep_once(drop_ids(keyed, gone, own), repeated, own).drop(own)


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS s FROM w)
), sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach WHERE a = w.doc_id) AS component_id
FROM w LEFT JOIN sizes USING (doc_id)
"""
