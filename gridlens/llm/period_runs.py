"""Periodic runs of words, found in a grammar of the text.

Words become ids, and Re-Pair replaces pairs that occur again by nonterminals until no pair does; what is left of a text
is paired up into a balanced tree. A run crosses the boundary between the two sides of some nonterminal that holds it
whole, so each nonterminal is searched once, at one of its places, for runs that cross its boundary; these are moved to
all places that the derivation has for it, and intervals of one period that overlap by a period are one.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are identical) of at least
``least`` words and ``times`` periods that no neighbouring word extends. Such a stretch repeats some ``SEED``
consecutive words ``q`` further on, so a text without repeated ones has no run and gets no grammar.

Cases: null, empty and blank texts have no words and no runs; texts of any length are read whole, each in one task;
repeated rows give equal results; an empty table gives no rows; a column called like a result is replaced, all others
pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, _power_tables, mix64, slices, table, with_columns

SEED = 8
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def repair(symbols: np.ndarray, text: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grammars of many texts at once: (nonterminal, place) of every replacement, and each nonterminal's left and whole length.

    ``symbols`` are word ids, of which no two texts share one, and ``text`` is each word's text. In a round, pairs that
    occur twice or more in their text are ranked by how often they do, and each place takes the pair that outranks the
    ones it overlaps; a pair is replaced where it is so taken twice or more. Nonterminals are numbered from 0.
    """
    place = np.arange(len(symbols))
    size = np.ones(n_words, dtype=np.int64)  # by symbol
    fresh = np.ones(len(symbols), dtype=bool)  # symbols whose pairs may occur again
    events: list[tuple[np.ndarray, np.ndarray]] = []
    left: list[np.ndarray] = []

    def replace(at: np.ndarray, new: np.ndarray, first: np.ndarray) -> None:
        nonlocal symbols, place, text, size, fresh
        events.append((new - n_words, place[at]))
        left.append(size[symbols[first]])
        size = np.concatenate((size, size[symbols[first]] + size[symbols[first + 1]]))
        symbols[at] = new
        fresh[at] = True
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        symbols, place, text, fresh = symbols[keep], place[keep], text[keep], fresh[keep]

    symbols = symbols.astype(np.int64, copy=True)
    while len(symbols) > 1:
        maybe = (text[1:] == text[:-1]) & (fresh[1:] | fresh[:-1])
        same = maybe & (symbols[1:] == symbols[:-1])
        if same.any():  # of a symbol's row of repeats every other pair
            begins = np.flatnonzero(same & ~np.concatenate(([False], same[:-1])))
            row = np.cumsum(np.bincount(begins, minlength=len(same)))
            odd = (np.arange(len(same)) - begins[np.maximum(row, 1) - 1]) & 1 == 1
            maybe &= ~(same & odd)
        at = np.flatnonzero(maybe)
        kinds, first, kind, count = np.unique(symbols[at] * len(size) + symbols[at + 1], return_index=True, return_inverse=True, return_counts=True)
        often = count[kind] > 1
        # pairs that occur once can't occur again unless one of their symbols is replaced
        fresh[:] = False
        at, kind = at[often], kind[often]
        if not len(at):
            break
        fresh[at] = fresh[at + 1] = True
        rank = np.empty(len(kinds), dtype=np.int64)
        rank[np.lexsort((mix64(kinds), count))] = np.arange(1, len(kinds) + 1)  # by chance among equals, as rows of falling ranks are taken one by one
        score = np.zeros(len(symbols) + 1, dtype=np.int64)  # of the pair that begins before each place
        score[at + 1] = rank[kind]
        taken = np.zeros(len(symbols), dtype=bool)
        todo = at
        while len(todo):
            best = todo[(score[todo + 1] > score[todo]) & (score[todo + 1] > score[np.minimum(todo + 2, len(symbols))])]
            taken[best] = True
            score[best] = score[best + 1] = score[np.minimum(best + 2, len(symbols))] = 0
            todo = todo[score[todo + 1] > 0]
        chosen = taken[at]
        at, kind = at[chosen], kind[chosen]
        again = np.bincount(kind, minlength=len(kinds))[kind] > 1
        at, kind = at[again], kind[again]
        _, first, new = np.unique(kind, return_index=True, return_inverse=True)
        replace(at, new + len(size), at[first])
    while True:
        begins = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        nth = np.arange(len(text)) - np.repeat(begins, np.diff(np.append(begins, len(text))))
        at = np.flatnonzero((nth[:-1] & 1 == 0) & (text[1:] == text[:-1]))
        if not len(at):
            break
        replace(at, np.arange(len(at)) + len(size), at)
    if not events:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    return np.concatenate([e[0] for e in events]), np.concatenate([e[1] for e in events]), np.concatenate(left), size[n_words:]


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) for every value in the ranges."""
    n = np.maximum(end - begin, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)


class _Stretch:
    """Equality of stretches of words by polynomial hashes."""

    def __init__(self, words: np.ndarray):
        power, inverse = _power_tables(len(words) + 1)
        self.inverse = inverse[: len(words) + 1]
        self.sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * power[: len(words)], out=self.sums[1:])

    def hash(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return (self.sums[at + n] - self.sums[at]) * self.inverse[at]

    def reach(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """How many words, at most ``most``, agree from ``i`` and ``j`` on (``step`` 1) or before them (-1)."""
        low, high = np.zeros(len(i), dtype=np.int64), most.copy()
        while len(todo := np.flatnonzero(low < high)):
            mid = (low[todo] + high[todo] + 1) >> 1
            back = mid if step < 0 else 0
            good = self.hash(i[todo] - back, mid) == self.hash(j[todo] - back, mid)
            low[todo[good]] = mid[good]
            high[todo[~good]] = mid[~good] - 1
        return low


def _crossing(low: np.ndarray, mid: np.ndarray, high: np.ndarray, stretch: _Stretch, seeds: tuple[np.ndarray, np.ndarray], least: int, times: int) -> tuple[np.ndarray, ...]:
    """(row, start, end, period) of the runs in ``[low, high)`` that cross ``mid``.

    A run that crosses it repeats the ``SEED`` words after ``mid`` one period later, or those before it one period later
    or earlier, as words a period apart agree along at least ``max(least - q, (times - 1) * q) >= 2 * SEED`` places.
    """
    keys, kind = seeds
    n = len(kind)
    most = (high - low) // times

    def found(base: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = np.flatnonzero((base >= low) & (base + SEED <= high))
        ok = ok[kind[base[ok]] >= 0]
        k = kind[base[ok]] * n
        row, at = _spread(np.searchsorted(keys, k + np.maximum(begin[ok], low[ok])), np.searchsorted(keys, k + np.minimum(end[ok], high[ok] - SEED + 1)))
        return ok[row], keys[at] % n

    r1, a1 = found(mid, mid + 1, mid + most + 1)
    b = mid - SEED
    r2, a2 = found(b, b + 1, b + most + 1)
    r3, a3 = found(b, b - most, b)
    row = np.concatenate((r1, r2, r3))
    base = np.concatenate((mid[r1], b[r2], a3))
    period = np.concatenate((a1 - mid[r1], a2 - b[r2], b[r3] - a3))
    before = stretch.reach(base, base + period, base - low[row], -1)
    after = stretch.reach(base, base + period, high[row] - base - period, 1)
    start, end = base - before, base + after + period
    ok = (start < mid[row]) & (mid[row] < end) & (end - start >= np.maximum(least, times * period))
    return row[ok], start[ok], end[ok], period[ok]


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of one period that overlap by a period or more are put together; of equal ones the smallest period stays."""
    if not len(start):
        return start, end, period
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    shift = np.cumsum(np.concatenate(([0], period[1:] != period[:-1]))) * (2 * int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    head = np.flatnonzero(np.concatenate(([True], start[1:] + shift[1:] + period[1:] > reach[:-1])))
    start, period = start[head], period[head]
    end = (np.append(reach[head[1:] - 1], reach[-1]) - shift[head]).astype(np.int64)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.concatenate(([True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])))
    return start[first], end[first], period[first]


def runs_of(hashes: np.ndarray, text: np.ndarray, least: int = 24, times: int = 3, lot: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and period; ``hashes`` of words and the text of each, in ascending order."""
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    n = len(hashes)
    if n < least:
        return none
    stretch = _Stretch(mix64(hashes))
    base = np.arange(n - SEED + 1)
    base = base[text[base] == text[base + SEED - 1]]
    code = mix64(stretch.hash(base, SEED) ^ mix64(text[base].astype(np.uint64)))
    _, kind, count = np.unique(code, return_inverse=True, return_counts=True)
    again = count[kind] > 1
    if not again.any():
        return none
    # words of the texts that repeat some SEED words
    held = np.zeros(int(text[-1]) + 1, dtype=bool)
    held[text[base[again]]] = True
    kinds = np.full(n, -1, dtype=np.int64)
    kinds[base[again]] = kind[again]
    mine = np.flatnonzero(held[text])
    _, symbols = np.unique(mix64(hashes[mine] ^ mix64(text[mine].astype(np.uint64))), return_inverse=True)
    name, place, left, size = repair(symbols, text[mine], int(symbols.max()) + 1)
    _, first = np.unique(name, return_index=True)
    searched = np.flatnonzero(size >= least)
    low = mine[place[first[searched]]]  # a text's words lie together
    mid, high = low + left[searched], low + size[searched]
    keys = np.sort(kinds[base[again]] * n + base[again])
    # lots of nonterminals of bounded length in sum, as that bounds the pairs of places that are looked at
    weight = np.cumsum(high - low) // lot
    edges = np.flatnonzero(np.diff(weight, prepend=-1)).tolist() + [len(weight)]
    parts = []
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        row, *run = _crossing(low[i:j], mid[i:j], high[i:j], stretch, (keys, kinds), least, times)
        parts.append(np.unique(np.stack([searched[i + row], *run]), axis=1))
    node, start, end, period = np.concatenate(parts, axis=1) if parts else np.zeros((4, 0), dtype=np.int64)
    if not len(node):
        return none
    # to all places of the derivation
    order = np.argsort(name, kind="stable")
    row, at = _spread(np.searchsorted(name[order], node), np.searchsorted(name[order], node, side="right"))
    moved = mine[place[order[at]]] - mine[place[first[node[row]]]]
    return merged(start[row] + moved, end[row] + moved, period[row])


def _batch(texts: list[bytes], least: int, times: int) -> tuple[list[list[dict]], list[bytes]]:
    words = Words(texts)
    first = words.first
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    start, end, period = runs_of(words.hashes(), text, least, times)
    runs: list[list[dict]] = [[] for _ in texts]
    plain = [b" ".join(t.split()) for t in texts]
    if len(start):
        step = np.zeros(len(text) + 1, dtype=np.int64)
        np.add.at(step, start + period, 1)
        np.add.at(step, end, -1)
        kept = np.cumsum(step)[:-1] == 0
        owner = text[start]
        for k, s, n, q in zip(owner.tolist(), (start - first[owner]).tolist(), (end - start).tolist(), period.tolist(), strict=True):
            runs[k].append({"start": s, "length": n, "period": q})
        for k in np.unique(owner).tolist():
            mask = kept[first[k] : first[k + 1]]
            plain[k] = b" ".join(w for w, stays in zip(texts[k].split(), mask.tolist(), strict=True) if stays)
    return runs, plain


def find_runs(docs: DataFrame, text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """``docs`` with ``runs``: array<struct<start, length, period>> in words, by start and period, and ``collapsed``: the
    words that no run holds after its first period, joined by a blank."""
    if times < 3 or least < 3 * SEED:
        raise ValueError(f"runs of less than 3 periods or {3 * SEED} words aren't found by their repeated words")
    fields = [T.StructField("runs", T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in ("start", "length", "period")]))), T.StructField("collapsed", T.StringType())]
    run_type = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))

    def made(texts: list[bytes]) -> list[pa.Array]:
        runs, plain = [], []
        for i, j in slices(texts, 1 << 20):
            r, p = _batch(texts[i:j], least, times)
            runs += r
            plain += p
        return [pa.array(runs, run_type), pa.array(plain, pa.binary()).cast(pa.string())]

    return with_columns(docs, text_col, fields, made)


def looped(doc_id: Column, text: Column) -> Column:
    """The text, in a tenth of the documents with its end replaced by repeats of a stretch of it."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def again(words: Column) -> Column:
        n = F.size(words)
        a = F.when(n > 0, F.pmod(g, n)).otherwise(F.lit(0)).cast("int")
        p = (F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1).cast("int")
        return F.array_join(F.transform(words, lambda _, i: F.get(words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))), " ")

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    one = F.get(F.transform(F.array(words), again), 0)
    return F.when(F.coalesce(F.pmod(h, F.lit(10)) == 0, F.lit(False)), one).otherwise(text)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    found = find_runs(docs)
    # greatest length / period, exactly, then smallest start and period
    best = F.aggregate(
        "runs",
        F.get(F.col("runs"), 0),
        lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b),
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id",
        "n_runs",
        F.col("b.start").alias("start"),
        F.col("b.length").alias("length"),
        F.col("b.period").alias("period"),
        F.expr("b.length * 1000 div b.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


#: Runs straight from their definition, by pairs of places with equal words (eight at a time, as runs repeat sixteen).
OP12_SQL = r"""
WITH plain AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) AS h
  FROM documents
), planned AS (
  SELECT r, doc_id, w, len(w) AS n, h, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a FROM plain
), damaged AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) ELSE w END AS w
  FROM planned
), placed AS (SELECT r, n, i, list_aggregate(w[i + 1 : i + 8], 'string_agg', ' ') AS eight FROM damaged, unnest(range(n - 7)) AS u(i) WHERE n >= 24),
often AS (SELECT r, eight FROM placed GROUP BY r, eight HAVING count(*) > 1),
few AS (SELECT placed.* FROM placed SEMI JOIN often USING (r, eight)),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM few x JOIN few y ON x.r = y.r AND x.eight = y.eight AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM pairs),
stretches AS (SELECT r, q, min(i) AS s, max(i) + 8 + q AS e FROM islands GROUP BY r, q, g),
runs AS (SELECT r, s, e, min(q) AS q FROM stretches WHERE e - s >= greatest(24, 3 * q) GROUP BY r, s, e),
per AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r
), best AS (
  SELECT r, s, e - s AS length, q FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY (e - s) / q DESC, s, q) = 1
), dropped AS (SELECT DISTINCT r, unnest(range(s + q, e)) AS i FROM runs),
kept AS (SELECT d.r, string_agg(d.word, ' ' ORDER BY d.i) AS collapsed
  FROM (SELECT r, unnest(w) AS word, unnest(range(n)) AS i FROM damaged) d ANTI JOIN dropped USING (r, i) GROUP BY d.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, length, q AS period, length * 1000 // q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM damaged LEFT JOIN per USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
