"""Mixing sources to target weights.

The words of a source, documents in the order of a hash of their ids, are packed end to end into blocks of fixed length. Every
output shard draws how many of its slots go to each source from a multinomial law; the slots of a source are numbered
through all shards and mapped to its blocks by pseudorandom permutations, one for each pass over the source; blocks
and slots then meet in a join on (source, block).

The draws are settled against the sources' quotas (target / block length): slots drawn beyond a source's quota are
handed to sources that are short of theirs, shard by shard in order. So the shares are exact up to one block, and no
block is taken more often than the largest number of passes.

Cases: a null source is a source of its own and comes last; null and empty texts have size 0, lie in no block and are
never taken; rows are kept apart even if they repeat, and a null id sorts first; with no words at all every target and
take is 0; an empty table gives no rows; columns other than id, text and source are ignored. The same rows give the same mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import unused
from .common import let_go, materialize, mix64, table, tidy

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def capped_shares(sizes: list[int], weights: list[float], passes: float, total: float | None = None) -> list[float]:
    """Targets that share ``total`` by weight; none above ``passes`` times its size, the excess goes on to the others by weight."""
    left = float(sum(sizes) if total is None else total)
    out, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while open_ and left > 0:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > passes * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = float(passes * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Pseudorandom permutations of 0..n-1, one for each key: in each round x may swap with its mirror image about a keyed point."""
    x, n = x.astype(np.int64), n.astype(np.int64)
    for r in range(rounds):
        turn = mix64(key + np.uint64(2 * r))
        mirror = ((turn % n.astype(np.uint64)).astype(np.int64) - x) % n
        coin = mix64(turn ^ mix64(np.maximum(x, mirror).astype(np.uint64) + np.uint64(1))) & np.uint64(1)
        x = np.where(coin == 1, mirror, x)
    return x


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    passes: int = 3,
    block: int = 64,
    shard_slots: int = 16384,
    seed: int = 11,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (id, source, size, source_size, target, taken), slots (shard, source, pass, block), and spans of documents in blocks.

    What is known per source is collected: the number of sources must fit the driver, as it must for weights to be set.
    Offsets within a source come in two steps, per slice of ids and then within it, so a hot source is many tasks; the
    slices grow in number with the rows. The slots that the shards draw are numbered in the same way.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"))
    rows = materialize(rows, "mix-sizes")
    known = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    bits = 8 + (sum(r["rows"] for r in known) // 100_000).bit_length()
    known.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["n"]) for r in known]
    targets = capped_shares(sizes, [weights[i % len(weights)] for i in range(len(known))], passes)
    n_blocks = [-(-s // block) for s in sizes]
    # the last block of a source may be short, so quotas are counted in words per block of that source
    quota = [min(passes * n, round(t * n / s)) if s else 0 for t, n, s in zip(targets, n_blocks, sizes, strict=True)]
    fields = [("src", pa.int32()), ("source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()), ("n_blocks", pa.int64()), ("quota", pa.int64())]
    columns = (range(len(known)), [r["source"] for r in known], sizes, targets, n_blocks, quota)
    # as an Arrow table, which takes no Python workers to be read
    plan = spark.createDataFrame(pa.table([pa.array(list(c), kind) for c, (_, kind) in zip(columns, fields, strict=True)], names=[f for f, _ in fields]))
    plan = F.broadcast(plan)  # one row a source
    tagged = rows.join(plan, rows["source"].eqNullSafe(plan["source"])).select("id", rows["source"], "size", "src", "source_size", "target", "n_blocks")

    # word offsets: documents are sliced by ranges of their hash, and the slices' totals are summed up first
    order_key = F.when(F.col("id").isNull(), F.lit(-(1 << 63))).otherwise(F.xxhash64("id"))
    placed = tagged.where("size > 0").withColumn("order_key", order_key).withColumn("slice", F.shiftright("order_key", max(64 - bits, 32)))
    within = Window.partitionBy("src", "slice").orderBy("order_key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy("src").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = placed.groupBy("src", "slice").agg(F.sum("size").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0))).drop("n")
    first_block, last_block = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    spans = (
        placed.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(slices, ["src", "slice"])
        .withColumn("start", F.col("before") + F.col("inner"))
        .select("id", "src", "size", "start", F.explode(F.sequence(first_block, last_block)).alias("block"))
        .withColumn("words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block))
    )

    # multinomial draws per shard, settled against the quotas
    total = sum(quota)
    n_shards = -(-total // shard_slots)
    share = np.array(quota, dtype=float) / max(total, 1)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for shard in b["id"]:
                slots = min(shard_slots, total - int(shard) * shard_slots)
                for src, n in enumerate(np.random.default_rng((seed, int(shard))).multinomial(slots, share)):
                    if n:
                        out.append((shard, src, n))
            yield pd.DataFrame(out, columns=["shard", "src", "n"])

    drawn = materialize(spark.range(n_shards).mapInPandas(tidy(draw), "shard long, src int, n long"), "mix-draws")
    lot = F.floor(F.col("shard") / 1024).alias("lot")
    run = Window.partitionBy("src").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    lots = drawn.groupBy("src", lot).agg(F.sum("n").alias("n")).select("src", "lot", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
    run = Window.partitionBy("src", "lot").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    numbered = drawn.select("*", lot).withColumn("inner", F.coalesce(F.sum("n").over(run), F.lit(0))).join(lots, ["src", "lot"])
    numbered = numbered.select("shard", "src", "n", (F.col("before") + F.col("inner")).alias("first"))
    tops = {r["src"]: int(r["n"]) for r in drawn.groupBy("src").agg(F.sum("n").alias("n")).collect()}
    # slots over a quota go to sources under theirs: the over-drawn and the missing slots are numbered alike and matched by number
    over, under = [], []
    at_over = at_under = 0
    for k, q in enumerate(quota):
        surplus = tops.get(k, 0) - q
        if surplus > 0:
            over.append((k, q, at_over))
            at_over += surplus
        elif surplus < 0:
            under.append((at_under, at_under - surplus, k, tops.get(k, 0)))
            at_under -= surplus
    quotas, blocks = np.array(quota, dtype=np.int64), np.maximum(np.array(n_blocks, dtype=np.int64), 1)
    over_at = np.zeros(len(quota), dtype=np.int64)
    for k, _, at in over:
        over_at[k] = at
    under_from = np.array([u[0] for u in under], dtype=np.int64)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 50):
                part = b.iloc[lo : lo + 50]
                count = part["n"].to_numpy(np.int64)
                src = np.repeat(part["src"].to_numpy(np.int64), count)
                shard = np.repeat(part["shard"].to_numpy(np.int64), count)
                slot = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - part["first"].to_numpy(np.int64), count)
                beyond = np.flatnonzero(slot >= quotas[src])
                if len(beyond):
                    extra = over_at[src[beyond]] + slot[beyond] - quotas[src[beyond]]
                    to = np.searchsorted(under_from, extra, side="right") - 1
                    src[beyond] = np.array([u[2] for u in under])[to]
                    slot[beyond] = extra - under_from[to] + np.array([u[3] for u in under])[to]
                turn = slot // blocks[src]
                key = mix64((np.uint64(seed) << np.uint64(48)) + (src.astype(np.uint64) << np.uint64(8)) + turn.astype(np.uint64))
                yield pd.DataFrame({"shard": shard, "src": src, "pass": turn, "block": permuted(slot % blocks[src], blocks[src], key)})

    # a draw grows a thousandfold here, so the number of tasks follows the slots rather than the draws' size
    slots = numbered.repartition(max(1, -(-total // 500_000)), "shard", "src").mapInPandas(tidy(deal), "shard long, src int, pass long, block long")

    # a block's uses are counted before the join, so a document's words meet one row a block
    # and written, as the plans of slots and of spans are large ones each
    uses = materialize(slots.groupBy("src", "block").agg(F.count(F.lit(1)).alias("uses")), "mix-uses")
    words = F.col("words") * F.coalesce("uses", F.lit(0))
    sized = spans.join(uses.hint("merge"), ["src", "block"], "left").groupBy("src", "id", "start", "size").agg(F.sum(words).alias("taken")).select("src", "id", "size", "taken")
    empty = tagged.where("size = 0").select("src", "id", "size", F.lit(0).cast("long").alias("taken"))
    out = sized.union(empty).join(plan, "src").select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken")
    return out, slots, spans


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _, _ = mix(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "size", "source_size", "target", "taken")


def copies(mixed: DataFrame, key_col: str, source_col: str) -> DataFrame:
    """Key and ``copies`` of each row of ``mixed`` with words: how often a whole document stands for the words taken of it.

    A remainder of a document's size is drawn systematically, documents in the order of their size: the words put out
    for a source then differ from those taken by no more than about its largest document. Running sums come in two
    steps, per slice of equal sizes and then within it.
    """
    unit = 1 << 20
    rows = mixed.where("size > 0").select(F.col(key_col).alias("key"), F.xxhash64(source_col).alias("k"), "size", "taken", F.pmod(F.xxhash64(key_col), F.lit(64)).alias("part"))
    rows = rows.withColumn("rest", F.round((F.col("taken") % F.col("size")) * float(unit) / F.col("size")).cast("long"))
    ahead = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    within = ahead(["k", "size", "part"], "key")
    slices = rows.groupBy("k", "size", "part").agg(F.sum("rest").alias("n"))
    sizes = slices.groupBy("k", "size").agg(F.sum("n").alias("n")).select("k", "size", F.coalesce(F.sum("n").over(ahead(["k"], "size")), F.lit(0)).alias("smaller"))
    slices = slices.withColumn("inner", F.coalesce(F.sum("n").over(ahead(["k", "size"], "part")), F.lit(0))).join(sizes, ["k", "size"])
    slices = materialize(slices.select("k", "size", "part", (F.col("smaller") + F.col("inner")).alias("before")), "mix-before")
    rows = rows.withColumn("inner", F.coalesce(F.sum("rest").over(within), F.lit(0))).join(slices, ["k", "size", "part"])
    at = F.col("before") + F.col("inner") + unit // 2
    more = F.shiftright(at + F.col("rest"), 20) - F.shiftright(at, 20)
    return rows.select(F.col("key").alias(key_col), (F.floor(F.col("taken") / F.col("size")) + more).alias("copies"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix in whole documents, repeats as repeated rows; all columns stay.

    Rows are told apart by id, source and text. Rows that share all three share their copies out evenly. Texts without
    words are in no mix and go.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own, n_copies, n_same, rank, time = (unused(docs.columns, n) for n in ("row", "copies", "same", "rank", "time"))
    keyed = docs.withColumn(own, F.xxhash64("doc_id", "source", "text"))
    found, _, _ = mix(keyed, id_col=own)
    found = materialize(found, "mix-taken")
    let_go(spark)
    per_row = copies(found, own, "source").groupBy(own).agg(F.sum("copies").alias(n_copies), F.count(F.lit(1)).alias(n_same))
    wanted = materialize(per_row.where(F.col(n_copies) > 0), "mix-copies")
    placed = keyed.join(wanted, own).withColumn(rank, F.row_number().over(Window.partitionBy(own).orderBy(F.xxhash64(*columns))))
    times = F.floor(F.col(n_copies) / F.col(n_same)) + (F.col(rank) <= F.col(n_copies) % F.col(n_same)).cast("long")
    return placed.withColumn(time, F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*columns)
