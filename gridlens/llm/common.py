"""Shared helpers: table access, written intermediate tables, and byte-level tokenising in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import unused
from ..sources.scratch import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables. Batches that go to Python are bounded in bytes, as texts differ much in length; that is a
    setting of the session, which its other queries keep as well."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share(spark: SparkSession, model: object) -> Callable[[], object]:
    """Broadcasts a model of bounded size so that executors need not have its class installed: the class goes by value, and
    arrays as they are, of which a worker then holds one copy."""
    plain = {k: v for k, v in vars(model).items() if type(v).__module__ in ("builtins", "numpy")}
    rest = cloudpickle.dumps((type(model), {k: v for k, v in vars(model).items() if k not in plain}))
    sent = spark.sparkContext.broadcast((rest, plain))
    made: list[object] = []

    def get() -> object:
        if not made:
            kind, own = pickle.loads(sent.value[0])
            made.append(object.__new__(kind))
            vars(made[0]).update(sent.value[1] | own)
        return made[0]

    return get


_written: list[str] = []


def clear_intermediates(spark: SparkSession) -> None:
    """Deletes what this driver's operators wrote; for when their results have been used."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files and broadcasts of plans that are done. It does so when the driver collects its
    garbage, which a long row of small plans puts off while they, and the heap, grow in number and size."""
    gc.collect()
    spark._jvm.System.gc()


SLOTS = 1 << 23


def id_slot(col: str) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(SLOTS))


def id_bits(ids: DataFrame) -> np.ndarray:
    """A bit for each of a fixed number of hashes of the column ``id``. More ids only mean more rows that pass in vain."""
    words = ids.select(id_slot("id").alias("slot")).groupBy(F.shiftright("slot", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot & 31 AS INT)))").alias("bits")).toArrow()
    bits = np.zeros(SLOTS >> 5, dtype=np.uint32)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return bits


def may_be_in(rows: DataFrame, ids: DataFrame, col: str, name: str) -> DataFrame:
    """``rows`` with ``name``: whether the value of ``col`` may be among ``ids`` (column ``id``); never wrong about a no, seldom
    about a yes."""
    words, slot = unused([*rows.columns, name], "words"), unused([*rows.columns, name], "slot")
    one = pa.table({words: pa.array([id_bits(ids).view(np.int32)], pa.list_(pa.int32()))})
    one = F.broadcast(rows.sparkSession.createDataFrame(one))  # one row of fixed size, 1 MB
    met = F.expr(f"shiftright(get(`{words}`, CAST(`{slot}` >> 5 AS INT)), CAST(`{slot}` & 31 AS INT)) & 1 = 1")
    columns = [F.col(f"`{c}`") for c in rows.columns]
    return rows.select(*columns, id_slot(col).alias(slot)).join(one).select(*columns, met.alias(name))


def among(rows: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """The rows whose ``col`` may be among ``ids``."""
    name = unused(rows.columns, "met")
    return may_be_in(rows, ids, col, name).where(F.col(name)).drop(name)


def drop_ids(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the ids in ``gone``; rows with null id stay. Only rows whose hash occurs in ``gone`` are shuffled."""
    met, out = unused([id_col, *docs.columns], "met"), unused([id_col, *docs.columns], "gone")
    gone = gone.select(F.col(id_col).alias(out)).where(F.col(out).isNotNull()).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = may_be_in(docs, gone.select(F.col(out).alias("id")), id_col, met)
    doubtful = marked.where(F.col(met)).join(gone, F.col(id_col) == F.col(out), "left_anti")
    return marked.where(~F.col(met)).union(doubtful).select(*columns)


def keep_once(docs: DataFrame, repeated: DataFrame, key_col: str) -> DataFrame:
    """``docs`` with one row for each key in ``repeated``; rows with null key stay. Only rows whose hash occurs there are shuffled."""
    met = unused(docs.columns, "met")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = may_be_in(docs, repeated.select(F.col(key_col).alias("id")), key_col, met)
    again = F.col(met) & F.col(key_col).isNotNull()
    one = F.min_by(F.struct(*columns), F.xxhash64(*columns))
    doubtful = marked.where(again).groupBy(F.col(key_col).alias("key")).agg(one.alias("one")).select("one.*")
    return marked.where(~again).select(*columns).union(doubtful.select(*columns))


def frequent(pairs: DataFrame, keys: tuple[str, ...], total: int) -> dict[str, DataFrame]:
    """For each of ``keys``, columns of numbers: the values that many of the ``total`` rows of ``pairs`` hold, and in how many
    parts (``n_parts``) their rows are dealt out. Keys without such values are left out. They are counted once and fetched,
    1000 rows a key at most, so that the plans of the joins have them as constants and don't hold their counting as well."""
    most = max(256, total // 1000)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(k).cast("long").alias("key")) for k in keys])).alias("of")
    counted = pairs.select(each).groupBy("of.side", "of.key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    found = counted.select("side", "key", F.ceil(F.col("n") / most).cast("int").alias("n_parts")).toArrow()
    out = {}
    for k in keys:
        own = found.filter(pc.equal(found["side"], k))
        if len(own):
            out[k] = pairs.sparkSession.createDataFrame(pa.table({k: own["key"], "n_parts": own["n_parts"]}))
    return out


def spread_join(pairs: DataFrame, side: DataFrame, key: str, by: str, often: dict[str, DataFrame]) -> DataFrame:
    """Inner join on ``key`` with one row a key in ``side``. A value in ``often`` is dealt out by ``by`` and its row of
    ``side`` repeated for each part."""
    if key not in often:
        return pairs.join(side, key)
    parts = F.broadcast(often[key])  # 1000 rows at most
    dealt = pairs.join(parts, key, "left").withColumn("dealt", F.coalesce(F.pmod(F.xxhash64(by), "n_parts").cast("int"), F.lit(0))).drop("n_parts")
    repeated = side.join(parts, key, "left").withColumn("dealt", F.explode(F.sequence(F.lit(0), F.coalesce("n_parts", F.lit(1)) - 1))).drop("n_parts")
    return dealt.join(repeated, [key, "dealt"]).drop("dealt")


def separators(extra: bytes = b"") -> np.ndarray:
    """Lookup table over byte values: ASCII white space, and ``extra``, part words."""
    mask = np.zeros(256, dtype=bool)
    mask[list(b" \t\n\x0b\x0c\r" + extra)] = True
    return mask


WHITE = separators()
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        gc.collect()  # a worker that is used again may still hold the tables of earlier tasks
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def give_back() -> None:
    """Hands memory that isn't used any more back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can do it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that leaves its worker small: workers are kept for later tasks, and several wait at a time."""

    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for k in range(2):
                _powers[k] = np.ones(1, dtype=np.uint64)
            give_back()

    return inner


def byte_texts(column: pa.Array) -> list[bytes]:
    """A column of strings as UTF-8; null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def with_columns(docs: DataFrame, text_col: str, fields: list[T.StructField], made: Callable[[list[bytes]], list[pa.Array]]) -> DataFrame:
    """``docs`` with columns that ``made`` gives for the texts of a batch. An input column of such a name is replaced.

    All other columns pass through as they are, in Arrow, so that nothing is rounded or converted on the way.
    """
    names = {f.name.lower() for f in fields}
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])
    position = kept.columns.index(text_col)
    schema = T.StructType([*kept.schema.fields, *fields])
    own = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *made(byte_texts(b.column(position)))], names=own)

    return kept.mapInArrow(tidy(run), schema)


class Words:
    """Words of a list of texts: byte spans in one buffer, and where each text's words begin."""

    def __init__(self, texts: list[bytes], seps: np.ndarray = WHITE):
        joined = b"\n" + b"\n".join(texts) + b"\n"
        self.buffer = np.frombuffer(joined, dtype=np.uint8)
        sep = seps[self.buffer]
        edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
        self.starts, self.ends = edge[0::2], edge[1::2]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begins = np.concatenate(([0], np.cumsum(lengths + 1))) + 1
        self.first = np.searchsorted(self.starts, begins)

    def _sums(self) -> np.ndarray:
        if not hasattr(self, "_cum"):
            power, _ = _power_tables(len(self.buffer) + 1)
            self._cum = np.zeros(len(self.buffer) + 1, dtype=np.uint64)
            np.cumsum((self.buffer.astype(np.uint64) + np.uint64(1)) * power[: len(self.buffer)], out=self._cum[1:])
        return self._cum

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first ``most`` bytes."""
        cum = self._sums()
        ends = self.ends if most is None else np.minimum(self.ends, self.starts + most)
        _, inverse = _power_tables(len(self.buffer) + 1)
        return mix64((cum[ends] - cum[self.starts]) * inverse[self.starts])


def encode(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def slices(texts: list[bytes], limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes, at least one text each; bounds numpy's working set."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
