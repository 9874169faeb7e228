"""Table functions for SQL. ``register(spark)`` makes them known to a session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .names import unused
from .text import spans

SIZE, OVERLAP, SEPARATOR = 1200, 200, "\n\n"
_NEW = (("chunk", T.LongType()), ("start", T.LongType()), ("end", T.LongType()), ("piece", T.StringType()))


class ChunkTable:
    """``chunk_table(TABLE(...), 'column' [, size, overlap, separator])``: the table's rows once for each chunk of a text
    column, all columns passing through, with ``chunk``, ``start``, ``end`` and ``piece``; names that the table has already get
    an underscore. A null text has no chunks. Rows stay where they are."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, text_col: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None, separator: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument has to be a table")
        fields = rows.dataType.fields
        if text_col.value not in [f.name for f in fields]:
            raise ValueError(f"the table has no column {text_col.value!r}")
        names = [f.name for f in fields]
        added = []
        for name, kind in _NEW:
            names.append(unused(names, name))
            added.append(T.StructField(names[-1], kind))
        return AnalyzeResult(T.StructType([*fields, *added]))

    def eval(self, rows: Row, text_col: str, size: int = SIZE, overlap: int = OVERLAP, separator: str = SEPARATOR) -> Iterator[tuple]:
        for number, start, end, piece in spans(rows[text_col], size, overlap, separator):
            yield (*rows, number, start, end, piece)


class ChunkText:
    """``chunk_text(text [, size, overlap, separator])``: the chunks of one text, for lateral joins."""

    def eval(self, text: str, size: int = SIZE, overlap: int = OVERLAP, separator: str = SEPARATOR) -> Iterator[tuple]:
        yield from spans(text, size, overlap, separator)


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk_table", udtf(ChunkTable))
    spark.udtf.register("chunk_text", udtf(ChunkText, returnType=T.StructType([T.StructField(n, k) for n, k in _NEW])))
