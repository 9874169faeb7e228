"""Text expressions of the rule pipeline, and the sliding chunker."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What opens and closes a model's reasoning, and code fences around its answer.
_THINK = r"(?s)<think>.*?</think>"
_FENCE = r"```(?:json)?"
_STRIP = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _STRIP, "")


def strip_think(text: Column) -> Column:
    return strip(F.regexp_replace(text, _THINK, ""))


def _outer_array(text: Column, check_order: bool) -> Column:
    first = F.instr(text, "[")
    last = F.length(text) - F.instr(F.reverse(text), "]") + 1
    there = (first > 0) & (F.instr(text, "]") > 0)
    if check_order:
        there = there & (last > first)
    return F.when(there, F.substring(text, first, last - first + 1))


def carve_array(text: Column) -> Column:
    """From the first ``[`` to the last ``]`` outside of reasoning and fences; null if absent or reversed."""
    return _outer_array(strip(F.regexp_replace(strip_think(text), _FENCE, "")), True)


def carve_array_leading_fence(text: Column) -> Column:
    """The probe's variant: only a fence at the very start is unwrapped, by lines, and order isn't checked."""
    bare = strip_think(text)
    lines = F.split(bare, "\n")
    inner = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - F.when(strip(F.element_at(lines, -1)).startswith("```"), 2).otherwise(1), F.lit(0))), "\n")
    return _outer_array(F.when(bare.startswith("```"), inner).otherwise(bare), False)


def fill(template: str, **columns: Column) -> Column:
    """``{name}`` in the template replaced by the columns, in the order given."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), c)
    return out


def rule_id(n: Column) -> Column:
    return F.format_string("R_%03d", n)


def stem(path: Column, suffix: str = "_candidates") -> Column:
    """File name without folder and last extension; every occurrence of ``suffix`` goes."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit(suffix), F.lit(""))


def spans(text: str | None, size: int, overlap: int, sep: str) -> Iterator[tuple[int, int, int, str]]:
    """Chunk number, start, end and stripped text; cuts at the last ``sep`` beyond four fifths of a chunk."""
    if size <= 0 or not 0 <= overlap < 0.8 * size:
        raise ValueError("the overlap has to be under four fifths of the size")
    text = text or ""
    start = number = 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            least = start + int(size * 0.8)
            cut = text.rfind(sep, least, end)
            if cut > least:
                end = cut
        if piece := text[start:end].strip():
            yield number, start, end, piece
            number += 1
        if end >= len(text):
            return
        start = end - overlap


def chunk(docs: DataFrame, id_col: str, text_col: str, size: int = 1200, overlap: int = 200, sep: str = "\n\n") -> DataFrame:
    """One row per chunk: id, chunk, start, end, text. Each document is cut on its own, so nothing is shuffled."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(i, *s) for i, t in zip(b["id"], b["text"], strict=True) for s in spans(t, size, overlap, sep)]
            yield pd.DataFrame(rows, columns=["id", "chunk", "start", "end", "text"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, chunk long, start long, end long, text string").withColumnRenamed("id", id_col)
