"""Array expressions of an observation record: cleaning, masks, lookups, checks. All stay in the JVM and need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) != float("inf"))


def fill_nonfinite(a: Column, fill: float = 0.0) -> Column:
    """NaN and infinities become ``fill``."""
    return F.transform(a, lambda v: F.when(is_finite(v), v).otherwise(F.lit(float(fill))))


def clean_then_cap(a: Column, top: float) -> Column:
    """The writer's order: clean first, then cap above, so an infinity ends as 0."""
    return F.transform(fill_nonfinite(a), lambda v: F.least(v, F.lit(float(top))))


def clip_then_clean(a: Column, top: float, bottom: float = 0.0) -> Column:
    """The reader's order: clip both ways first, so an infinity ends at ``top``; NaN becomes 0."""
    return F.transform(a, lambda v: F.least(F.greatest(F.nanvl(v, F.lit(0.0)), F.lit(float(bottom))), F.lit(float(top))))


def assert_finite(a: Column, name: str) -> Column:
    """The array itself, or an error that names the field."""
    return F.when(F.exists(a, lambda v: ~is_finite(v)), F.raise_error(F.lit(f"non-finite value in {name}"))).otherwise(a)


def argmax(a: Column) -> Column:
    """0-based place of the first largest element; NaN elements don't count."""
    clean = F.filter(a, lambda v: ~F.isnan(v))
    return (F.array_position(a, F.array_max(clean)) - 1).cast("long")


def nan_max(a: Column) -> Column:
    return F.array_max(F.filter(a, lambda v: ~F.isnan(v)))


def first_true(mask: Column) -> Column:
    """0-based place of the first true element, null if there is none."""
    return F.nullif(F.array_position(mask, True), F.lit(0)) - 1


def places(mask: Column) -> Column:
    """0-based places of true elements, in order."""
    marked = F.transform(mask, lambda m, i: F.when(m, i.cast("long")))
    return F.filter(marked, lambda i: i.isNotNull())


def gather(a: Column, at: Column) -> Column:
    """Element at a 0-based place; null beyond the ends."""
    return F.get(a, at.cast("int"))


def newly_off(before: Column, now: Column) -> Column:
    """Mask of elements that were on and are off."""
    return F.zip_with(before, now, lambda b, n: b & ~n)


def difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def guarded_ratio(a: Column, b: Column, default: float) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(float(default)))


def capped_ratio(x: Column, full: float) -> Column:
    return F.greatest(F.least(x / F.lit(float(full)), F.lit(1.0)), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return F.round(100 * part / F.greatest(whole, F.lit(1)), 2)


def wrong_size(a: Column, expected: int) -> Column:
    """True if the field is there with another length."""
    return F.coalesce(a.isNotNull() & (F.size(a) != expected), F.lit(False))


def count_nan(a: Column) -> Column:
    return F.coalesce(F.size(F.filter(a, F.isnan)), F.lit(0)).cast("long")


def count_inf(a: Column) -> Column:
    return F.coalesce(F.size(F.filter(a, lambda v: F.abs(v) == float("inf"))), F.lit(0)).cast("long")


def band(x: Column, steps: list[tuple[float, str]], below: str) -> Column:
    """Name of the highest step that ``x`` reaches."""
    out = F.lit(below)
    for least, name in sorted(steps):
        out = F.when(x >= least, name).otherwise(out)
    return out


def encode_label(label: Column, ids: dict[str, int], unknown: int | None = None) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    found = F.try_element_at(known, label)
    return found if unknown is None else F.coalesce(found, F.lit(unknown))


def sentinel(x: Column, value: int = -1) -> Column:
    return F.coalesce(x, F.lit(value))
