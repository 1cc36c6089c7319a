"""Ragged columns: many sequences of different lengths in one row, as a struct of their
``values``, one after the other, and ``offsets``, which are one more than the sequences.
Slices, joins and splits keep the two together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _struct(values: Column, offsets: Column) -> Column:
    return F.struct(values.alias("values"), offsets.alias("offsets"))


def offsets_of(lengths: Column) -> Column:
    """Running sums of lengths, from 0."""
    zero = F.array(F.lit(0).cast("long"))
    return F.aggregate(lengths, zero, lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n.cast("long")))


def from_lists(lists: Column) -> Column:
    """From an array of arrays."""
    return _struct(F.flatten(lists), offsets_of(F.transform(lists, lambda x: F.size(x))))


def from_padded(rows: Column, lengths: Column) -> Column:
    """From an array of equally long arrays and the lengths of what counts of each."""
    return from_lists(F.zip_with(rows, lengths, lambda x, n: F.slice(x, F.lit(1), n.cast("int"))))


def count(ragged: Column) -> Column:
    return F.size(ragged["offsets"]) - 1


def lengths(ragged: Column) -> Column:
    off = ragged["offsets"]
    return F.transform(F.slice(off, F.lit(2), count(ragged)), lambda b, i: b - F.get(off, i))


def row(ragged: Column, i: Column) -> Column:
    """The i-th sequence, from 0."""
    begin, end = F.get(ragged["offsets"], i), F.get(ragged["offsets"], i + 1)
    return F.slice(ragged["values"], (begin + 1).cast("int"), (end - begin).cast("int"))


def to_lists(ragged: Column) -> Column:
    off = ragged["offsets"]
    return F.transform(F.slice(off, F.lit(1), count(ragged)), lambda a, i: F.slice(ragged["values"], (a + 1).cast("int"), (F.get(off, i + 1) - a).cast("int")))


def to_padded(ragged: Column, filler, length: int | None = None) -> Column:
    """Equally long arrays: as long as the longest, or ``length``, which cuts too."""
    most = F.lit(length) if length is not None else F.coalesce(F.array_max(lengths(ragged)), F.lit(0)).cast("int")
    fill = F.lit(filler)
    return F.transform(to_lists(ragged), lambda x: F.concat(F.slice(x, F.lit(1), most), F.array_repeat(fill, F.greatest(F.lit(0), most - F.size(x)))))


def take(ragged: Column, begin: Column, end: Column) -> Column:
    """The sequences ``begin`` to ``end`` (not included), both within 0 and the count."""
    n = count(ragged)
    a, b = (F.least(F.greatest(x.cast("int"), F.lit(0)), n) for x in (begin, end))
    b = F.greatest(a, b)
    first, last = F.get(ragged["offsets"], a), F.get(ragged["offsets"], b)
    return _struct(F.slice(ragged["values"], (first + 1).cast("int"), (last - first).cast("int")), F.transform(F.slice(ragged["offsets"], a + 1, b - a + 1), lambda x: x - first))


def concat(*parts: Column) -> Column:
    """The sequences of all parts, in order."""
    out = parts[0]
    for p in parts[1:]:
        shifted = F.transform(F.slice(p["offsets"], F.lit(2), count(p)), _plus(F.element_at(out["offsets"], -1)))
        out = _struct(F.concat(out["values"], p["values"]), F.concat(out["offsets"], shifted))
    return out


def _plus(end: Column):
    return lambda x: x + end


def split(ragged: Column, size: int) -> Column:
    """An array of ragged parts of ``size`` sequences, the last with what is left."""
    starts = F.when(count(ragged) > 0, F.sequence(F.lit(0), count(ragged) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda a: take(ragged, a, a + size))


def responses(ragged: Column, sizes: Column) -> Column:
    """What a model says of the last ``sizes`` tokens of each sequence (prompt and response):
    its outputs one token earlier, as an output belongs to the next token."""
    off = ragged["offsets"]
    part = F.zip_with(F.slice(off, F.lit(2), count(ragged)), sizes, lambda end, n: F.slice(ragged["values"], (end - n).cast("int"), n.cast("int")))
    return from_lists(part)


def is_sound(ragged: Column) -> Column:
    """Whether offsets start at 0, never fall and end with the values."""
    off = ragged["offsets"]
    rises = F.forall(F.transform(F.slice(off, F.lit(2), count(ragged)), lambda b, i: b >= F.get(off, i)), lambda x: x)
    return (F.size(off) >= 1) & (F.get(off, F.lit(0)) == 0) & rises & (F.element_at(off, -1) == F.size(ragged["values"]))
