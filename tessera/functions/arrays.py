"""Token rows and vectors as array columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Special ids and the shortest window.
PAD, MASK, UNK, CLS, SEP, SPECIALS, MIN_WINDOW = 0, 1, 2, 3, 4, 5, 32


def framed(ids: Column, length: int) -> Column:
    """[CLS] ids [SEP] and padding: ids are cut to length - 2."""
    row = F.concat(F.array(F.lit(CLS)), F.slice(ids, 1, length - 2), F.array(F.lit(SEP)))
    return padded(row, length)


def padded(ids: Column, length: int) -> Column:
    row = F.slice(ids, 1, length)
    return F.concat(row, F.array_repeat(F.lit(PAD), F.lit(length) - F.size(row)))


def attention(row: Column) -> Column:
    return F.transform(row, lambda x: (x != PAD).cast("int"))


def cuts(ids: Column, body: int) -> Column:
    """The consecutive pieces of `body` ids."""
    some = F.transform(F.sequence(F.lit(0), F.greatest(F.size(ids) - 1, F.lit(0)), F.lit(body)), lambda i: F.slice(ids, i + 1, body))
    return F.filter(some, lambda x: F.size(x) > 0)


def content(ids: Column) -> Column:
    """Ids that are no special ones."""
    return F.filter(ids, lambda x: x >= SPECIALS)


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


def unit(vector: Column, epsilon: float = 1e-12) -> Column:
    """The vector over its norm; epsilon is added to the norm."""
    return F.transform(vector, lambda x: x / (norm(vector) + epsilon))


def truncated(vector: Column, dim: int, epsilon: float = 1e-12) -> Column:
    """The first `dim` components, normalised again."""
    return unit(F.slice(vector, 1, dim), epsilon)


def joined(ids: Column) -> Column:
    """Ids as text, separated by commas."""
    return F.concat_ws(",", ids.cast("array<string>"))


def joined_lists(ends: pa.Array, ids: np.ndarray) -> pa.Array:
    """joined, within a task: of lists of integers, given as their ends and the numbers of all."""
    coded = pa.array(ids).dictionary_encode()
    words = pc.cast(coded.dictionary, pa.string()).take(coded.indices)
    return pc.binary_join(pa.ListArray.from_arrays(ends, words), ",")
