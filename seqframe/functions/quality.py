"""Base qualities and trimming positions as column expressions (no Python per row; qualities become text a batch at a time)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_phred33(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.ascii(c) - 33)


def encode_phred33(quals: Column) -> Column:
    """One character a quality, as ``char`` gives it; NULLs are left out."""

    def encode(lists: pa.Array) -> pa.Array:
        values = lists.flatten()
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        none = lists.is_null().to_numpy(zero_copy_only=False)
        there = values.is_valid().to_numpy(zero_copy_only=False)
        code = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 33
        text = np.where(code < 0, 0, code % 256)
        width = np.where(there & (code >= 0), 1 + (text > 127), 0)
        ends = np.r_[0, np.cumsum(width)][np.r_[0, np.cumsum(size)]]
        if (width == 1).all():
            data = text.astype(np.uint8).tobytes()
        else:
            data = "".join(map(chr, text[width > 0].tolist())).encode()
        out = pa.StringArray.from_buffers(len(lists), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data))
        return pa.array([None if n else t for n, t in zip(none.tolist(), out.to_pylist())], pa.string()) if none.any() else out

    return F.arrow_udf(encode, "string")(quals.cast("array<int>"))


def first_at_least(quals: Column, q: Column) -> Column:
    """1-based position of the first quality >= q; one past the end if there is none."""
    at = F.array_position(F.transform(quals, lambda x: x >= q), F.lit(True)).cast("int")
    return F.when(at == 0, F.size(quals) + 1).otherwise(at)


def last_at_least(quals: Column, q: Column) -> Column:
    """1-based position of the last quality >= q; 0 if there is none."""
    return F.size(quals) + 1 - first_at_least(F.reverse(quals), q)


def window_cut(quals: Column, width: Column, q: Column) -> Column:
    """Bases before the first window of ``width`` whose mean quality is below q (all if none).

    One pass with one integer of state: the running window sum while nothing is
    found, then ``-(cut + 1)``.
    """
    n = F.size(quals)

    def step(acc: Column, i: Column) -> Column:
        total = acc + F.get(quals, i) - F.when(i >= width, F.get(quals, i - width)).otherwise(0)
        low = (i >= width - 1) & (total < width * q)
        return F.when(acc < 0, acc).when(low, width - i - 2).otherwise(total)

    index = F.when(n >= width, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(
        F.array().cast("array<int>")
    )
    return F.aggregate(index, F.lit(0), step, lambda acc: F.when(acc < 0, -acc - 1).otherwise(n))
