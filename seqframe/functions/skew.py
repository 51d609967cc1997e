"""Joins of a large table with a smaller lookup, safe against hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A lookup side is broadcast only after it was counted to hold at most this many rows.
BROADCAST_ROWS = 200_000

#: And this many bytes, so that a table of long values, such as reference chunks, is joined by shuffle.
BROADCAST_BYTES = 64 << 20

#: Copies of the lookup side when it is too large to broadcast.
SALTS = 16


def at_most(df: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> bool:
    """True if ``df`` holds no more than ``rows`` rows and about ``size`` bytes, its values written as text (reads at most one row more)."""
    written = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(written), F.lit(0))).first()
    return n <= rows and total <= size


def salt_of(df: DataFrame, salts: int) -> Column:
    """A salt spread by row content, so a retried task gives each row the same one."""
    plain = [F.col(f"`{c.name}`") for c in df.schema.fields if "map" not in c.dataType.simpleString()]
    return F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int")


def lookup_join(
    fact: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    *,
    count_first: bool = True,
    broadcast_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``fact`` with ``lookup`` (``how``: inner, left, left_semi or left_anti).

    A counted-small lookup is broadcast. Otherwise the hot keys of ``fact`` are
    split over ``salts`` sub-keys and the lookup is copied to each of them, so
    no key is bound to one task. Counting runs the lookup's plan once more, so hand
    in a stored table if it is dear to compute; ``count_first=False`` skips the count
    where ``fact`` is modest. Where the lookup may be as large as ``fact`` its copies would be too many: ``salts=1`` makes none
    and leaves hot keys to the adaptive planner, which splits them.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    on = list(on)
    if count_first and at_most(lookup, broadcast_rows):
        return fact.join(F.broadcast(lookup), on, how)
    if salts == 1:
        return fact.join(lookup.hint("merge"), on, how)
    salted = fact.withColumn("_salt", salt_of(fact, salts))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # Spark guesses the size of the copies from that of the files, too low by far, and would collect them on the driver
    return salted.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")
