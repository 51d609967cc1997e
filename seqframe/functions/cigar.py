"""CIGAR strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = "array<struct<start_pos:bigint,end_pos:bigint>>"


def _total(text: Column, pattern: str) -> Column:
    """Sum of the numbers that ``pattern`` (one group) finds."""
    numbers = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def reference_length(cigar: Column) -> Column:
    return _total(cigar, r"(\d+)[MDN=X]")


def leading_clip(cigar: Column) -> Column:
    return _total(F.regexp_extract(cigar, r"^((?:\d+[SH])*)", 1), r"(\d+)[SH]")


def trailing_clip(cigar: Column) -> Column:
    return _total(F.regexp_extract(cigar, r"((?:\d+[SH])*)$", 1), r"(\d+)[SH]")


def unclipped_five_prime(pos: Column, cigar: Column, flag: Column) -> Column:
    """Where the first sequenced base would lie had nothing been clipped."""
    reverse = flag.bitwiseAND(16) != 0
    return F.when(reverse, pos + reference_length(cigar) - 1 + trailing_clip(cigar)).otherwise(
        pos - leading_clip(cigar)
    )


def blocks(pos: Column, cigar: Column, gap_ops: str = "N") -> Column:
    """Aligned stretches (closed, 1-based) between the operations in ``gap_ops``.

    Other reference-consuming operations extend a stretch; insertions, clips and
    padding take no room on the reference.
    """
    at = pos.cast("bigint")
    one = F.array(F.struct(at.alias("start_pos"), (at + F.regexp_extract(cigar, r"^(\d+)", 1).try_cast("bigint") - 1).alias("end_pos")))
    kept = F.regexp_replace(cigar, r"\d+[ISHP]", "")
    gap = rf"(\d+)[{gap_ops}]"
    stretches = F.split(kept, rf"\d+[{gap_ops}]")
    gaps = F.regexp_extract_all(kept, F.lit(gap), F.lit(1))
    start = F.struct(at.alias("at"), F.array().cast(BLOCK).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        size = _total(x["stretch"], r"(\d+)")
        block = F.struct(acc["at"].alias("start_pos"), (acc["at"] + size - 1).alias("end_pos"))
        return F.struct(
            (acc["at"] + size + F.coalesce(x["gap"].cast("bigint"), F.lit(0))).alias("at"),
            F.when(size > 0, F.concat(acc["out"], F.array(block))).otherwise(acc["out"]).alias("out"),
        )

    zipped = F.arrays_zip(stretches.alias("stretch"), gaps.alias("gap"))
    many = F.aggregate(zipped, start, step, lambda acc: acc["out"])
    return F.when(cigar.rlike(r"^\d+[M=X]$"), one).when(cigar.rlike(r"\d"), many).otherwise(F.array().cast(BLOCK))


SEGMENT = "array<struct<op:string,ref_start:bigint,read_start:int,size:int>>"


def segments(pos: Column, cigar: Column) -> Column:
    """Aligned (M) and deleted (D) pieces with their place on the reference and in the read (0-based)."""
    at = pos.cast("bigint")

    def piece(op: Column, ref: Column, read: Column, size: Column) -> Column:
        return F.struct(op.alias("op"), ref.alias("ref_start"), read.alias("read_start"), size.alias("size"))

    whole = F.regexp_extract(cigar, r"^(\d+)", 1).try_cast("int")
    one = F.array(piece(F.lit("M"), at, F.lit(0), whole))
    sizes = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1))
    ops = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    start = F.struct(at.alias("ref"), F.lit(0).alias("read"), F.array().cast(SEGMENT).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        size, op = x["n"].cast("int"), x["op"]
        aligned, deleted = op.isin("M", "=", "X"), op == "D"
        kind = F.when(aligned, F.lit("M")).otherwise(F.lit("D"))
        added = F.concat(acc["out"], F.array(piece(kind, acc["ref"], acc["read"], size)))
        return F.struct(
            F.when(op.isin("M", "=", "X", "D", "N"), acc["ref"] + size).otherwise(acc["ref"]).alias("ref"),
            F.when(op.isin("M", "=", "X", "I", "S"), acc["read"] + size).otherwise(acc["read"]).alias("read"),
            F.when(aligned | deleted, added).otherwise(acc["out"]).alias("out"),
        )

    many = F.aggregate(F.arrays_zip(sizes.alias("n"), ops.alias("op")), start, step, lambda acc: acc["out"])
    return F.when(cigar.rlike(r"^\d+[M=X]$"), one).when(cigar.rlike(r"\d"), many).otherwise(F.array().cast(SEGMENT))
