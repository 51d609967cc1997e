"""Imports every module that registers queries."""

from seqframe.plans import alignment_queries, base_queries, de_queries, qc_queries, run_queries, source_queries, trim_queries, variant_queries  # noqa: F401
