"""seqframe: sequencing analytics as Spark DataFrame transformations.

Every operator takes DataFrames holding all samples of a run (keyed by
``sample_id``) and returns a lazy DataFrame.
"""

__version__ = "0.1.0"
