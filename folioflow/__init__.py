"""A Spark-first engine for page corpora: archives, labels, recognised lines and their evaluation.

Every public operator takes and returns DataFrames (or Columns) and leaves the physical plan to Catalyst.
"""

__version__ = "0.1.0"
