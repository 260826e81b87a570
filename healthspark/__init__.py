"""healthspark: code-health analytics for source-file corpora on Apache Spark.

Entry points: :func:`healthspark.plans.analysis.analyze` (the lazy bundle of all
derived tables) and :mod:`healthspark.api` (function-style names).
"""

__version__ = "0.1.0"
