"""varlens: Spark-native analytics for labelled-variant classification work.

Subpackages
-----------
sources    scans and sinks (delimited, GAF, FASTA, prediction archives, folds)
functions  column-level helpers: distributed prefix sums, ranks, tail probabilities
operators  DataFrame -> DataFrame operators (keys, joins, groups, metrics, curves,
           density, features, sequence, arrays, splits, stats, ml)
plans      derived views over the driver tables and the registered queries
streaming  incremental forms of the mergeable aggregates
"""

__version__ = "0.1.0"
