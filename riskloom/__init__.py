"""riskloom: transaction-risk analytics as Spark DataFrame / SQL / Structured Streaming jobs.

Sub-packages
------------
sources    readers, sinks and the mapping of the driver's test tables to a transaction log
functions  column expressions: features, rule score, risk levels, decisions, factors, JSON
operators  DataFrame operators: point-in-time windows, joins, aggregates, filters, top-k,
           keyed state with TTL, learning and evaluation
plans      composed jobs (feature vector, scored table), SQL views / table function, the
           query catalog used by ``__spark_entry__``
streaming  Structured Streaming twins of the batch operators
"""

__version__ = "0.1.0"
