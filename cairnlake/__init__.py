"""cairnlake: analytics over content-addressed, versioned media repositories, on Spark.

Sub-packages
------------
``sources``    readers of the relations (Parquet tables, JSON logs, object trees) and sinks
``functions``  column expressions: hashes, paths, sizes, versions, media kinds
``operators``  relational, graph, interval, policy and storage operators
``plans``      named queries over the relations and their SQL statements
``streaming``  Structured Streaming twins of the event-driven operators
``llm``        optional operators for building training data
"""

__version__ = "0.1.0"
