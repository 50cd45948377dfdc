"""Paired- and rated-judgement analytics as Spark DataFrame operations.

Layers, bottom up:

* ``functions``  -- Column expressions (answer parsing, ids, pricing windows, labels)
* ``operators``  -- DataFrame -> DataFrame operators (design, collapse, effects, ...)
* ``sources``    -- readers, sinks and the views derived from the benchmark tables
* ``streaming``  -- incremental ingest and progress counters (Structured Streaming)
* ``plans``      -- the analysis entry points, compositions of the operators
* ``contract``   -- the registered queries and the SQL they are checked against
"""

__version__ = "0.1.0"
