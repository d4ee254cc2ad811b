"""riskgate: factual-risk scoring of LLM outputs as Spark DataFrame jobs.

Every public function takes and returns DataFrames (or Columns); nothing holds a
global session. Catalyst plans the work: joins, aggregates and windows are plain
DataFrame operations, and the three probes are ``pyspark.ml`` stages.
"""

__version__ = "0.1.0"
