"""lineloom: SQL-corpus lineage and medallion transformations as Spark DataFrame jobs.

Every public function takes and returns DataFrames.  Nothing here runs the SQL
it reads: scripts are rows, lineage is joins and aggregates over them.
"""

__version__ = "0.1.0"
