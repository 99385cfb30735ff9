"""grainsieve: code, dependency and sensitive-data scanning as Spark DataFrame jobs.

Every public function takes and returns DataFrames (or Columns).  The corpus is a table of
texts; findings, detections and package matches are tables too, so filtering, baselines, gates
and reports are ordinary joins and aggregations.
"""
