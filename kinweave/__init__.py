"""kinweave: follow-graph analytics as PySpark DataFrame programs."""
