"""qalytics — QA-delivery analytics (ingest, conform, marts, serving) on Spark.

Everything is expressed with the DataFrame API so Catalyst and AQE plan it;
see README.md for the operator map.
"""

__version__ = "0.1.0"
