from qalytics.streaming.jobs import land_files, daily_counts, microbatch_ingest, velocity_stream  # noqa: F401
