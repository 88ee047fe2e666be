"""Knowledge-gap metrics and batch model inference as plain Spark plans.

``sources``    scans and sinks (snapshot tables, Parquet, TSV, images, logs)
``functions``  Column helpers and argument checks
``operators``  one DataFrame in, one DataFrame out
``plans``      whole item frames, page frames, metrics and image jobs
"""
