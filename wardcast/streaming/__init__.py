"""Incremental, restartable ingest with Structured Streaming.

The reference has no unbounded sources or streaming operators; the only
streaming use here is the bulk load of compressed export files (S3) run as
an ``availableNow`` file stream, which gives exactly-once, restartable
loading of a large archive directory.
"""
