"""Sources and sinks: driver tables, fixture views, ingest and publish."""
