"""Plan-level helpers: shared working storage and multi-stage pipelines."""
