"""Continuous ingest of posted load forms (the batch load job, per micro-batch)."""

from fleetbook.streaming.loads import ingest_entry_forms

__all__ = ["ingest_entry_forms"]
