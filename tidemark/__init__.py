"""Snapshot, reconciliation and corpus analytics expressed as Spark DataFrame plans."""
