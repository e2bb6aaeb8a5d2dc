"""Audited population origins and source provenance as Spark DataFrame jobs."""
