"""Schemas, table readers and writers, and the mapping of the raw tables onto the model."""
