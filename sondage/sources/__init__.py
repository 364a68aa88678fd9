"""Readers and writers shared by every plan."""

from sondage.sources.tables import discard, durable, read_table, text_batches

__all__ = ["discard", "durable", "read_table", "text_batches"]
