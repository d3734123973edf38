"""Structured Streaming jobs."""

from .upsert_stream import apply_batch, batch_tag, upsert_stream

__all__ = ["apply_batch", "batch_tag", "upsert_stream"]
