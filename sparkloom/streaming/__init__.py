"""Queries over streams, one micro-batch at a time."""

from .batches import run_on_batches

__all__ = ["run_on_batches"]
