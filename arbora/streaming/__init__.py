"""Read counts kept up to date while reads arrive."""

from arbora.streaming.reads import count_reads

__all__ = ["count_reads"]
