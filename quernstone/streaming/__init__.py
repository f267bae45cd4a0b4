"""Token counts of a stream of documents."""

from quernstone.streaming.counts import stream_frequencies

__all__ = ["stream_frequencies"]
