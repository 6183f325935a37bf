"""Streaming.

The reference has no stream (no stream reader, watermark, window or state).
The only streaming use here is the same batch scoring (MOD-18) applied to a
streaming DataFrame: a fitted ``PipelineModel.transform`` is a stateless map,
so ``score_stream`` just composes it with the label decoding.
"""

from .scoring import score_stream  # noqa: F401
