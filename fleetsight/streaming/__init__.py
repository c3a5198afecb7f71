"""Micro-batch (Structured Streaming) forms of the stateful operators."""

from fleetsight.streaming.micro_batch import (  # noqa: F401
    CounterStateSink, MeasurementAppendSink, SnapshotMergeSink, counter_totals_stream, windowed_rollup,
)
from fleetsight.streaming.staleness import stale_sources_stream  # noqa: F401
