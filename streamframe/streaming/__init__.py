"""Structured Streaming: per-row state, processing-time windows, fan-out, live-table joins, state reading."""

from .fanout import fan_out, live_table_join  # noqa: F401
from .processors import fold_per_row, group_per_row, read_state, session_by_clock, tumbling_by_clock  # noqa: F401
