"""Event-time streaming over Structured Streaming."""

from .frame import StreamingFrame, StreamWriter
from .stateful import (
    count_window_processor,
    group_state,
    keyed_process,
    match_processor,
)

__all__ = ["StreamWriter", "StreamingFrame", "count_window_processor", "group_state", "keyed_process", "match_processor"]
