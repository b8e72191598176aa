"""Structured Streaming forms: incremental change feed, run timeouts, first-wins."""

from .change_feed import change_feed, ITEM_STREAM_SCHEMA
from .run_timeouts import run_timeouts, run_timeouts_stateful, RUN_EVENT_SCHEMA
from .first_wins import first_wins_ordered, first_wins_stream
from .lifecycle import final_runs, run_lifecycle

__all__ = ["change_feed", "ITEM_STREAM_SCHEMA", "run_timeouts", "run_timeouts_stateful", "RUN_EVENT_SCHEMA", "first_wins_stream",
           "first_wins_ordered", "run_lifecycle", "final_runs"]
