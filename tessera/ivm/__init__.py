"""Incremental view maintenance over weighted rows."""

from .flow import CycleLimitExceeded, IncrementalDataFrame, IncrementalFlow, PartitionedFlow, RecursiveView
from .zset import WEIGHT, ZSet

__all__ = ["WEIGHT", "CycleLimitExceeded", "IncrementalDataFrame", "IncrementalFlow", "PartitionedFlow", "RecursiveView", "ZSet"]
