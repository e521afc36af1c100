"""Near-real-time card fraud scoring on Spark DataFrames, Structured Streaming and MLlib."""

from cardwarden.config import EngineConfig

__all__ = ["EngineConfig"]
