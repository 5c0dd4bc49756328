"""framefold: ordered byte and signal streams to activity segments, as Spark plans."""

__version__ = "0.1.0"
