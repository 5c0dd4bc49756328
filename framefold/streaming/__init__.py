"""Structured Streaming: the same frames, markers and segments with keyed state."""

import os
import sys
from pathlib import Path

if str(Path(__file__).resolve().parents[2]) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
    # Python workers may not find this package on their path: send its classes by value.
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
