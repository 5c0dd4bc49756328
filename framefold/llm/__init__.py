"""Operations of a training-data pipeline. Nothing else in the library imports this package."""

import os
import sys
from pathlib import Path

_ROOT = str(Path(__file__).resolve().parents[2])
if _ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
    # Python workers may not find this package on their path: send its functions by value.
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
