"""Worker code travels with the job, so executors need no copy of this package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_with_jobs(module_name: str) -> None:
    """Functions and classes of this module are pickled by value."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
