"""Sending functions to executors that do not have this package installed."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_by_value(module_name: str) -> None:
    """Serialise functions of the module with their code, not by import path."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
