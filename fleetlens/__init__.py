"""Whole-table fleet questions on Spark: presence, drift, references, permissions, trees, logs, telemetry."""

import sys

from pyspark import cloudpickle

from fleetlens.session import build_session, tune

# Executors may lack this package: its few Python functions travel with the tasks that call them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "tune"]
