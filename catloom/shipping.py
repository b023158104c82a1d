"""Makes the package importable in Python workers, wherever the executors run."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile

from pyspark import cloudpickle
from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's modules to the executors once for an application."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="catloom-ship-"), "catloom.zip")
    with zipfile.ZipFile(out, "w") as z:
        for top, _, names in os.walk(home):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(top, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(home)))
    sc.addPyFile(out)
    _sent.add(sc.applicationId)


def by_value(name: str) -> None:
    """Send a module's classes and functions as they are, not by name.

    Spark also runs Python beside the driver, for planning sources and stateful
    operators, in processes that get neither the driver's path nor the shipped files.
    """
    cloudpickle.register_pickle_by_value(sys.modules[name])
