"""Index, search and session analytics over source trees and text corpora, planned by Spark."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile


def ship(spark) -> None:
    """Send this package to the executors, where it is not installed there."""
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quarry-")  # the driver serves the archive for as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "quarry.zip")
    with zipfile.ZipFile(path, "w") as z:
        for base, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(path)
