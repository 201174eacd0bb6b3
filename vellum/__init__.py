"""Vellum: document-layout, edit and training-data analytics on PySpark."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path


def ship(spark) -> None:
    """Make this package importable in Python workers (once a session)."""
    sc = spark.sparkContext
    if getattr(sc, "_vellum_shipped", False):
        return
    here = Path(__file__).resolve().parent
    tmp = tempfile.mkdtemp()  # the driver serves the file from here as long as it runs
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    stage = Path(tmp, "stage")
    shutil.copytree(here, stage / here.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(Path(tmp, "vellum_package")), "zip", stage))
    sc._vellum_shipped = True
