"""Makes the package importable on executors, whatever folder or path the driver was started with."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship_code(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per context."""
    context = spark.sparkContext
    if getattr(context, "_quantloom_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="quantloom-code-")) / "quantloom_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, f"quantloom/{p.relative_to(_PACKAGE)}")
    context.addPyFile(str(target))
    context._quantloom_shipped = True
