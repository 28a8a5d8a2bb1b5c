"""Make the package importable on executors that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package along with the session's tasks, once, unless workers find it by PYTHONPATH or working folder."""
    on_path = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    context = spark.sparkContext
    if str(ROOT) in on_path or Path.cwd() == ROOT or context.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((ROOT / "lodestone").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
