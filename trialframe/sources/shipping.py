"""Makes the package importable on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    target = Path(tempfile.mkdtemp(prefix="trialframe-code-")) / "trialframe_code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in [*(_ROOT / "trialframe").rglob("*.py"), *_ROOT.glob("corpus_pipeline.py")]:
            z.write(p, p.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
