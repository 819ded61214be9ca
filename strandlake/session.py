"""Getting the package to the executors, and tables between jobs."""

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

HERE = Path(__file__).resolve().parent


def ship(spark):
    """Hands this package to the executors of a cluster where it isn't installed; once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_strandlake_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="strandlake-")) / "strandlake.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(HERE.rglob("*.py")):
            z.write(p, p.relative_to(HERE.parent))
    context.addPyFile(str(path))
    context._strandlake_shipped = True


def shared_dir(spark, name):
    """A new folder below spark.checkpoint.dir, which driver and executors share; a local session without that setting
    gets one of its own, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        base = f"file://{tempfile.mkdtemp(prefix='strandlake-')}"
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df, folder, name):
    """df written to the shared folder and read again: its lineage ends there."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")
