"""What a session needs to run functions of this package on executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Folder used where a local session names none; removed at exit.
_OWN: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; only a local session may go without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="weftline-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        base = f"file://{_OWN[0]}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors as a zip, once per application."""
    context = spark.sparkContext
    if getattr(context, "_weftline_sent", None) is None:
        folder = tempfile.mkdtemp(prefix="weftline-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = Path(__file__).parent
        with zipfile.ZipFile(f"{folder}/weftline.zip", "w") as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, file.relative_to(root.parent))
        context.addPyFile(f"{folder}/weftline.zip")
        context._weftline_sent = folder
