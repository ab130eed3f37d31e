"""Java sources of the package as jars of an application, compiled by the compiler that Spark brings along."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import SparkSession


def jar(spark: SparkSession, source: Path) -> str:
    """The jar of a source, in the driver's own folder of files, which ends with the application; executors get it from the driver."""
    path = Path(SparkFiles.getRootDirectory()) / "compiled" / f"{source.stem}.jar"
    if not path.exists():
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(source.read_text())
        path.parent.mkdir(exist_ok=True)
        unfinished = path.with_suffix(f".{os.getpid()}")
        with zipfile.ZipFile(unfinished, "w") as z:
            for name, code in compiler.getBytecodes().items():
                z.writestr(f"{name.replace('.', '/')}.class", bytes(code))
        unfinished.rename(path)
    return str(path)
