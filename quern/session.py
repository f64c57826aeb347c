"""A session with the settings this engine is written for."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(name: str = "quern", cores: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session, unless SPARK_MASTER or spark-submit names a cluster; AQE and Arrow are on, the time zone is UTC."""
    builder = SparkSession.builder.appName(name).config("spark.sql.shuffle.partitions", str(partitions))
    if "SPARK_MASTER" in os.environ:
        builder = builder.master(os.environ["SPARK_MASTER"])
    else:
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    fixed = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = builder.config(map=fixed | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once for each context; where it lies on the driver doesn't matter then."""
    sc = spark.sparkContext
    if getattr(sc, "_quern_shipped", False):
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quern-")) / "quern_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(home.rglob("*")):
            if p.is_file() and p.suffix in (".py", ".yaml", ".txt"):
                z.write(p, Path("quern") / p.relative_to(home))
    sc.addPyFile(str(archive))
    sc._quern_shipped = True
