"""Where tables of the library's own are written."""

from __future__ import annotations

import tempfile
from functools import cache
from uuid import uuid4

from pyspark.sql import SparkSession


@cache
def _own() -> str:
    return tempfile.mkdtemp(prefix="spoolmill-")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the session names in ``spark.checkpoint.dir``; a folder of our own is only taken
    where the setting is absent and Spark runs in this process alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{named or _own()}/{name}-{uuid4().hex}"
