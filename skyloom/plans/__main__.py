"""``python -m skyloom.plans MANIFEST.csv FOLDER OUT``: hourly results of each line not yet processed, and the lines' status.

Recordings are ``FOLDER/HDF/<day>/<camera>/<stem>.parquet``, as ``sources.sinks.write_recording`` makes them."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from skyloom.plans import batch
from skyloom.sources import camera


def main(sheet: str, folder: str, out: str) -> None:
    spark = SparkSession.builder.appName("skyloom").getOrCreate()
    batch.run(camera.manifest(spark, sheet), camera.recordings(spark, folder), out).show(truncate=False)


if __name__ == "__main__":
    main(*sys.argv[1:4])
