"""Folders of a store, through the file system that Spark uses for their path."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below a path; none if it is not there."""
    system, place = _file_system(spark, path)
    if not system.exists(place):
        return []
    return sorted(item.getPath().getName() for item in system.listStatus(place) if item.isDirectory())


def remove(spark: SparkSession, path: str) -> None:
    system, place = _file_system(spark, path)
    system.delete(place, True)
