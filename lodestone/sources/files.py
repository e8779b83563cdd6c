"""Listing files on whatever file system a path belongs to."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _located(spark: SparkSession, path: str):
    located = spark._jvm.org.apache.hadoop.fs.Path(path)
    return located.getFileSystem(spark._jsc.hadoopConfiguration()), located


def glob_paths(spark: SparkSession, pattern: str) -> list[str]:
    fs, located = _located(spark, pattern)
    return [status.getPath().toString() for status in fs.globStatus(located) or []]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path``, which may be a glob, names anything."""
    return len(glob_paths(spark, path)) > 0


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, located = _located(spark, path)
    fs.delete(located, True)


def create_new(spark: SparkSession, path: str) -> bool:
    """Create an empty file that isn't there yet; of several writers one succeeds."""
    fs, located = _located(spark, path)
    fs.mkdirs(located.getParent())
    try:
        return bool(fs.createNewFile(located))
    except Py4JJavaError as problem:
        if "FileAlreadyExistsException" in str(problem.java_exception):
            return False
        raise


def folder_names(spark: SparkSession, path: str) -> list[str]:
    fs, located = _located(spark, path)
    if not fs.exists(located):
        return []
    return [status.getPath().getName() for status in fs.listStatus(located)]
