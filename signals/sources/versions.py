"""All tables of a load become visible together, or not at all.

Every load writes its rows into new folders and then publishes a manifest: a small file that lists, for each table, the folders that make it up.
The manifest is written under another name and renamed, so it is there as a whole or not; readers take the one with the highest number and look at
nothing else. A load that dies before the rename leaves the last version as it was; its folders are never read.

A version's number is claimed by the rename, which fails if another load has taken it meanwhile. On stores whose rename is not
atomic, one load may run at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, directory: str) -> list[int]:
    """Numbers of the published versions, ascending."""
    fs, p = _fs(spark, f"{directory}/_versions")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n) for n in names if n.isdigit())


def manifest(spark: SparkSession, directory: str, version: int | None = None) -> dict[str, list[str]]:
    """Table → folders of a version (None: the latest; no version: no tables)."""
    known = versions(spark, directory)
    if not known:
        return {}
    return json.loads(spark.read.text(f"{directory}/_versions/{known[-1] if version is None else version}", wholetext=True).first()[0])


def publish(spark: SparkSession, directory: str, folders: dict[str, list[str]], version: int) -> None:
    fs, target = _fs(spark, f"{directory}/_versions/{version}")
    _, draft = _fs(spark, f"{directory}/_versions/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(folders).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"version {version} of {directory} was published by another load")


def load(spark: SparkSession, directory: str, tables: dict[str, DataFrame], reset: bool = False) -> int:
    """Write the rows of several tables and publish them as one version; returns its number.

    With ``reset`` the tables consist of these rows alone, else they are appended; tables that are not named stay as they are.
    A table's first load fixes its columns; readers match later folders by name.
    """
    known = versions(spark, directory)
    folders = manifest(spark, directory)
    mark = uuid.uuid4().hex[:12]
    for name, df in tables.items():
        path = f"{directory}/{name}/load-{mark}"
        df.write.parquet(path)
        folders[name] = [path] if reset else [*folders.get(name, []), path]
    version = (known[-1] if known else 0) + 1
    publish(spark, directory, folders, version)
    return version


def read(spark: SparkSession, directory: str, name: str, version: int | None = None) -> DataFrame:
    """A table as of a version (None: the latest). A version that was replaced stays readable as long as its folders are kept."""
    folders = manifest(spark, directory, version).get(name)
    if not folders:
        raise ValueError(f"no published table {name} in {directory}")
    schema = spark.read.parquet(folders[0]).schema
    return spark.read.schema(schema).parquet(*folders)
