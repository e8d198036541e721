"""Publishing a set of tables as one version.

Tables go to a fresh folder ``versions/<id>``; then a manifest with their names, formats
and schemas is put beside the older ones under the next number, in one rename. Readers
take the manifest with the highest number, so a run that breaks off half-way leaves what
was published before as it was, and a reader never mixes two runs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, types as T

from .staging import Folder

MANIFESTS, VERSIONS = "manifests", "versions"


def publish(
    spark: SparkSession, folder: str, tables: Mapping[str, DataFrame], flat: Iterable[str] = (), single: Iterable[str] = ()
) -> dict[str, str]:
    """Write ``tables`` as the next version of ``folder``; returns their paths.

    Those in ``flat`` become CSV with a header, the others parquet; those in ``single``
    are small and become one file.
    """
    target = Folder(spark, folder)
    version = uuid.uuid4().hex
    entries = {}
    for name, df in tables.items():
        kind = "csv" if name in flat else "parquet"
        path = f"{VERSIONS}/{version}/{name}"
        out = df.coalesce(1) if name in single else df
        writer = out.write.option("header", True) if kind == "csv" else out.write
        writer.format(kind).save(f"{target.path}/{path}")
        entries[name] = {"path": path, "format": kind, "schema": json.loads(df.schema.json())}
    draft = f"{VERSIONS}/{version}/manifest.json"
    target.write_text(draft, json.dumps({"version": version, "tables": entries}))
    target.fs.mkdirs(target.at(MANIFESTS))
    number = _newest(target) + 1
    while not target.rename(draft, f"{MANIFESTS}/{number:012d}.json"):
        number += 1  # another run was first
    return {name: f"{target.path}/{e['path']}" for name, e in entries.items()}


def _newest(folder: Folder) -> int:
    numbers = [int(n.removesuffix(".json")) for n in folder.names(MANIFESTS) if n.endswith(".json") and n[0].isdigit()]
    return max(numbers, default=0)


def read_published(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the newest version, with the types they were written with."""
    source = Folder(spark, folder)
    newest = _newest(source)
    if not newest:
        raise FileNotFoundError(f"nothing is published in {folder}")
    manifest = json.loads(source.read_text(f"{MANIFESTS}/{newest:012d}.json"))
    return {
        name: spark.read.schema(T.StructType.fromJson(e["schema"])).option("header", True)
        .format(e["format"]).load(f"{source.path}/{e['path']}")
        for name, e in manifest["tables"].items()
    }


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Ids of the published versions, oldest first."""
    source = Folder(spark, folder)
    return [
        json.loads(source.read_text(f"{MANIFESTS}/{n}"))["version"]
        for n in source.names(MANIFESTS) if n.endswith(".json") and n[0].isdigit()
    ]


def drop_older(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Remove all but the newest ``keep`` versions, manifests first."""
    source = Folder(spark, folder)
    names = [n for n in source.names(MANIFESTS) if n.endswith(".json") and n[0].isdigit()]
    for name in names[: max(0, len(names) - max(1, keep))]:
        version = json.loads(source.read_text(f"{MANIFESTS}/{name}"))["version"]
        source.delete(f"{MANIFESTS}/{name}")
        source.delete(f"{VERSIONS}/{version}")
