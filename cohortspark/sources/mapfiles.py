"""A data source of surface map files in folders sub-*/ses-*: a row for each map, read by the DataFrame reader.

    spark.dataSource.register(MapFiles)
    spark.read.format("mapfiles").load(folder).where("participant_id = 'sub-01' and hemi = 'L'")

Filters on what file names say (subject, session, hemisphere, feature, resolution, label) are pushed down: folders of other
subjects are not listed and other files not opened. A file that cannot be read is a row with an error. Files are opened by path, so
the folder must be one that all executors share; for stores that only Spark reads, see maps.read_surface_files.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from cohortspark.sources.maps import decode_surface_file

#: Column and the name part it is read from; the first two are folders too.
ENTITIES = {"participant_id": "sub", "session_id": "ses", "hemi": "hemi", "feature": "feature", "resolution": "surf", "label": "label"}
SCHEMA = ", ".join(f"{c} string" for c in ENTITIES) + ", path string, depth int, values array<double>, error string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def entities(path: str) -> dict[str, str | None]:
    """What a file's name says; subject and session carry their prefix, like their folders."""
    found = dict(re.findall(r"(?:^|_)([a-z]+)-([^_]+)", re.sub(r"(\.\w+)?\.gii(\.gz)?$", "", os.path.basename(path))))
    return {c: None if e not in found else f"{e}-{found[e]}" if e in ("sub", "ses") else found[e] for c, e in ENTITIES.items()}


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class MapFileReader(DataSourceReader):
    def __init__(self, root: str, per_task: int) -> None:
        self.root, self.per_task, self.wanted = root, per_task, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in ENTITIES:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted.setdefault(f.attribute[0], values)
                self.wanted[f.attribute[0]] &= values
            else:
                yield f

    def _folders(self, parent: str, prefix: str, column: str) -> Iterator[str]:
        """Folders below, by name alone; with a filter no other folder is looked at."""
        wanted = self.wanted.get(column)
        names = (e.name for e in os.scandir(parent) if e.name.startswith(prefix)) if wanted is None else wanted
        yield from (p for p in (os.path.join(parent, str(n)) for n in sorted(names)) if os.path.basename(p).startswith(prefix) and os.path.isdir(p))

    def partitions(self) -> list[Files]:
        found = []
        for subject in self._folders(self.root, "sub-", "participant_id"):
            for session in self._folders(subject, "ses-", "session_id"):
                for folder, _, names in os.walk(session):
                    for name in sorted(n for n in names if re.search(r"\.gii(\.gz)?$", n)):
                        of = entities(name)
                        if all(of[c] in values for c, values in self.wanted.items()):
                            found.append(os.path.join(folder, name))
        return [Files(tuple(found[i : i + self.per_task])) for i in range(0, len(found), self.per_task)] or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            names = tuple(entities(path).values())
            try:
                with open(path, "rb") as file:
                    arrays = [d for intent, d in decode_surface_file(file.read()) if intent not in ("NIFTI_INTENT_POINTSET", "NIFTI_INTENT_TRIANGLE")]
            except Exception as problem:  # noqa: BLE001  reported as a row
                yield (*names, path, None, None, f"{type(problem).__name__}: {problem}")
                continue
            for depth, values in enumerate(arrays):
                yield (*names, path, depth, values.astype(float).ravel().tolist(), None)


class MapFiles(DataSource):
    """Options: path, and filesPerTask (64)."""

    @classmethod
    def name(cls) -> str:
        return "mapfiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MapFileReader:  # noqa: ANN001
        return MapFileReader(self.options["path"], int(self.options.get("filesPerTask", 64)))


def read_maps(spark: SparkSession, path: str, files_per_task: int = 64) -> DataFrame:
    """The maps below a folder; turns the session's filter pushdown for Python sources on, which they need."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(MapFiles)
    return spark.read.format("mapfiles").option("filesPerTask", files_per_task).load(path)
