"""Versions of a table behind one pointer: a reader sees a whole version, the old one or the new one, and never a part of either.

A version is a folder of Parquet files that is written once and never changed. A small file names the served version and those
before it; promotion writes a new one beside it and puts it in place with one rename, which file systems do as a whole (local ones,
HDFS). So a candidate that is refused, or a job that dies while it writes, leaves what is served alone, and a rollback is another
rename. Stores without an atomic rename need another pointer.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.quality import publishable

POINTER = "CURRENT"


class RefusedError(RuntimeError):
    """The candidate isn't served; what was served still is."""


@dataclass(frozen=True)
class Versions:
    """The versions below ``root``, a folder that all machines reach."""

    spark: SparkSession
    root: str

    def _path(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/{name}")

    def _fs(self):  # noqa: ANN202
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def history(self) -> list[str]:
        """The served version and those served before it, the latest first."""
        fs, at = self._fs(), self._path(POINTER)
        if not fs.exists(at):
            return []
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _point(self, versions: list[str]) -> None:
        jvm = self.spark._jvm
        fs, beside = self._fs(), self._path(f".{POINTER}-{uuid.uuid4().hex}")
        stream = fs.create(beside, True)
        stream.write(bytearray(json.dumps(versions).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(beside), fs.makeQualified(self._path(POINTER)), how)

    def served(self) -> DataFrame | None:
        """The served version, or None. The files read are those of the version named now, however long the reading takes."""
        names = self.history()
        return self.spark.read.parquet(f"{self.root.rstrip('/')}/versions/{names[0]}") if names else None

    def promote(self, candidate: DataFrame, version: str | None = None, least: float = 0.75, force: bool = False) -> str:
        """Writes ``candidate`` and serves it if the guard agrees: it isn't empty and has ``least`` of the served rows, unless
        ``force``. A version that was promoted before is not written again, so a run that is repeated changes nothing.

        The rows are counted where they were written, so the candidate is worked out once."""
        name = version or uuid.uuid4().hex
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", name):
            raise ValueError(f"{name!r} is no name of a version")
        before = self.history()
        if name in before:
            return name
        path = f"{self.root.rstrip('/')}/versions/{name}"
        candidate.write.mode("overwrite").parquet(path)  # what a run that died left under this name was never served
        written = self.spark.read.schema(candidate.schema).parquet(path)
        served = self.served()
        guard = publishable(written, served if served is not None else written, least).first()
        if guard["candidate_rows"] == 0 or not (guard["publish"] or force):
            self._fs().delete(self._path(f"versions/{name}"), True)
            raise RefusedError(f"{guard['candidate_rows']} rows against {guard['served_rows']} served")
        self._point([name, *before])
        return name

    def rollback(self, to: str | None = None) -> str:
        """Serves the version before the served one, or ``to``, which must have been served."""
        names = self.history()
        rest = names[1:] if to is None else names[names.index(to) :] if to in names else []
        if not rest:
            raise ValueError(f"nothing to go back to{'' if to is None else f': {to} was not served'}")
        self._point(rest)
        return rest[0]

    def prune(self, keep: int = 2) -> list[str]:
        """Deletes all versions but the served one and ``keep`` - 1 before it, and what runs that died left; returns their names.
        Readers of a deleted version fail, so ``keep`` covers as many promotions as a reader takes."""
        names = self.history()
        kept = names[: max(keep, 1)]
        fs, folder = self._fs(), self._path("versions")
        gone = [x.getPath().getName() for x in (fs.listStatus(folder) if fs.exists(folder) else []) if x.getPath().getName() not in kept]
        if len(kept) < len(names):
            self._point(kept)
        for name in gone:
            fs.delete(self._path(f"versions/{name}"), True)
        return sorted(gone)
