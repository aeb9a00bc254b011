"""A folder's current state as numbered manifests: a version is written once, by whoever is first, and readers take the last."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

NAME = "manifest-{:012d}.json"


class Conflict(Exception):
    """Another writer has made this version first: read again and try anew."""


class Manifest:
    """Versions of a JSON object in a folder that all executors share. Nothing is ever overwritten, so that a reader's files stay
    as they were, and a version cannot be made twice."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._fs = path.rstrip("/"), spark._jvm.org.apache.hadoop.fs
        self._files = self._fs.Path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._jvm = spark._jvm

    def read(self, empty: dict) -> tuple[int, dict]:
        """(version, content) of the last complete version; (0, empty) if there is none."""
        found = self._files.globStatus(self._fs.Path(f"{self.path}/manifest-*.json")) or []
        for name in sorted((f.getPath().getName() for f in found), reverse=True):
            stream = self._files.open(self._fs.Path(f"{self.path}/{name}"))
            text = bytes(stream.readAllBytes()).decode()
            stream.close()
            try:
                return int(name[9:-5]), json.loads(text)
            except ValueError:  # still being written
                continue
        return 0, empty

    def commit(self, after: int, content: dict) -> int:
        """Make the version that follows `after`; Conflict if it is there already."""
        try:
            stream = self._files.create(self._fs.Path(f"{self.path}/{NAME.format(after + 1)}"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {after + 1} of {self.path} exists") from None
            raise
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        return after + 1

    def names(self) -> list[str]:
        """What lies in the folder, manifests and hidden files aside."""
        folder = self._fs.Path(self.path)
        found = [f.getPath().getName() for f in self._files.listStatus(folder)] if self._files.exists(folder) else []
        return [n for n in found if not n.startswith(("manifest-", ".", "_"))]

    def remove(self, name: str) -> None:
        """Delete a table of the folder, of which no manifest that is still read speaks."""
        self._files.delete(self._fs.Path(f"{self.path}/{name}"), True)
