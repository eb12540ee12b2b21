"""The manifest: numbered JSON states of a table; the highest complete number is the table.

A state is written beside its place and renamed into it without overwriting, so a commit is seen whole
or not at all and the second of two writers fails. Hadoop's file systems do the work, whatever the store.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession

from tidelog.errors import Conflict, Corruption

FIRST = {
    "version": 0, "next_segment": 1, "segments": [], "released": [], "snapshots": [], "lineage": [], "checkpoint": None,
    "streams": {}, "counters": {"flush": 0, "gc": 0, "savepoint": 0, "prune": 0},
}


class Manifest:
    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.folder = f"{path.rstrip('/')}/_manifest"
        self._fs = self._path(self.folder).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def exists(self) -> bool:
        return self._fs.exists(self._path(self.folder)) and bool(self.numbers())

    def numbers(self) -> list[int]:
        found = (re.fullmatch(r"(\d{12})\.json", s.getPath().getName()) for s in self._fs.listStatus(self._path(self.folder)))
        return sorted(int(m[1]) for m in found if m)

    def _read(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def load(self) -> tuple[int, dict]:
        """The newest state that can be read, and its number; a torn newest file is passed over."""
        for number in reversed(self.numbers()):
            try:
                return number, self._read(number)
            except ValueError:
                continue
        raise Corruption(f"{self.folder} has no readable state")

    def commit(self, number: int, state: dict) -> int:
        """Make state the successor of number; raises Conflict if it has one already."""
        if number >= 0 and self.numbers()[-1:] != [number]:
            raise Conflict(f"state {number} isn't the newest")
        target, temporary = (self._path(f"{self.folder}/{name}") for name in (f"{number + 1:012d}.json", f".{number + 1:012d}.{uuid.uuid4().hex}.tmp"))
        stream = self._fs.create(temporary, True)
        stream.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else self._fs.getUri(), self._conf)
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self._jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
        options[0] = none
        try:
            context.rename(temporary, target, options)
        except Exception as error:
            self._fs.delete(temporary, False)
            if self._fs.exists(target):
                raise Conflict(f"state {number + 1} was committed by another writer") from error
            raise
        return number + 1

    def put(self, name: str, value: dict) -> None:
        """Store a small JSON file beside the states, replacing one of this name."""
        stream = self._fs.create(self._path(f"{self.folder}/{name}"), True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()

    def files(self, prefix: str) -> dict[str, tuple[float, dict]]:
        """The files that put() stored under names with this prefix: (seconds since the epoch, value); one that goes meanwhile is left out."""
        out = {}
        for s in self._fs.listStatus(self._path(self.folder)):
            name = s.getPath().getName()
            if name.startswith(prefix):
                try:
                    stream = self._fs.open(s.getPath())
                    out[name] = s.getModificationTime() / 1000, json.loads(bytes(stream.readAllBytes()).decode() or "{}")
                    stream.close()
                except Exception:
                    if self._fs.exists(s.getPath()):
                        raise
        return out

    def forget(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/{name}"), False)

    def compact(self, keep: int = 1) -> None:
        """Remove all states but the newest ``keep``."""
        for number in self.numbers()[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/{number:012d}.json"), False)

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def children(self, path: str) -> list[str]:
        place = self._path(path)
        return [s.getPath().getName() for s in self._fs.listStatus(place)] if self._fs.exists(place) else []
