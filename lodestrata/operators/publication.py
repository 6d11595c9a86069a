"""Published revisions on a shared file system, by way of Hadoop's: HDFS, object stores, local folders.

A revision's tables are written by the executors into a staged folder, which is renamed when complete and never changed
after. The manifest, replaced as a whole and last, says which revision is current; readers follow it only, so they see the old state or the new one. A lock
file keeps two publishers apart. Whatever fails on the way, the old state is put back; if the driver dies, ``recover`` does that later.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .workspace import digest

MANIFEST, LOCK, PENDING = "manifest.json", ".lock", ".pending-"
LAST = 999_999
EMPTY = {"schema_version": 1, "current_revision": None, "revisions": []}


class Store:
    """Files under a root folder. Every change goes through ``changing``, where tests let it fail."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.hadoop = jvm.org.apache.hadoop.fs
        self.fs = self.path("").getFileSystem(self.conf)
        self.io = jvm.org.apache.commons.io.IOUtils

    def path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def changing(self, what: str, name: str) -> None:
        """Called before each change."""

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path("")))

    def age(self, name: str) -> float:
        return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def read(self, name: str) -> bytes | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.io.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, content: bytes) -> None:
        """A new file; an error if it is there."""
        self.changing("create", name)
        self._write(self.path(name), content)

    def _write(self, path, content: bytes) -> None:
        out = self.fs.create(path, False)
        try:
            out.write(content)
        finally:
            out.close()

    def replace(self, name: str, content: bytes) -> None:
        """All of the new content or all of the old."""
        self.changing("replace", name)
        fresh = self.path(f".new-{uuid.uuid4().hex}")
        try:
            self._write(fresh, content)
            self._rename_over(fresh, self.path(name))
        finally:
            self.fs.delete(fresh, False)

    def _rename_over(self, source, target) -> None:
        context = self.hadoop.FileContext.getFileContext(self.fs.getUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(self.hadoop.Options.Rename, 1)
        options[0] = self.hadoop.Options.Rename.OVERWRITE
        context.rename(self.fs.makeQualified(source), self.fs.makeQualified(target), options)

    def rename(self, name: str, target: str) -> None:
        self.changing("rename", name)
        if self.exists(target) or not self.fs.rename(self.path(name), self.path(target)):
            raise OSError(f"{name} can't become {target}")

    def save(self, name: str, table: DataFrame) -> None:
        self.changing("save", name)
        table.write.parquet(f"{self.root}/{name}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def as_json(value) -> bytes:
    return (json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode()


def status_of(revision: str) -> str:
    return f"{revision}.status.json"


@contextlib.contextmanager
def locked(store: Store) -> Iterator[None]:
    store.fs.mkdirs(store.path(""))
    if store.exists(LOCK):
        raise ValueError("another publisher holds the lock")
    try:
        store.create(LOCK, uuid.uuid4().bytes)
    except Exception as error:
        if "exists" in str(error):
            raise ValueError("another publisher holds the lock") from None
        raise
    try:
        yield
    finally:
        store.delete(LOCK)


def manifest(store: Store) -> dict:
    """The checked manifest: revisions gapless from 1, the newest one current, all their folders there."""
    content = store.read(MANIFEST)
    if content is None:
        return dict(EMPTY)
    found = json.loads(content)
    names = [r["revision"] for r in found["revisions"]]
    states = [r["state"] for r in found["revisions"]]
    if names != [f"revision-{k + 1:06d}" for k in range(len(names))] or states != ["STALE"] * (len(names) - 1) + ["CURRENT"] * bool(names):
        raise ValueError("the manifest's revisions are out of order")
    if found["current_revision"] != (names[-1] if names else None) or not all(store.exists(n) for n in names):
        raise ValueError("the manifest and the folders differ")
    return found


def publish(store: Store, source: dict, tables: dict[str, DataFrame], confirmed: bool = False) -> str:
    """Publishes tables made from ``source`` as a new revision, which becomes the current one; returns its name.

    Older revisions become stale: their status files say what superseded them; their folders stay as they are. Any failure leaves
    the old state, but for the error.
    """
    with locked(store):
        before = manifest(store)
        number = len(before["revisions"]) + 1
        if number > LAST:
            raise ValueError("no revision numbers are left")
        name, staged = f"revision-{number:06d}", f"{PENDING}{uuid.uuid4().hex}"
        if store.exists(name):
            raise ValueError(f"{name} is there but not in the manifest; recover first")
        old = {status_of(r["revision"]): store.read(status_of(r["revision"])) for r in before["revisions"]}
        entry = {"revision": name, "state": "CURRENT", "workspace_sha256": digest(source), "versions": sorted(tables), "review": "CONFIRMED_AFTER_REVIEW" if confirmed else "NEEDS_REVIEW"}
        try:
            for version, table in tables.items():
                store.save(f"{staged}/{version}", table)
            store.create(f"{staged}/workspace.json", as_json(source))
            store.create(f"{staged}/revision.json", as_json(entry))
            store.rename(staged, name)
            store.replace(status_of(name), as_json(entry))
            stale = [r | {"state": "STALE", "superseded_by": r.get("superseded_by", name)} for r in before["revisions"]]
            for r in stale[-1:]:  # the others have been stale before
                store.replace(status_of(r["revision"]), as_json(r))
            store.replace(MANIFEST, as_json(before | {"current_revision": name, "revisions": [*stale, entry]}))
        except BaseException as error:
            try:
                for file, content in old.items():
                    if content is not None and store.read(file) != content:
                        store.delete(file)
                        store._write(store.path(file), content)
                for left in (status_of(name), staged, name):
                    store.delete(left)
            except Exception as second:
                raise ValueError(f"the old state could not be put back, recover before the next publication: {second}") from error
            raise
    return name


def recover(store: Store, older_than: float = 3600.0) -> list[str]:
    """Puts the state that the manifest names back in order after a publisher has died; returns what went.

    A lock younger than ``older_than`` seconds is taken for a living publisher's, and nothing is done.
    """
    if store.exists(LOCK) and store.age(LOCK) < older_than:
        raise ValueError("another publisher holds the lock")
    known = manifest(store)
    keep = {MANIFEST} | {n for r in known["revisions"] for n in (r["revision"], status_of(r["revision"]))}
    gone = [n for n in store.names() if n not in keep and (n == LOCK or n.startswith((PENDING, ".new-", "revision-")))]
    for n in gone:
        store.delete(n)
    for r in known["revisions"]:
        if store.read(status_of(r["revision"])) != as_json(r):
            store.replace(status_of(r["revision"]), as_json(r))
    return gone


def current(store: Store, version: str) -> DataFrame:
    """A table of the current revision."""
    name = manifest(store)["current_revision"]
    if name is None:
        raise ValueError("nothing is published")
    return store.spark.read.parquet(f"{store.root}/{name}/{version}")
