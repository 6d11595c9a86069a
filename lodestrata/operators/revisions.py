"""Revisions of published results: written once, never changed; only a status file beside them follows.

A revision is staged under a name of its own and renamed when complete; the
manifest is replaced last. A lock file keeps two publishers apart. All of it is
small metadata on the driver; tables go to the revision's folder by Spark.
"""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

from .workspace import digest

MANIFEST, LOCK = "manifest.json", ".lock"
LAST = 999_999


def replace_file(path: Path, content: bytes) -> None:
    """All of the new content or all of the old; links and special files are refused."""
    if path.is_symlink() or (path.exists() and not path.is_file()):
        raise ValueError(f"{path.name} is not a regular file")
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=".new-")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(content)
        os.replace(name, path)
    finally:
        Path(name).unlink(missing_ok=True)


def write_json(path: Path, value) -> None:
    replace_file(path, (json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode())


@contextlib.contextmanager
def locked(root: Path) -> Iterator[None]:
    try:
        os.close(os.open(root / LOCK, os.O_CREAT | os.O_EXCL))
    except FileExistsError:
        raise ValueError("another publisher holds the lock") from None
    try:
        yield
    finally:
        (root / LOCK).unlink()


def manifest(root: Path) -> dict:
    """The checked manifest: revisions gapless from 1, one of them current, the newest."""
    if not (root / MANIFEST).exists():
        return {"schema_version": 1, "current_revision": None, "revisions": []}
    found = json.loads((root / MANIFEST).read_text())
    names = [r["revision"] for r in found["revisions"]]
    states = [r["state"] for r in found["revisions"]]
    if names != [f"revision-{k + 1:06d}" for k in range(len(names))] or states != ["STALE"] * (len(names) - 1) + ["CURRENT"] * bool(names):
        raise ValueError("the manifest's revisions are out of order")
    if found["current_revision"] != (names[-1] if names else None) or any(not (root / n).is_dir() for n in names):
        raise ValueError("the manifest and the folders differ")
    return found


def publish(root: str, source: dict, write: Callable[[str], list[str]], confirmed: bool = False) -> str:
    """Publishes what ``write`` puts into the folder it is given; returns the revision. Any failure leaves the old state.

    ``source`` is what the revision was made from; its digest is recorded. ``write``
    returns the names of the versions it wrote.
    """
    home = Path(root)
    home.mkdir(parents=True, exist_ok=True)
    with locked(home):
        before = manifest(home)
        number = len(before["revisions"]) + 1
        if number > LAST:
            raise ValueError("no revision numbers are left")
        name = f"revision-{number:06d}"
        staged = Path(tempfile.mkdtemp(prefix=".pending-", dir=home))
        status = {r["revision"]: (home / f"{r['revision']}.status.json") for r in before["revisions"]}
        kept = {p: p.read_bytes() for p in status.values()}
        try:
            versions = write(str(staged))
            os.replace(staged, home / name)
            entry = {"revision": name, "state": "CURRENT", "workspace_sha256": digest(source), "versions": versions, "review": "CONFIRMED_AFTER_REVIEW" if confirmed else "NEEDS_REVIEW"}
            write_json(home / f"{name}.status.json", entry)
            for old, path in status.items():
                write_json(path, json.loads(kept[path]) | {"state": "STALE", "superseded_by": name, "revision": old})
            revisions = [r | {"state": "STALE", "superseded_by": name} for r in before["revisions"]]
            write_json(home / MANIFEST, before | {"current_revision": name, "revisions": [*revisions, entry]})
        except BaseException:
            for path, content in kept.items():
                replace_file(path, content)
            (home / f"{name}.status.json").unlink(missing_ok=True)
            shutil.rmtree(staged, ignore_errors=True)
            if not any(r["revision"] == name for r in before["revisions"]):
                shutil.rmtree(home / name, ignore_errors=True)
            raise
    return name
