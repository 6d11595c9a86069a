import json
import os
import time

import pytest

from lodestrata.operators import publication as P


class Failing(P.Store):
    """Fails at the given change."""

    def __init__(self, spark, root, at):
        super().__init__(spark, root)
        self.at, self.seen = at, 0

    def changing(self, what, name):
        self.seen += 1
        if self.seen == self.at:
            raise RuntimeError(f"no {what} of {name}")


def tree(root):
    """Names and contents, without checksums and lock."""
    out = {}
    for folder, _, names in os.walk(root):
        for n in names:
            if not n.endswith(".crc") and n != P.LOCK:
                with open(f"{folder}/{n}", "rb") as f:
                    out[os.path.relpath(f"{folder}/{n}", root)] = f.read()
    return out


def tables(spark, k):
    return {"lines": spark.range(k).withColumnRenamed("id", "n"), "more": spark.range(2)}


def test_revisions_follow_each_other(spark, tmp_path):
    store = P.Store(spark, f"file://{tmp_path}/out")
    with pytest.raises(ValueError, match="nothing"):
        P.current(store, "lines")
    assert [P.publish(store, {"made": k}, tables(spark, k + 1), confirmed=k == 1) for k in range(3)] == ["revision-000001", "revision-000002", "revision-000003"]
    assert P.current(store, "lines").count() == 3
    found = P.manifest(store)
    assert [(r["state"], r.get("superseded_by")) for r in found["revisions"]] == [("STALE", "revision-000002"), ("STALE", "revision-000003"), ("CURRENT", None)]
    assert [json.loads(store.read(P.status_of(r["revision"]))) for r in found["revisions"]] == found["revisions"]
    assert [r["review"] for r in found["revisions"]] == ["NEEDS_REVIEW", "CONFIRMED_AFTER_REVIEW", "NEEDS_REVIEW"]
    assert json.loads(store.read("revision-000002/workspace.json")) == {"made": 1} and not store.exists(P.LOCK)
    assert len({r["workspace_sha256"] for r in found["revisions"]}) == 3


def test_a_failure_at_any_step_leaves_the_old_state(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    store = P.Store(spark, root)
    P.publish(store, {}, tables(spark, 1))
    P.publish(store, {}, tables(spark, 2))
    before = tree(f"{tmp_path}/out")
    failed = 0
    for at in range(1, 50):
        broken = Failing(spark, root, at)
        try:
            P.publish(broken, {}, tables(spark, 3))
        except RuntimeError:
            failed += 1
            assert tree(f"{tmp_path}/out") == before and not store.exists(P.LOCK)
            continue
        break
    assert failed == broken.seen and failed >= 9  # lock, tables, both records, rename, both status files, manifest
    assert P.manifest(store)["current_revision"] == "revision-000003" and P.current(store, "lines").count() == 3


def test_a_dead_publisher_is_cleaned_up_after(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    store = P.Store(spark, root)
    P.publish(store, {}, tables(spark, 1))
    before = tree(f"{tmp_path}/out")
    # what a driver leaves that dies right before the manifest is replaced
    store.create(P.LOCK, b"x")
    store.save(f"{P.PENDING}1/lines", spark.range(3))
    store.save("revision-000002/lines", spark.range(3))
    store.replace(P.status_of("revision-000001"), b"{}")
    with pytest.raises(ValueError, match="lock"):
        P.publish(store, {}, tables(spark, 2))
    with pytest.raises(ValueError, match="lock"):
        P.recover(store)
    assert P.current(store, "lines").count() == 1  # readers never saw it
    time.sleep(0.05)
    assert P.recover(store, older_than=0.01) == [P.LOCK, f"{P.PENDING}1", "revision-000002"]
    assert tree(f"{tmp_path}/out") == before
    assert P.publish(store, {}, tables(spark, 2)) == "revision-000002"


def test_a_damaged_manifest_is_refused(spark, tmp_path):
    store = P.Store(spark, f"file://{tmp_path}/out")
    P.publish(store, {}, tables(spark, 1))
    good = json.loads(store.read(P.MANIFEST))
    for bad in (good | {"current_revision": "revision-000009"}, good | {"revisions": good["revisions"] * 2}, good | {"revisions": [good["revisions"][0] | {"state": "STALE"}]}):
        store.replace(P.MANIFEST, P.as_json(bad))
        with pytest.raises(ValueError, match="manifest"):
            P.publish(store, {}, tables(spark, 1))
    store.replace(P.MANIFEST, P.as_json(good))
    store.delete("revision-000001")
    with pytest.raises(ValueError, match="folders differ"):
        P.manifest(store)
