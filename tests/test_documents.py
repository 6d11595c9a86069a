"""Profiles, workspaces, revisions, records, rendering and coaching."""

import copy
import json

import pytest

from lodestrata.functions import values as X
from lodestrata.operators import coaching, profile as P, records, render, revisions, workspace as W

PROFILE = {
    "language": "en", "name": "Ada", "headline": "Engineer", "contacts": ["a@b.co"], "facts_confirmed": True,
    "sections": [{"id": "experience", "title": "Experience", "entries": [{"heading": "Acme", "date": "2019-2021", "bullets": ["Led 3 people", "Wrote *code*"]}]}, {"id": "skills", "title": "Skills", "entries": []}],
}


def altered(change, base=PROFILE):
    out = copy.deepcopy(base)
    change(out)
    return out


def test_visible_fields(spark):
    want = list(P.fields(PROFILE))
    assert [p for p, _ in want] == ["name", "headline", "contacts[0]", "sections[0].title", "sections[0].entries[0].heading", "sections[0].entries[0].date", "sections[0].entries[0].bullets[0]", "sections[0].entries[0].bullets[1]"]
    docs = spark.createDataFrame([(1, json.dumps(PROFILE))], "id int, profile string")
    rows = P.visible_fields(docs.select("id", P.as_struct("profile").alias("profile")))
    assert [(r.path, r.value) for r in rows.orderBy("ord").collect()] == want


BROKEN = [
    (lambda p: p.update(x=1), "x", "unknown field"), (lambda p: p.update(language="de"), "language", "must be zh or en"), (lambda p: p.update(name=" "), "name", "must be a non-empty string"),
    (lambda p: p.update(facts_confirmed=1), "facts_confirmed", "must be true or false"), (lambda p: p.update(contacts=[]), "contacts", "at least one contact"), (lambda p: p.update(role="pilot"), "role", "must be a known role"),
    (lambda p: p["sections"].append(p["sections"][0]), "sections[2].id", "duplicate section id"), (lambda p: p["sections"][0]["entries"][0]["bullets"].append(""), "sections[0].entries[0].bullets[2]", "must be a non-empty string"),
    (lambda p: p["sections"][0]["entries"].append({}), "sections[0].entries[1]", "must have a heading or bullets"), (lambda p: p.update(headline="TODO"), "headline", "unresolved placeholder"),
    (lambda p: p.update(headline="a\x01"), "headline", "unsupported control characters"), (lambda p: p.update(facts_confirmed=False), "facts_confirmed", "facts not confirmed"), (lambda p: p["sections"][1].update(title=None), "sections[1].title", "must be a non-empty string"),
]


@pytest.mark.parametrize(("change", "path", "rule"), BROKEN)
def test_one_change_one_breach(change, path, rule):
    assert P.breaches(PROFILE, draft=False) == []
    assert (path, rule) in P.breaches(altered(change), draft=False)


def test_drafts_and_tables(spark):
    draft = altered(lambda p: p.update(name="", contacts=[], facts_confirmed=False))
    assert P.breaches(draft, draft=True) == [] and P.breaches(None, True) and P.breaches({"sections": 3}, True)
    rows = spark.createDataFrame([(1, json.dumps(PROFILE)), (2, "{"), (3, json.dumps(draft)), (4, '{"a":1,"a":2}')], "id int, profile string")
    assert {r.id for r in P.validate(rows).collect()} == {2, 3, 4}
    assert P.skeleton("graduate", "zh")["sections"][0] == {"id": "education", "title": "教育背景", "entries": []}


def test_rendering(spark):
    assert render.as_text(PROFILE) == "Ada\nEngineer\na@b.co\n\nExperience\n\nAcme | 2019-2021\n- Led 3 people\n- Wrote *code*\n"
    md = render.as_text(PROFILE, markdown=True, draft=True)
    assert md.startswith("# Ada\nDRAFT") and "a@b\\.co" in md and "- Wrote \\*code\\*" in md
    assert render.tex_escape("50% of x_y at https://a.b/c") == r"50\% of x\_y at h\allowbreak{}t\allowbreak{}t\allowbreak{}p\allowbreak{}s\allowbreak{}:\allowbreak{}/\allowbreak{}/\allowbreak{}a\allowbreak{}.\allowbreak{}b\allowbreak{}/\allowbreak{}c"
    tex = render.as_tex(PROFILE)
    assert r"\datedsubsection{Acme}{2019-2021}" in tex and "skills" not in tex.lower()
    row = spark.createDataFrame([(json.dumps(PROFILE),)], "p string").select(render.rendered("p", "text").alias("t")).first()
    assert row.t == render.as_text(PROFILE)


def workspace():
    fact = lambda k, v, en: {"id": k, "source": "s", "status": "confirmed", "value": v, "expressions": {"en": en}}
    return {
        "schema_version": 1, "facts": [fact("team", 3, "{value} people"), fact("part", "lead", {"lead": "Led", "contributor": "Helped"})],
        "versions": [{"id": "v1", "resume": PROFILE, "bindings": [{"path": "sections[0].entries[0].bullets[0]", "template": "{who} {n}", "refs": {"who": "part", "n": "team"}}], "summary": [{"template": "{who} it", "refs": {"who": "part"}}], "basis": [{"requirement": "TODO", "template": "{n}", "refs": {"n": "team"}}]}],
    }


def compiled(spark, data, final=True):
    rows = [(k, json.dumps(w)) for k, w in enumerate(data)]
    return W.compile_workspaces(spark.createDataFrame(rows, "id int, workspace string"), final=final)


def test_workspace(spark):
    changed = altered(lambda w: (w["facts"][0].update(value=2), w["facts"][1].update(value="contributor")), workspace())
    done = compiled(spark, [workspace(), changed])
    assert done.breaches.collect() == []
    out, other = done.versions.orderBy("id").collect()
    assert json.loads(out.resume)["sections"][0]["entries"][0]["bullets"][0] == "Led 3 people" and out.summary == ["Led it"]
    assert out.basis[0].resume_paths == ["sections[0].entries[0].bullets[0]"] and out.basis[0].evidence == "3 people" and [f.fact_id for f in out.facts] == ["part", "team"]
    assert json.loads(other.resume)["sections"][0]["entries"][0]["bullets"][0] == "Helped 2 people"
    draft = compiled(spark, [workspace()], final=False).versions.first()
    assert json.loads(draft.resume)["facts_confirmed"] is False and draft.version_id == "v1"


WRONG = [
    (lambda w: w["facts"][0].update(value=True), "a string nor an integer"), (lambda w: w["facts"][0].update(status="maybe"), "confirmed nor pending"), (lambda w: w["facts"].append(w["facts"][0]), "the id team more than once"), (lambda w: w["facts"][1].update(value="boss"), "no expression"),
    (lambda w: w["versions"][0]["bindings"][0]["refs"].update(x="team"), "unused reference"), (lambda w: w["versions"][0]["bindings"][0]["refs"].update(n="none"), "unknown fact none"), (lambda w: w["versions"][0]["bindings"][0].update(path="nowhere"), "no visible field"),
    (lambda w: w["versions"][0]["bindings"].append(w["versions"][0]["bindings"][0]), "bound more than once"), (lambda w: w["facts"][0].update(status="pending"), "unconfirmed facts: team"), (lambda w: w["versions"][0]["summary"][0].update(template="{who} TODO"), "placeholder"),
    (lambda w: w["facts"][0]["expressions"].update(en="{value:d}"), "named tokens"), (lambda w: w.update(extra=1), "known field"), (lambda w: w["versions"][0]["resume"].update(language="zh"), "isn't expressed in zh"), (lambda w: w.pop("facts"), "is missing"), (lambda w: w["versions"][0].update(summary=[]), "list of 1 or more"),
]


def test_workspace_rules(spark):
    done = compiled(spark, [altered(change, workspace()) for change, _ in WRONG])
    found = {}
    for r in done.breaches.collect():
        found.setdefault(r.id, []).append(r.rule)
    for k, (_, said) in enumerate(WRONG):
        assert any(said in rule for rule in found[k]), (k, found[k])
    assert done.versions.count() == 0
    assert W.compile_workspaces(spark.createDataFrame([(1, "{"), (2, None)], "id int, workspace string")).breaches.count() == 2


def test_references_as_a_join(spark):
    bindings = spark.createDataFrame([("a", "{x} and {y}", {"x": "f1", "y": "f2"}), ("b", "{x}", {"x": "f9"}), ("c", "{x}", {"x": "f2"})], "id string, template string, refs map<string,string>")
    facts = spark.createDataFrame([("f1", "one", "confirmed"), ("f2", "two", "pending")], "fact_id string, expression string, status string")
    got = {r.id: (r.value, r.error, r.pending) for r in W.bind_references(bindings, facts).collect()}
    assert got == {"a": ("one and two", None, ["f2"]), "b": (None, "unknown fact id f9", []), "c": ("two", None, ["f2"])}
    basis = spark.createDataFrame([("k", ["f1", "f2"]), ("m", ["f3"])], "basis_id string, refs array<string>")
    paths = spark.createDataFrame([("p", ["f2", "f5"]), ("q", ["f1"]), ("r", ["f7"])], "path string, refs array<string>")
    assert [(r.basis_id, r.paths) for r in W.shared_fact_paths(basis, paths).collect()] == [("k", ["p", "q"])]


def test_templates():
    assert X.expand("{{{a}}} {b}", {"a": "1", "b": "2"}) == "{1} 2"
    for bad in ("{a", "}", "{A}", "{a.b}", "{a!r}", " "):
        with pytest.raises(ValueError):
            X.expand(bad, {"a": "1"})


def test_revisions(tmp_path):
    def write(text):
        def run(folder):
            with open(f"{folder}/v.txt", "w") as f:
                f.write(text)
            return ["v"]

        return run

    assert revisions.publish(str(tmp_path), {"a": 1}, write("one")) == "revision-000001"
    assert revisions.publish(str(tmp_path), {"a": 2}, write("two"), confirmed=True) == "revision-000002"
    found = revisions.manifest(tmp_path)
    assert [(r["state"], r["review"], r.get("superseded_by")) for r in found["revisions"]] == [("STALE", "NEEDS_REVIEW", "revision-000002"), ("CURRENT", "CONFIRMED_AFTER_REVIEW", None)]
    assert (tmp_path / "revision-000001/v.txt").read_text() == "one"
    before = {p: p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()}

    def fails(folder):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        revisions.publish(str(tmp_path), {}, fails)
    assert {p: p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()} == before
    (tmp_path / revisions.LOCK).touch()
    with pytest.raises(ValueError):
        revisions.publish(str(tmp_path), {}, write("x"))


def record():
    claim = lambda k: {"id": k, "text": "built it", "fact_ids": ["F1"]}
    names = list(records.V.RUBRIC.items())
    levels = [4, 3, 3, 3, 4, None]
    return {
        "execution": {"mode": "same_model_directed_simulation", "fictional": True, "independent_review": False, "real_jobseeker": False, "blind": False}, "limitations": ["x"], "status": "completed", "observations": ["x"],
        "turns": [{"number": n, "user": f"u{n} said", "assistant": "I say built it. Why? final built it text", "progress": "p", "questions": ["Why?"], "claims": [claim("c")]} for n in (1, 2, 3)],
        "facts": [{"id": "F1", "source_turn": 1, "source_quote": "u1", "status": "confirmed"}, {"id": "F2", "source_turn": 1, "source_quote": "said", "status": "superseded", "superseded_by": "F3"}, {"id": "F3", "source_turn": 2, "source_quote": "u2", "status": "confirmed", "supersedes": ["F2"]}],
        "targets": [{"id": "T", "source_turn": 1, "source_quote": "u1", "requirements": [{"id": "R"}]}],
        "deliverables": {
            "versions": [{"id": "V", "text": "final built it text", "target_id": "T", "claims": [claim("c1")]}], "remaining_risks": ["x"], "jd_mappings": [{"target_id": "T", "requirement_id": "R", "status": "supported", "fact_ids": ["F1"], "claim_ids": ["c1"]}],
            "assessments": [{"version_id": "V", "assessed_score": 76.25, "assessed_weight": 90, "dimensions": [{"name": n, "weight": w, "level": v, "evidence_claim_ids": ["c1"], "reason": "r"} for (n, w), v in zip(names, levels, strict=True)]}],
        },
    }


@pytest.mark.parametrize(
    ("change", "said"),
    [
        (lambda r: r["facts"][0].update(source_quote="never said"), "quotes what"), (lambda r: r["turns"][0]["claims"][0].update(fact_ids=["F3"]), "before it was said"), (lambda r: r["turns"][2]["claims"][0].update(fact_ids=["F2"]), "was corrected"), (lambda r: r["turns"][1].update(number=5), "count of turns"),
        (lambda r: r["facts"][2].update(source_turn=1, source_quote="u1"), "no later than"), (lambda r: r["facts"][1].update(superseded_by=None), "point back"), (lambda r: r["deliverables"].update(jd_mappings=[]), "each requirement once"), (lambda r: r["deliverables"]["assessments"][0].update(assessed_score=70), "sums the scores"),
        (lambda r: r["deliverables"]["assessments"][0]["dimensions"][5].update(level=0), "never rendered"), (lambda r: r["deliverables"]["versions"][0]["claims"][0].update(fact_ids=["F9"]), "unknown fact F9"), (lambda r: r.update(turns=3), "malformed"), (lambda r: r["execution"].update(blind=True), "leaves a boundary"), (lambda r: r["turns"][0].update(questions=["Why?"] * 4), "over 3 questions"),
    ],
)
def test_record_rules(change, said):
    assert records.breaches(record()) == []
    assert any(said in rule for _, rule in records.breaches(altered(change, record())))


def test_early_use_of_a_later_corrected_fact_is_fine():
    assert records.breaches(altered(lambda r: r["turns"][0]["claims"][0].update(fact_ids=["F2"]), record())) == []


def test_records_as_a_table(spark):
    rows = spark.createDataFrame([(1, json.dumps(record())), (2, "[]"), (3, "{"), (4, json.dumps(altered(lambda r: r.update(status="open"), record())))], "id int, record string")
    assert {r.id for r in records.check_records(rows).collect()} == {2, 3, 4}


def test_coaching(spark):
    cols = "doc_id int, section_id string, section int, entry int, bullet int, heading string, date string, text string"
    rows = [(1, "experience", 0, 0, 0, "Acme", "2020", "Helped with SQL reports"), (1, "experience", 0, 0, 1, "Acme", "2020", "Led 3 users to code"), (1, "projects-2", 1, 0, 0, "", "", "No SQL; wrote API tests"), (1, "skills", 2, 0, 0, "", "", "Figma"), (2, "skills", 0, 0, 0, "", "", "SQL")]
    bullets = spark.createDataFrame(rows, cols)
    claims = spark.createDataFrame([(1, "claim-000001", ["sections[0].entries[0].bullets[0]"]), (1, "claim-000002", ["sections[0].entries[0].bullets[1]"]), (1, "claim-000003", ["sections[1].entries[0].bullets[0]"])], "doc_id int, claim_id string, resume_paths array<string>")
    reports = spark.createDataFrame([(1, None, None, None, False), (2, "data", None, None, True), (3, "data", None, None, False)], "doc_id int, role string, requested_target string, target string, doubtful boolean")
    got = [(r.doc_id, r["rank"], r.kind, r.fact_ids) for r in coaching.improvements(bullets, claims, reports).orderBy("doc_id", "rank").collect()]
    assert got == [(1, 1, "result_scope", ["claim-000002"]), (1, 2, "personal_action", ["claim-000002"]), (1, 3, "target", []), (2, 1, "source_review", []), (3, 1, "content", [])]
    told = coaching.stories(bullets, claims).orderBy("rank").collect()
    assert [(s.heading, s.quotes, s.fact_ids) for s in told] == [("Acme", ["Helped with SQL reports", "Led 3 users to code"], ["claim-000001", "claim-000002"]), ("", ["No SQL; wrote API tests"], ["claim-000003"])]
    roles = [(r.doc_id, r.role) for r in coaching.directions(bullets, claims, reports).orderBy("doc_id", "rank").collect()]
    assert roles == [(1, "software"), (1, "data"), (1, "product")]
    shown = {r.doc_id: r.markdown for r in render.review_markdown(coaching.improvements(bullets, claims, reports), coaching.stories(bullets, claims), coaching.directions(bullets, claims, reports)).collect()}
    assert set(shown) == {1, 2, 3}
    assert "> Led 3 users to code" in shown[1] and "### Acme" in shown[1] and "Sources: claim-000002" in shown[1] and "No clue was found." in shown[3]
