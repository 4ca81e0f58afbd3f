from lensframe.plans.workspace import Workspace, document_source, find_document, projects


def test_folds_of_a_journal(spark):
    w = Workspace(spark)
    w.record_profile("name", "a")
    w.record_profile("name", "b")
    assert [tuple(r) for r in w.profile().collect()] == [("name", "b")]
    assert w.add_finding("odd", "low pressure", "events") and not w.add_finding("warn", "low pressure")
    key = w.findings().first()["key"]
    assert w.finding_page(key).first()["severity"] == "info"
    w.resolve_finding(key)
    w.resolve_finding(key)
    assert tuple(w.finding_counts().first()) == (0, 1) and w.findings().first()["text"] == "low pressure"
    w.plan(["Check the pump", "Read the log"])
    assert w.work("read") and not w.work("read") and not w.done("nothing like it")
    assert [r["text"] for r in w.ordered_agenda().collect()] == ["Read the log", "Check the pump"]
    assert w.done("read") and w.agenda_head().first()["text"] == "Check the pump"
    task = w.find_task("pump")
    for kind, subject in (("failed", "x"), ("failed", "x"), ("built", "x"), ("note", "Check the pump"), ("note", "other")):
        w.act(kind, subject, "", task)
    assert [(r["kind"], r["subject"], r["tries"]) for r in w.task_story(task).collect()] == [("built", "x", 3), ("note", "other", 1)]
    assert w.activity().count() == 4 and w.recent_steps().count() == 3
    for t in ("a", "b", "a", "c"):
        w.star(t)
        w.open(t)
    assert {r["key"] for r in w.stars().collect()} == {"b", "c"} and [r["key"] for r in w.recents().collect()] == ["c", "a", "b"]
    w.say("me", "hello")
    again = Workspace(spark, w.journal)
    assert again._next == w._next
    seen = again.perception()
    assert seen["talk"].count() == 1 and seen["findings"].count() == 0 and seen["agenda"].count() == 1
    other = Workspace(spark)
    assert other.merge(w.journal.where("seq <> 3"), "w", 0).count() == 3


def test_documents_and_projects(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "journal.jsonl").write_text("")
    (tmp_path / "p" / "note.txt").write_text("One sentence. " * 200)
    pages, chunks = document_source(spark, str(tmp_path / "p" / "note.txt"))
    assert pages.count() == 1 and chunks.count() >= 3
    assert find_document("note.txt", [str(tmp_path)]) == str(tmp_path / "p" / "note.txt") and find_document("../note.txt", [str(tmp_path)]) is None
    assert [r[0] for r in projects(spark, str(tmp_path)).collect()] == ["p"]
