"""What must not grow with the number of files: listings on the driver, calls of folders."""

from flowspark import sources
from flowspark.sinks.storage import entries, moved, open_store


def _tree(folder):
    (folder / "day").mkdir(parents=True)
    (folder / "_hidden").mkdir()
    for path, content in {"a.json": b"one", "empty.json": b"", "b.csv": b"two", "day/c.json": b"three", "_hidden/d.json": b"no"}.items():
        (folder / path).write_bytes(content)


def test_files_are_listed_and_read_by_tasks(spark, tmp_path):
    _tree(tmp_path / "in")
    files, objects = sources.read_files(spark, str(tmp_path / "in")), sources.read_objects(spark, str(tmp_path / "in"), "*")
    assert files.inputFiles() == [] and objects.inputFiles() == []  # the driver has no listing
    found = {row.path.rsplit("/", 1)[1]: (row.length, bytes(row.content)) for row in files.collect()}
    assert found == {"a.json": (3, b"one"), "empty.json": (0, b""), "b.csv": (3, b"two")}
    assert {row.key: bytes(row.content) for row in objects.collect()} == {"a.json": b"one", "b.csv": b"two", "day/c.json": b"three"}
    assert "ArrowEvalPython" not in files.select("path")._jdf.queryExecution().executedPlan().toString()


def test_only_wanted_names_are_looked_at(tmp_path):
    _tree(tmp_path / "in")
    (tmp_path / "in" / "gone.json").symlink_to(tmp_path / "nowhere")
    assert sorted(name for name, _, _ in entries(str(tmp_path / "in"), lambda name: name != "a.json")) == ["b.csv", "empty.json"]
    assert {name for name, _, _ in entries(str(tmp_path / "in"), lambda name: True, lambda name: name == "day")} == {
        "a.json", "b.csv", "empty.json", "day/c.json"}


def test_files_move_to_new_folders_once(tmp_path):
    (tmp_path / "a").write_bytes(b"x")
    store, root = open_store(str(tmp_path))
    assert moved(store, f"{root}/a", f"{root}/new/deep/a") and not moved(store, f"{root}/a", f"{root}/other/a")
    assert (tmp_path / "new/deep/a").read_bytes() == b"x" and not (tmp_path / "other").exists()
