import io
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from repoatlas.functions import content as fc
from repoatlas.sources import scan, sinks
from tests.helpers import make_files, matches

TREE = {
    "README.md": b"# hi\r\n",
    "src/a b.py": b"x = '\xff\xc3\xa9'\n",
    ".eslintrc": b"{}",
    "__main__.py": b"",
    "big.txt": b"0" * 150,
}


def write_archives(folder):
    with tarfile.open(folder / "one.tar.gz", "w:gz") as archive:
        for path, data in TREE.items():
            info = tarfile.TarInfo("./" + path)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    with zipfile.ZipFile(folder / "two.zip", "w") as archive:
        for path, data in TREE.items():
            archive.writestr(path, data)


def test_archives_show_every_name(spark, tmp_path):
    write_archives(tmp_path)
    files = scan.scan_repos(spark, str(tmp_path), "archive", max_size=100)
    texts = {"README.md": "# hi\n", "src/a b.py": "x = 'é'\n", ".eslintrc": "{}", "__main__.py": "", "big.txt": None}
    assert matches(files, "repo", "path", "size", "content") == {
        (repo, path, len(TREE[path]), text) for repo in ("one", "two") for path, text in texts.items()
    }


def test_directory(spark, tmp_path):
    for repo in ("one", "two"):
        for path, data in TREE.items():
            target = tmp_path / repo / path
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(data)
    files = scan.scan_repos(spark, str(tmp_path), "directory", max_size=100, listing="spark")
    # names with a leading dot or underscore are left out by Spark's file listing
    assert matches(files, "repo", "path", "size", "content") == {
        (repo, path, len(TREE[path]), text)
        for repo in ("one", "two")
        for path, text in {"README.md": "# hi\n", "src/a b.py": "x = 'é'\n", "big.txt": None}.items()
    }


@pytest.mark.parametrize("spelling", ["{0}", "{0}/", "file:{0}", "file://{0}", "{0}/*", "{1}//c", "./c", "{1}/[c]/one"])
def test_directory_root_spellings(spark, tmp_path, spelling):
    for path in ("one/a.txt", "one/b/c.txt", "one/c/c.txt"):
        target = tmp_path / "c" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("x")
    root = spelling.format(tmp_path / "c", tmp_path)
    if root == "./c":
        system = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
        here = system.getWorkingDirectory().toUri().getPath()
        root = "./" + os.path.relpath(tmp_path / "c", here)
    files = scan.scan_repos(spark, root, "directory")
    repo, before = ("c", "one/") if "[c]" in spelling else ("one", "")
    assert matches(files, "repo", "path") == {(repo, before + p) for p in ("a.txt", "b/c.txt", "c/c.txt")}


def test_parquet_table(spark, tmp_path):
    make_files(spark, {"r": {"a": "x", "b/c": "y"}}).write.parquet(str(tmp_path / "t"))
    files = scan.scan_repos(spark, str(tmp_path / "t"))
    assert matches(files, "repo", "path", "content") == {("r", "a", "x"), ("r", "b/c", "y")}
    with pytest.raises(ValueError):
        scan.scan_repos(spark, "x", "csv")


def test_size_gate(spark):
    files = spark.createDataFrame(
        [("r", "in", 102400, b"a\rb"), ("r", "out", 102401, b"c")], scan.RAW_SCHEMA
    ).withColumnRenamed("raw", "content")
    assert matches(scan.read_text(files), "path", "content") == {("in", "a\nb")}
    assert matches(scan.read_text(files, keep_missing=True), "path", "content") == {
        ("in", "a\nb"), ("out", None),
    }
    assert matches(scan.file_info(files), "path", "is_config", "language") == {
        ("in", False, "Unknown"), ("out", False, "Unknown"),
    }


def test_find(spark):
    files = make_files(spark, {"r": {"a/Foo.java": "", "target/Foo.java": "", "FooBar": "", "Foo/b": ""}})
    assert matches(scan.find_by_extension(files, [".java"]), "path") == {("a/Foo.java",)}
    assert matches(scan.find_by_pattern(files, "Foo", []), "path") == {
        ("a/Foo.java",), ("target/Foo.java",), ("FooBar",),
    }


def test_step_templates(spark):
    names = ["02-b.md", "01-a.md", "03-c.SKIP.md", "00-z.md", "1-x.md", "04-d.txt", "x/05-e.md"]
    files = make_files(spark, {"r": dict.fromkeys(names, "t")})
    assert [(r.step, r.name) for r in scan.scan_step_templates(files).collect()] == [
        (1, "a"), (2, "b"), (5, "e"),
    ]


def test_step_outputs_round_trip(spark, tmp_path):
    path = str(tmp_path / "outputs")
    rows = [("a", 1, "x <!-- keep -->"), ("a", 4, "y <!-- why -->"), ("b", 4, "z")]
    outputs = spark.createDataFrame(rows, "repo string, step int, output string")
    sinks.write_step_outputs(outputs, path)
    sinks.write_step_outputs(spark.createDataFrame([("a", 1, "new")], outputs.schema), path)
    assert matches(spark.read.parquet(path), "repo", "step", "output", "reasoning") == {
        ("a", 1, "new", None), ("a", 4, "y", "why"), ("b", 4, "z", ""),
    }
    assert matches(scan.scan_step_outputs(outputs, 4), "repo", "step") == {("a", 1)}


def test_profile_without_content(spark, tmp_path):
    df = spark.createDataFrame(
        [("r", [("p", "secret", 1)], {"README.md": "secret"})],
        "repo string, files array<struct<path: string, content: string, score: int>>, "
        "readme_contents map<string, string>",
    )
    sinks.write_profile(df, str(tmp_path / "p"))
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "p")).collect())
    assert "secret" not in text and '"path":"p"' in text


def test_readmes_and_contexts(spark, tmp_path):
    final = spark.createDataFrame([("r", "# T")], "repo string, readme string")
    sinks.write_readmes(final, str(tmp_path / "r"), "m", "2024-01-31")
    assert spark.read.parquet(str(tmp_path / "r")).first().readme.endswith("2024-01-31 | Model: m")
    rows = spark.createDataFrame([("r", 1)], "repo string, step int").withColumn("day", F.current_date())
    sinks.write_contexts(rows, str(tmp_path / "c"))
    assert dict(spark.read.json(str(tmp_path / "c")).dtypes)["day"] == "string"


def test_decode_keeps_text(spark):
    df = spark.createDataFrame([(b"caf\xc3\xa9 \xe2\x82",)], "raw binary")
    assert df.select(fc.decode_text(F.col("raw"))).first()[0] == "café "


def test_tables_become_visible_together(spark, tmp_path):
    path = str(tmp_path / "saved")
    with pytest.raises(FileNotFoundError):
        sinks.read_tables(spark, path)
    first = {"a": spark.range(3), "b": spark.createDataFrame([("x", [1])], "s string, n array<int>")}
    sinks.write_tables(first, path)
    before = sinks.read_tables(spark, path)
    broken = spark.range(1).select(F.raise_error(F.lit("stop")).alias("x"))
    with pytest.raises(Exception, match="stop"):
        sinks.write_tables({"a": spark.range(9), "b": broken}, path)
    again = sinks.read_tables(spark, path)
    assert again["a"].count() == 3 and again["b"].schema == first["b"].schema
    sinks.write_tables({"a": spark.range(5)}, path)
    assert list(sinks.read_tables(spark, path)) == ["a"] and sinks.read_tables(spark, path)["a"].count() == 5
    assert before["a"].count() == 3


def test_profile_is_saved_with_its_lists(spark, tmp_path):
    profile = spark.createDataFrame([("r", {"README.md": "secret"})], "repo string, readme_contents map<string, string>")
    lists = spark.createDataFrame([("r", "java", "java_files", "A.java", "1")], "repo string, analyzer string, list string, path string, ord string")
    sinks.write_saved_profile(profile, lists, str(tmp_path / "p"), facts=spark.range(1))
    saved = sinks.read_tables(spark, str(tmp_path / "p"))
    assert saved["profile"].columns == ["repo"] and matches(saved["lists"], "repo", "list", "path") == {("r", "java_files", "A.java")}
    assert saved["facts"].count() == 1


def test_a_run_deletes_its_tables(spark):
    from repoatlas.plans import job
    from repoatlas.sources.stores import open_store

    run = job.start_run(make_files(spark, {"r": {"build.gradle": "", "README.md": "# hello there, reader"}}))
    assert job.picked_contents(run).count() > 0
    store, path = open_store(run.folder)
    assert store.get_file_info(path).is_file is False and store.get_file_info(path).type.name == "Directory"
    run.close()
    assert store.get_file_info(path).type.name == "NotFound"
