"""Archives read by member, folders listed by tasks, and what cannot be read."""

import io
import os
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from repoatlas.sources import archives, listing, scan
from tests.helpers import matches

TREE = {f"d{i % 3}/.f{i}": (b"x%d\n" % i) * (i * 40) for i in range(60)} | {"empty": b"", "__main__.py": b"\xff\xc3\xa9"}


def tar_bytes(tree=TREE, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as archive:
        folder = tarfile.TarInfo("a folder")
        folder.type = tarfile.DIRTYPE
        archive.addfile(folder)
        for path, data in tree.items():
            member = tarfile.TarInfo("./" + path)
            member.size = len(data)
            archive.addfile(member, io.BytesIO(data))
    return out.getvalue()


def zip_bytes(tree=TREE, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as archive:
        archive.writestr("a folder/", b"")
        for path, data in tree.items():
            archive.writestr(path, data)
    return out.getvalue()


def scanned(spark, folder, **kwargs):
    rows = scan.scan_repos(spark, str(folder), "archive", errors="rows", **kwargs).collect()
    good = {(r.repo, r.path, r.size, r.content) for r in rows if r.error is None}
    assert len(good) == sum(r.error is None for r in rows)
    return good, sorted((r.repo, r.path, r.size, r.error) for r in rows if r.error is not None)


def expected(repo, tree, limit=10**9):
    text = lambda data: data.decode(errors="ignore") if len(data) <= limit else None
    return {(repo, path, len(data), text(data)) for path, data in tree.items()}


FORMS = {
    "a.tar": tar_bytes(), "b.tar.gz": tar_bytes(mode="w:gz"), "c.tgz": tar_bytes(mode="w:gz"),
    "d.tar.bz2": tar_bytes(mode="w:bz2"), "e.tar.xz": tar_bytes(mode="w:xz"), "f.zip": zip_bytes(),
    "g.zip": zip_bytes(method=zipfile.ZIP_STORED), "h.ZIP": zip_bytes(method=zipfile.ZIP_BZIP2), "i.tar": tar_bytes({}),
    "j.zip": zip_bytes({}),
}


def test_every_form_gives_every_file(spark, tmp_path):
    for name, data in FORMS.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "notes.txt").write_text("no archive")
    good, bad = scanned(spark, tmp_path, max_size=2000)
    assert bad == [] and good == {x for repo in "abcdefgh" for x in expected(repo, TREE, 2000)}
    one, _ = scanned(spark, tmp_path / "a.tar")
    assert one == expected("a", TREE)
    some, _ = scanned(spark, tmp_path / "{b,f}.*")
    assert some == expected("b", TREE) | expected("f", TREE)


def test_one_archive_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "MEMBERS", 4)
    monkeypatch.setattr(archives, "RANGE", 3000)
    (tmp_path / "a.tar").write_bytes(tar_bytes())
    (tmp_path / "f.zip").write_bytes(zip_bytes())
    files = scan.scan_repos(spark, str(tmp_path), "archive").withColumn("task", F.spark_partition_id())
    rows = files.select("repo", "path", "size", "content", "task").collect()
    assert {tuple(r)[:4] for r in rows} == expected("a", TREE) | expected("f", TREE)
    for repo in "af":
        assert len({r.task for r in rows if r.repo == repo}) >= 8


def test_groups_of_neighbours_are_read_together():
    rows = [{"archive": "a", "kind": "tar", "start": s, "stored": n} for s, n in [(0, 10), (20, 10), (200_000, 5), (200_010, 5 << 20), (6 << 20, 1)]]
    groups = list(archives._groups([*rows, {"archive": "b", "kind": "tar", "start": 0, "stored": 1}]))
    assert [len(g) for g in groups] == [2, 1, 1, 1, 1]


@pytest.mark.parametrize("share", [0.02, 0.3, 0.7, 0.999])
def test_a_truncated_archive_gives_what_comes_before(spark, tmp_path, share):
    cut = {}
    for name in ("a.tar", "b.tar.gz", "f.zip", "g.zip"):
        data = FORMS[name]
        cut[name] = int(len(data) * share)
        (tmp_path / name).write_bytes(data[: cut[name]])
    good, bad = scanned(spark, tmp_path)
    assert [(r[0], r[1], r[2]) for r in bad] == [(n[0], n, cut[n]) for n in sorted(cut)] or share == 0.999
    assert all("truncated" in r[3] for r in bad)
    for repo in "abfg":
        mine = {x for x in good if x[0] == repo}
        assert mine <= expected(repo, TREE)
    ends, at = {}, 512
    for path, data in TREE.items():
        at += 512 + len(data)
        ends[path] = at
        at += -len(data) % 512
    assert {p for r, p, _, _ in good if r == "a"} == {p for p, end in ends.items() if end <= cut["a.tar"]}
    at = len("a folder/") + 30
    for path, data in TREE.items():
        at += 30 + len(path) + len(data)
        assert (("g", path, len(data), data.decode(errors="ignore")) in good) == (at <= cut["g.zip"])


def test_damage_is_told_by_member(spark, tmp_path):
    tree = {"a": b"1" * 100, "b": b"2" * 100, "c": b"3" * 100}
    stored = bytearray(zip_bytes(tree, zipfile.ZIP_STORED))
    stored[stored.index(b"2" * 100) + 50] ^= 1
    (tmp_path / "sum.zip").write_bytes(stored)
    locked = bytearray(zip_bytes(tree, zipfile.ZIP_STORED))
    at = locked.index(b"PK\x01\x02", locked.index(b"PK\x01\x02") + 4)  # the directory entry of "a"
    struct.pack_into("<H", locked, at + 8, 1)
    (tmp_path / "locked.zip").write_bytes(locked)
    strange = bytearray(zip_bytes(tree, zipfile.ZIP_STORED))
    struct.pack_into("<H", strange, at + 10, 99)
    (tmp_path / "strange.zip").write_bytes(strange)
    (tmp_path / "text.tar").write_bytes(b"this is no archive" * 100)
    (tmp_path / "none.zip").write_bytes(b"")
    (tmp_path / "text.tar.gz").write_bytes(b"nor is this")
    good, bad = scanned(spark, tmp_path)
    text = {p: d.decode() for p, d in tree.items()}
    assert good == {("sum", p, 100, text[p]) for p in "ac"} | {(r, p, 100, text[p]) for r in ("locked", "strange") for p in "bc"}
    assert [(r[0], r[1]) for r in bad] == [
        ("locked", "a"), ("none", "none.zip"), ("strange", "a"), ("sum", "b"), ("text", "text.tar"), ("text", "text.tar.gz")]
    told = {r[1]: r[3] for r in bad if r[1] in "ab"}
    assert told["b"] == "damaged member" and {r[3] for r in bad if r[1] == "a"} == {"encrypted member", "compression method 99"}
    skipped = scan.scan_repos(spark, str(tmp_path), "archive", errors="skip")
    assert skipped.columns == ["repo", "path", "size", "content"] and skipped.count() == len(good)
    with pytest.raises(Exception, match="cannot read: sum: b: damaged member|cannot read: "):
        scan.scan_repos(spark, str(tmp_path), "archive").collect()
    info = scan.file_info(scan.scan_repos(spark, str(tmp_path), "archive", errors="rows"))
    rows = info.filter("error IS NOT NULL").collect()
    assert len(rows) == 6 and all(r.size is None and r.content is None and r.language is None and r.is_config is None for r in rows)


def make_tree(folder, tree):
    for path, data in tree.items():
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_bytes(data)


def test_hidden_names_are_listed(spark, tmp_path):
    tree = {"one/.eslintrc": b"{}", "one/__main__.py": b"x", "one/.github/a b.yml": b"y", "two/_x/.y/z": b"\xff1", "top.txt": b"t"}
    make_tree(tmp_path, tree)
    want = {("one", ".eslintrc", "{}"), ("one", "__main__.py", "x"), ("one", ".github/a b.yml", "y"), ("two", "_x/.y/z", "1")}
    assert matches(scan.scan_repos(spark, str(tmp_path), "directory"), "repo", "path", "content") == want
    assert matches(scan.scan_repos(spark, str(tmp_path), "directory", listing="spark"), "repo", "path") == set()
    assert matches(scan.scan_repos(spark, f"{tmp_path}/[o]*", "directory"), "repo", "path", "content") == {w for w in want if w[0] == "one"}
    both = scan.scan_repos(spark, [f"{tmp_path}/one", str(tmp_path)], "directory")
    assert ("one", "__main__.py") in matches(both, "repo", "path") and (".github", "a b.yml") in matches(both, "repo", "path")


@pytest.mark.parametrize("entries", [0, 3, 1000])
def test_folders_are_left_to_other_tasks(spark, tmp_path, entries):
    tree = {f"r{i % 4}/" + "/".join("abc"[: i % 4]) + f"/f{i}": b"x" * i for i in range(50)}
    make_tree(tmp_path, tree)
    os.symlink(tmp_path, tmp_path / "r0" / "loop")
    (tmp_path / "r1" / "nothing").mkdir()
    found = listing.list_files(spark, [str(tmp_path)], entries)
    assert matches(found, "inside", "size", "error") == {(os.path.normpath(p), len(d), None) for p, d in tree.items()}


def test_what_cannot_be_listed_or_read_is_a_row(spark, tmp_path):
    make_tree(tmp_path, {"r/a": b"1", "r/b": b"2", "r/c": b"3"})
    rows = scan.scan_repos(spark, [str(tmp_path), str(tmp_path / "missing")], "directory", errors="rows").collect()
    assert {(r.repo, r.path, r.content) for r in rows if r.error is None} == {("r", "a", "1"), ("r", "b", "2"), ("r", "c", "3")}
    assert len([r for r in rows if r.error]) == 1 and "cannot be listed" in [r.error for r in rows if r.error][0]
    listed = listing.list_files(spark, [str(tmp_path)]).cache()
    listed.count()
    (tmp_path / "r" / "b").unlink()
    read = {r.inside: (r.raw and bytes(r.raw), r.error) for r in listing.read_files(listed, 10).collect()}
    assert read["r/a"] == (b"1", None) and read["r/b"][0] is None and "cannot be read" in read["r/b"][1]
    with pytest.raises(ValueError):
        scan.scan_repos(spark, str(tmp_path), "directory", errors="no")


def test_patterns_of_segments():
    import re

    hits = {"*": "a.b", "a?c": "abc", "[ab]x": "bx", "[^a]x": "bx", "{one,t*}": "two", r"\*": "*", "a.b": "a.b", "[": "["}
    assert all(re.fullmatch(listing.segment_pattern(p), name) for p, name in hits.items())
    misses = {"a?c": "ac", "[ab]x": "cx", "[^a]x": "ax", "{one,t*}": "on", r"\*": "a", "a.b": "axb"}
    assert not any(re.fullmatch(listing.segment_pattern(p), name) for p, name in misses.items())
    assert listing.split_root("/a/b*/c") == ("/a", ["b*", "c"]) and listing.split_root("*") == (".", ["*"])
    assert listing.split_root("s3a://x/y") == ("s3a://x/y", [])
    with pytest.raises(ValueError):
        listing.segment_pattern("{a")


def test_writing_an_archive_keeps_no_members():
    from repoatlas.catalog import stored

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w|") as archive:
        for path, data in TREE.items():
            stored._add(archive, path, data)
            assert archive.members == []
    with tarfile.open(fileobj=io.BytesIO(out.getvalue())) as archive:
        assert {m.name: archive.extractfile(m).read() for m in archive} == TREE


def test_halves_are_copied_in_parts():
    from repoatlas.catalog import stored

    class Whole(io.BytesIO):
        sizes = []

        def read(self, size=-1):
            self.sizes.append(size)
            return super().read(size)

    data = bytes(range(256)) * 20_000
    for size in (0, 1, 3 * stored.COPY, len(data), len(data) + 9):
        part = io.BytesIO()
        stored._copy(Whole(data), part, size)
        assert part.getvalue() == data[:size]
    assert 0 <= min(Whole.sizes) and max(Whole.sizes) <= stored.COPY
