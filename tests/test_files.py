"""Listings see all files under their own names, open no excluded folder, and values open the files asked for alone."""

import os

from rillspark.sources.files import Files


def made(root, names):
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text(f"text of {n}")


NAMES = ["_posts.md", ".env", "_drafts/x.md", ".hid/y.md", "a%20b.md", "100%.md", "plain.md", "a+b.md", "deep/er/est/z.md", "sp ace/é.md", "br[a]ck*et?.md", "deep/q.txt"]


def test_every_name_is_listed_and_read_as_it_is(spark, tmp_path):
    root = tmp_path / "r"
    made(root, NAMES)
    (root / "empty").mkdir()
    source = Files(str(root))
    assert sorted(r.filename for r in source.listing(spark).collect()) == sorted(NAMES)
    assert {r.filename: r.content for r in source.read(spark).collect()} == {n: f"text of {n}" for n in NAMES}
    asked = spark.createDataFrame([("100%.md",), ("_drafts/x.md",), ("gone.md",), ("deep",)], "filename string")
    assert sorted(r.filename for r in source.values(spark, asked).collect()) == ["100%.md", "_drafts/x.md"]
    stamps = {r.filename: r._ordinal for r in Files("file://" + str(root)).listing(spark).collect()}
    assert stamps["plain.md"] == os.stat(root / "plain.md").st_mtime_ns // 1000


def test_excluded_folders_are_not_opened(spark, tmp_path):
    root = tmp_path / "r"
    made(root, ["in/a.md", "node_modules/x/b.md", "in/node_modules/c.md", "in/d.txt", "big.md"])
    (root / "big.md").write_text("x" * 999)
    shut = root / "node_modules"
    source = Files(str(root), included_patterns=["*.md"], excluded_patterns=["**/node_modules"], max_file_size=500)
    assert [r.filename for r in source.listing(spark).collect()] == ["in/a.md"]
    ok = source.exists()
    assert not ok("node_modules", True, 0) and not ok("node_modules/x/b.md", False, 1) and ok("in", True, 0) and not ok("big.md", False, 999)
    os.chmod(shut, 0)
    assert [r.filename for r in source.listing(spark).collect()] == ["in/a.md"]
    os.chmod(shut, 0o755)
    at = os.stat(shut).st_atime_ns
    os.utime(shut, ns=(1, os.stat(shut).st_mtime_ns))  # a folder that is read gets a new time of access
    source.listing(spark).collect()
    assert os.stat(shut).st_atime_ns == 1 and at and source.values(spark, spark.createDataFrame([("node_modules/x/b.md",), ("big.md",)], "filename string")).count() == 0


def test_links_are_followed_and_loops_end(spark, tmp_path):
    root, other = tmp_path / "r", tmp_path / "other"
    made(root, ["a.md", "sub/b.md"])
    made(other, ["c.md", "d/e.md"])
    os.symlink(other, root / "linked")
    os.symlink(other / "c.md", root / "one.md")
    os.symlink(root, root / "sub" / "up")
    os.symlink(tmp_path / "nowhere", root / "broken.md")
    got = {r.filename: r.content for r in Files(str(root)).read(spark).collect()}
    assert got == {"a.md": "text of a.md", "sub/b.md": "text of sub/b.md", "linked/c.md": "text of c.md", "linked/d/e.md": "text of d/e.md", "one.md": "text of c.md"}


def test_no_files(spark, tmp_path):
    assert Files(str(tmp_path / "none")).listing(spark).collect() == []
    (tmp_path / "empty").mkdir()
    assert Files(str(tmp_path / "empty")).read(spark).collect() == []


def test_digests_hold_a_block_at_a_time(spark, tmp_path, monkeypatch):
    import hashlib

    root = tmp_path / "r"
    made(root, NAMES)
    (root / "large").write_bytes(bytes(range(256)) * 20_000)
    monkeypatch.setattr("rillspark.sources.files.BLOCK", 1000)
    got = {r.filename: (r["size"], r.digest) for r in Files(str(root), binary=True).digests(spark).collect()}
    held = {n: (root / n).read_bytes() for n in [*NAMES, "large"]}
    assert got == {n: (len(x), hashlib.md5(x).hexdigest()) for n, x in held.items()}
    assert {r.filename: bytes(r.content) for r in Files(str(root), binary=True).read(spark).collect()} == held
