"""Archives: the member source, resumable indexes, extraction that can't leave its target."""

import io
import json
import os
import tarfile
import zipfile

import pytest

from drovekit.sources import archives


def tar(path, items, mode="w:gz"):
    with tarfile.open(path, mode) as t:
        for name, data in items:
            i = tarfile.TarInfo(name)
            if data is None:
                i.type, i.linkname = tarfile.SYMTYPE, "/etc/passwd"
                t.addfile(i)
            else:
                i.size = len(data)
                t.addfile(i, io.BytesIO(data))


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    tar(d / "a1.tgz", [("s/x", b"one"), ("s/y", b"two" * 1000), ("s/l", None)])
    tar(d / "a2.tgz", [("s/y", b"other"), ("s/z", b"")])
    with zipfile.ZipFile(d / "a3.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(40):
            z.writestr(f"z/{k}", os.urandom(100))
        z.writestr("s/x", b"late")
    tar(d / "a4.tar", [("t/../../escape", b"bad"), ("t/w", b"w")], "w")
    (d / "note.txt").write_text("no archive")
    return d


def test_members(spark, folder):
    rows = archives.read(spark, f"file://{folder}", span=2000)
    assert rows.rdd.getNumPartitions() > 4  # a zip file's ranges
    got = sorted((os.path.basename(r.archive), r.member, r.kind, r.length) for r in rows.collect() if not r.member.startswith("z/"))
    assert got == [("a1.tgz", "s/l", "link", 0), ("a1.tgz", "s/x", "file", 3), ("a1.tgz", "s/y", "file", 3000), ("a2.tgz", "s/y", "file", 5), ("a2.tgz", "s/z", "file", 0), ("a3.zip", "s/x", "file", 4), ("a4.tar", "t/../../escape", "file", 3), ("a4.tar", "t/w", "file", 1)]
    assert sorted(r.member for r in rows.collect() if r.member.startswith("z/")) == sorted(f"z/{k}" for k in range(40))
    bodies = {(os.path.basename(r.archive), r.member): r.content for r in archives.read(spark, str(folder), bodies="^s/[xz]$").collect() if r.content is not None}
    assert {k: bytes(v) for k, v in bodies.items()} == {("a1.tgz", "s/x"): b"one", ("a2.tgz", "s/z"): b"", ("a3.zip", "s/x"): b"late"}
    (folder / "none").mkdir()
    assert archives.read(spark, str(folder / "none")).collect() == []


def test_objects_of_any_size():
    rows = [{"a": k, "t": "ü]},[" * (k % 7)} for k in range(300)] + [12345, "x", [1, [2]], None]
    text = json.dumps(rows, ensure_ascii=False, indent=1).encode()
    for chunk in (1, 7, 64, 1 << 20):
        assert [json.loads(x) for x in archives.objects(io.BytesIO(text), chunk)] == rows
    assert list(archives.objects(io.BytesIO(b" \n[ ]"), 1)) == []
    for bad in (b"{}", b"[1, 2", b"", b'[{"a": 1'):
        with pytest.raises(ValueError, match="list"):
            list(archives.objects(io.BytesIO(bad), 3))


def test_tables(spark, tmp_path):
    tar(tmp_path / "m.tgz", [("v/scene.json", json.dumps([{"t": k} for k in range(5000)]).encode()), ("v/log.json", b"[]"), ("v/deep/scene.json", b"[1]"), ("w/scene.json", b"[2]")])
    got = archives.tables(spark, str(tmp_path), "v", ["scene", "log"])
    assert got.count() == 5000 and {r.table for r in got.select("table").distinct().collect()} == {"scene"}
    with pytest.raises(ValueError, match="lacks"):
        archives.tables(spark, str(tmp_path), "v", ["scene", "sample"])


def required(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "member string")


def test_index_stops_and_goes_on(spark, folder, tmp_path):
    found, counts = archives.index(spark, str(folder), required(spark, "s/x", "s/y", "s/x"), str(tmp_path / "p"), wave=1)
    assert {(r.member, os.path.basename(r.archive)) for r in found.collect()} == {("s/x", "a1.tgz"), ("s/y", "a1.tgz")}
    assert (counts["archive_count_scanned"], counts["complete"], counts["missing_count"]) == (1, True, 0)  # stopped early
    good = (folder / "a2.tgz").read_bytes()
    (folder / "a2.tgz").write_bytes(good[:20])  # an archive that breaks off
    with pytest.raises(archives.Failed, match="a2"):
        archives.index(spark, str(folder), required(spark, "s/x", "s/z", "t/w"), str(tmp_path / "q"), wave=2)
    (folder / "a2.tgz").write_bytes(good)
    found, counts = archives.index(spark, str(folder), required(spark, "s/x", "s/z", "t/w", "nope"), str(tmp_path / "q"), wave=2)
    assert {(r.member, os.path.basename(r.archive)) for r in found.collect()} == {("s/x", "a1.tgz"), ("s/z", "a2.tgz"), ("t/w", "a4.tar")}
    assert (counts["archive_count_this_run"], counts["missing_count"], counts["complete"]) == (1, 1, True)  # only the one that failed


def test_extract(spark, folder, tmp_path):
    out, p = tmp_path / "out", str(tmp_path / "p")
    counts = archives.extract(spark, str(folder), str(out), required(spark, "s/x", "s/y", "s/z", "z/3"), p, wave=1)
    assert (out / "s/x").read_bytes() == b"one" and (out / "s/y").read_bytes() == b"two" * 1000 and (out / "s/z").read_bytes() == b""
    assert (counts["extracted_count"], counts["extracted_this_run"]) == (4, 4)
    assert sorted(x.name for x in (out / "s").iterdir()) == ["x", "y", "z"]  # nothing unfinished is left
    again = archives.extract(spark, str(folder), str(out), required(spark, "s/x", "s/y", "s/z", "z/3"), p)
    assert (again["extracted_count"], again["extracted_this_run"]) == (4, 0)
    for bad in ("t/../../escape", "s/l"):
        with pytest.raises(ValueError, match="unsafe"):
            archives.extract(spark, str(folder), str(tmp_path / "bad"), required(spark, "s/x", bad), str(tmp_path / f"p{len(bad)}"))
    assert not (tmp_path / "bad").exists() and not (tmp_path / "escape").exists()


def test_extract_goes_on_after_a_crash(spark, folder, tmp_path):
    out, p = tmp_path / "out", str(tmp_path / "p")
    (tmp_path / "out").mkdir()
    (tmp_path / "out/z").write_text("in the way")  # the third archive can't be unpacked
    with pytest.raises(Exception, match="z"):
        archives.extract(spark, str(folder), str(out), required(spark, "s/x", "s/z", "z/1"), p, wave=1)
    assert (out / "s/x").exists() and (out / "s/z").exists()
    (out / "s/x").write_bytes(b"kept")
    (out / "z").unlink()
    counts = archives.extract(spark, str(folder), str(out), required(spark, "s/x", "s/z", "z/1"), p, wave=1)
    assert counts["extracted_this_run"] == 1 and (out / "s/x").read_bytes() == b"kept" and (out / "z/1").exists()
