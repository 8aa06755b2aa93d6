from bytequarry.functions import strings
from bytequarry.operators import carve
from bytequarry.session import materialize
from bytequarry.sources import archives, files, signatures


def test_files_entries_and_sinks(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    packed = archives.create_zip(["dir/Read.ME", "other"], [b"some text to be read", b"x" * 500])
    (tmp_path / "in" / "a.ZIP").write_bytes(b"junk before " + packed)
    (tmp_path / "in" / "sub" / "b.txt").write_bytes(b"\0plain words\0")
    (tmp_path / "in" / "sub" / "c.zip").write_bytes(packed)
    rows = files.scan_directory(spark, f"file://{tmp_path}/in")
    assert {(r["path"].rsplit("/", 1)[1], r["ext"], r["size"]) for r in rows.collect()} == {("a.ZIP", ".zip", 12 + len(packed)), ("b.txt", ".txt", 13), ("c.zip", ".zip", len(packed))}
    assert files.scan_directory(spark, f"file://{tmp_path}/in", recursive=False).count() == 1 and files.scan_directory(spark, f"file://{tmp_path}/in", "*.txt", max_bytes=12).count() == 0
    assert [bytes(r["content"]) for r in files.entry_by_path(rows, "read.me").collect()] == [b"some text to be read"]
    files.write_strings(strings.text_strings(rows.where("ext = '.txt'"), encodings=("ascii",)), f"file://{tmp_path}/strings")
    assert "".join(p.read_text() for p in (tmp_path / "strings").glob("*.txt")) == "0x00000001 ascii    plain words\n"
    found = carve.carve(rows, signatures.signatures(spark))
    done = materialize(files.write_carved(found, rows, f"file://{tmp_path}/out", {"Zip": ".zip"}), "carved").collect()
    assert sorted(r["file"].split("/")[1] for r in done) == ["offset_0x00000000.zip", "offset_0x0000000C.zip"]
    assert all((tmp_path / "out" / r["file"]).read_bytes() == packed and r["bytes"] == len(packed) for r in done)
