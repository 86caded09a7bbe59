import gzip
import hashlib
import io
import os
import tarfile
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import markup, paths
from lodestrata.operators import expand, extract, ingest
from lodestrata.sources import files, lines


def zipped(**members) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, data in members.items():
            z.writestr(n.replace("__", "/"), data)
    return out.getvalue()


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "sub").mkdir(parents=True)
    page = b"<html><head><title>A &amp; B</title><style>x{}</style></head><body>Hello<script>1</script> <b>you</b></body></html>"
    mail = b"From: a@b.test\r\nSubject: Offer\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nDear all\r\n"
    office = io.BytesIO()
    with zipfile.ZipFile(office, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:r><w:t>One</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p><w:t>Three</w:t></w:p></w:document>')
    for name, data in {
        "a.txt": b"same text", "sub/copy.txt": b"same text", "empty.txt": b"", ".hidden": b"dot file", "_under": b"under", "noext": b"no extension", "UP.TXT": b"upper",
        "sp ace é.txt": b"blank", "big.bin": b"x" * 101, "edge.bin": b"y" * 100, "done": b"", "path.txt": b"x", "page.html": page, "mail.eml": mail, "doc.docx": office.getvalue(), "fake.pdf": b"%PDF-1.4",
        "broken.docx": b"PK\x03\x04 broken",
    }.items():
        (root / name).write_bytes(data)
        os.utime(root / name, (1_700_000_000.9, 1_700_000_000.9))
    return str(root)


def test_tree_has_dot_files_and_no_control_files(spark, tree):
    names = {os.path.relpath(r.path, tree) for r in files.file_tree(spark, tree).collect()}
    assert {".hidden", "_under", "sp ace é.txt", "sub/copy.txt"} <= names and not {"done", "path.txt"} & names


def test_hash_whatever_the_size(spark, tree):
    got = {os.path.basename(r.path): r for r in files.hashed(files.file_tree(spark, tree)).collect()}
    assert got["big.bin"].sha256 == hashlib.sha256(b"x" * 101).hexdigest() and got["big.bin"].error is None
    gone = spark.createDataFrame([("/nowhere/x", 0, 1)], "path string, mtime long, length long")
    row = files.hashed(gone).first()
    assert row.sha256 is None and row.error


def test_ingest_and_repeat(spark, tree, tmp_path):
    docs = ingest.documents(spark, tree, most=2000)
    got = {os.path.basename(r.filename): r for r in docs.collect()}
    assert "copy.txt" not in got and got["a.txt"].attachment.content == "same text"
    assert got["a.txt"].mtime == 1_700_000_000
    assert got["page.html"].attachment.content == "Hello you" and got["page.html"].attachment.title == "A & B"
    assert got["mail.eml"].attachment.content == "Dear all" and got["mail.eml"].attachment.title == "Offer"
    assert got["doc.docx"].attachment.content == "One two\nThree"
    assert got["fake.pdf"].message == "unsupported" and got["broken.docx"].message.startswith("error")
    assert got["empty.txt"].attachment.content == "" and got["empty.txt"].message == "ok"
    where = str(tmp_path / "docs")
    assert ingest.append(docs, where) == len(got)
    assert ingest.append(ingest.documents(spark, tree, most=2000), where) == 0
    assert ingest.documents(spark, tree, known=spark.read.parquet(where)).count() == 0


def test_size_gate_is_strict(spark, tree):
    got = {os.path.basename(r.filename): r.message for r in ingest.documents(spark, tree, most=100).collect()}
    assert got["big.bin"] == "too large" and got["edge.bin"] != "too large"
    scan = files.binary_scan(spark, tree, 100, "*.bin")
    assert {os.path.basename(r.path): r.content is None for r in scan.collect()} == {"big.bin": True, "edge.bin": False}
    assert "LessThanOrEqual(length,100)" in scan._jdf.queryExecution().executedPlan().toString()


def test_relocate_and_provenance(spark, tree, tmp_path):
    found = files.hashed(files.file_tree(spark, tree)).where("sha256 IS NOT NULL")
    first = ingest.provenance(found)
    assert first.count() == found.select("sha256").distinct().count()
    one = first.select("sha256", F.col("original_filename").alias("path"))
    done = ingest.relocate(one, str(tmp_path / "out")).collect()
    assert all(r.copied for r in done) and all(os.path.exists(r.target) for r in done)
    assert not any(r.copied for r in ingest.relocate(one, str(tmp_path / "out")).collect())
    assert ingest.provenance(found, first).count() == 0


def test_archives_within_archives(spark):
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        info = tarfile.TarInfo("deep.txt")
        info.size = 4
        t.addfile(info, io.BytesIO(b"deep"))
    data = zipped(**{"in.txt": b"one", "inner.zip": zipped(x=b"two"), "inner.tgz": tar.getvalue(), "..__..__out.txt": b"bad", "one.txt.gz": gzip.compress(b"three")})
    got = {p: (d, c, o) for p, d, c, o in expand.expand("nest.zip", data)}
    assert got["in.txt"] == (1, b"one", "ok") and got["inner.zip/x"] == (2, b"two", "ok") and got["inner.tgz/deep.txt"][1] == b"deep"
    assert got["../../out.txt"][2] == "outside" and any(c == b"three" for _, c, _ in got.values())
    small = {p: o for p, _, _, o in expand.expand("b.zip", zipped(bomb=b"0" * 10_000), expand.Bounds(member=100))}
    assert small == {"bomb": "too large"}
    assert [o for *_, o in expand.expand("nest.zip", zipped(**{"i.zip": zipped(x=b"1")}), expand.Bounds(depth=1))] == ["too deep"]
    assert [o for *_, o in expand.expand("bad.zip", data[:50])][0].startswith("error")
    rows = spark.createDataFrame([("a/nest.zip", bytearray(data)), ("b/none.bin", None)], "path string, content binary")
    assert expand.expanded(rows).where("outcome = 'ok'").count() == 4


def test_sniff(spark):
    rows = [(b"%PDF-1", "application/pdf"), (b"", "inode/x-empty"), (b"<!DOCTYPE html><p>", "text/html"), (b"PK\x03\x04", "application/zip"), (b"plain", "text/plain"), (b"From: x", "message/rfc822"), (b'{"a": 1}', "application/json")]
    df = spark.createDataFrame([(bytearray(a), b) for a, b in rows], "c binary, want string")
    assert all(r[0] == r[1] for r in df.select(markup.sniff(F.col("c")), "want").collect())
    assert extract.decode(b"caf\xe9") == "café"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab./X", max_size=8), min_size=1, max_size=20))
def test_extension_rule(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "p string")
    name = paths.basename(F.col("p"))
    for p, has, ext in df.select("p", paths.has_extension(name), paths.last_extension(name)).collect():
        base = p.rsplit("/", 1)[-1]
        assert has == (not base.startswith(".") and "." in base)
        if has:
            assert ext == base.rsplit(".", 1)[1]


@pytest.mark.parametrize("h, ok", [("a" * 64, True), ("a" * 63, False), ("a" * 65, False), ("A" * 64, False), ("g" * 64, False), ("a" * 64 + "\n", False), ("../x", False), (None, False)])
def test_hash_syntax(spark, h, ok):
    assert spark.createDataFrame([(h,)], "h string").select(paths.valid_hash(F.col("h"))).first()[0] is ok


def test_containment():
    assert paths.contained("a/b", "/r") and not paths.contained("../a", "/r") and not paths.contained("/etc", "/r") and paths.contained("a/../b", "/r")


def test_settings(tmp_path):
    f = tmp_path / "x.cfg"
    f.write_text("[ingest]\nmax_size=5\n[unpack]\n#unzip=true\npst=true\n")
    got = lines.settings(str(f), {"INGEST_MAX_SIZE": "7"})
    assert got["ingest"]["max_size"] == "7" and lines.flag(got, "unpack", "pst") and not lines.flag(got, "unpack", "unzip")
    f.write_text("")
    with pytest.raises(ValueError):
        lines.settings(str(f))


def test_url_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text("http://b\nhttp://a\n\n")
    (tmp_path / "b.txt").write_text("http://a\n")
    assert [r.url for r in lines.url_list(spark, str(tmp_path)).collect()] == ["http://a", "http://b"]


def test_contents_by_bytes(spark, tree, tmp_path):
    many = [(f"{tree}/a.txt", 9)] * 50 + [("/nowhere", 5), (f"{tree}/big.bin", 101), (f"{tree}/edge.bin", None)]
    got = ingest.with_content(spark.createDataFrame(many, "path string, length long").coalesce(1), most=100, batch=20).collect()
    assert sum(r.content == b"same text" for r in got) == 50 and got[50].content is None and got[50].error.startswith("FileNotFoundError")
    assert got[51].content is None and got[51].error is None and len(got[52].content) == 100


def test_one_unreadable_file_is_a_row(spark, tree):
    import os as os_

    gone = f"{tree}/gone.txt"
    with open(gone, "w") as f:
        f.write("soon gone")
    df = files.hashed(files.file_tree(spark, tree)).cache()
    df.count()
    os_.remove(gone)
    read = {os_.path.basename(r.path): r.error for r in ingest.with_content(df.drop("error")).collect()}
    assert read["gone.txt"] and not read["a.txt"]


def test_office_types_and_bounds(monkeypatch):
    word = zipped(word__document__="x", **{"word/document.xml": "<w><p><t>One</t></p></w>"})
    assert extract.office_type(word).endswith("wordprocessingml.document") and extract.office_type(zipped(mimetype="application/vnd.oasis.opendocument.text")) == "application/vnd.oasis.opendocument.text"
    assert extract.office_type(zipped(a="b")) == extract.office_type(b"PK\x03\x04 broken") == "application/zip" and "application/zip" not in extract.REGISTRY
    monkeypatch.setattr(extract, "PART", 1000)
    with pytest.raises(ValueError):
        extract.from_office(zipped(**{"word/document.xml": "<w>" + " " * 5000 + "</w>"}))
    assert extract.from_rtf(rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\pard Caf\'e9 {\b bold}\par next \u8364?5}")[0] == "Café bold\nnext €5"


def test_served(spark, tree):
    from lodestrata.operators import lookup

    found = files.hashed(files.file_tree(spark, tree))
    same = hashlib.sha256(b"same text").hexdigest()
    asked = spark.createDataFrame([(same,), ("f" * 64,), ("../x",), (None,), (same,)], "sha256 string")
    assert {r.sha256: (r.status, r.content) for r in lookup.served(asked, found).collect()} == {same: (200, b"same text"), "f" * 64: (404, None), "../x": (400, None), None: (400, None)}


def test_served_reads_contents_after_the_join(spark, tree):
    from lodestrata.operators import lookup

    found = files.hashed(files.file_tree(spark, tree))
    kept = found.select("sha256", "path", "length").collect()
    want = {r.sha256: (200, open(r.path, "rb").read() if r.length <= 100 else None) for r in kept} | {"f" * 64: (404, None), None: (400, None)}
    asked = spark.createDataFrame([(h,) for h in want], "sha256 string")
    df = lookup.served(asked, found, most=100)
    assert {r.sha256: (r.status, r.content) for r in df.collect()} == want
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan and "content#" in plan
    assert not any("Exchange" in line and "content#" in line for line in plan.splitlines()) and plan.index("content#") < plan.index("Exchange")
    known = spark.createDataFrame(kept)
    os.remove(f"{tree}/edge.bin")
    want[hashlib.sha256(b"y" * 100).hexdigest()] = (500, None)
    assert {r.sha256: (r.status, r.content) for r in lookup.served(asked, known, most=100).collect()} == want


def test_provenance_database(spark, tmp_path):
    import sqlite3

    from lodestrata.sources import provenance

    path = str(tmp_path / "files.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE files (id INTEGER PRIMARY KEY, original_filename TEXT NOT NULL, sha256 TEXT NOT NULL)")
        db.executemany("INSERT INTO files (original_filename, sha256) VALUES (?, ?)", [(f"f{i}", f"{i:064x}") for i in range(1000)])
    got = provenance.from_database(spark, path, parts=7)
    assert got.count() == 1000 and got.agg({"id": "max"}).first()[0] == 1000
    assert provenance.create_if_missing(spark, "prov_test") and not provenance.create_if_missing(spark, "prov_test")
    spark.sql("DROP TABLE prov_test")


def test_batches_of_members(spark, monkeypatch):
    many = zipped(**{f"m{i}": b"x" * i for i in range(2500)})
    rows = spark.createDataFrame([("many.zip", bytearray(many)), ("bad.zip", bytearray(many[:60]))], "path string, content binary")
    got = expand.expanded(rows).collect()
    assert sum(r.outcome == "ok" for r in got) == 2500 and sum(r.outcome.startswith("error") for r in got) == 1
    assert {r.path: r.length for r in got if r.outcome == "ok"} == {f"m{i}": i for i in range(2500)}
