"""Packages, images and PDFs: parsing, rules, cleaning."""

import io
import zipfile
import zlib

import duckdb
import pytest

import __spark_entry__ as entry
from docveil.operators import clean, dims
from docveil.plans import cleaning, inspect
from docveil.sources import carriers as make
from docveil.sources import images, pdfs
from docveil.sources.xmltext import Do, rewrite, without_hollow
from docveil.sources.zipfiles import Archive, ZipError, build, dos_time

SF = "/root/testdata/sf0.001"


def frame(spark, *files):
    return spark.createDataFrame([(n, n, bytearray(b)) for n, b in files], "file_id string, name string, content binary")


def test_zip_round_trip_and_determinism():
    parts = [("a.txt", b"one"), ("dir/b.bin", bytes(range(256)))]
    b = build(parts)
    assert b == build(parts) and zipfile.ZipFile(io.BytesIO(b)).testzip() is None
    assert [(n, Archive(b).read(n)) for n in Archive(b).entries] == parts
    assert dos_time(2026, 1, 1) == (0, (46 << 9) | (1 << 5) | 1) and dos_time(1970, 1, 1)[1] >> 9 == 0


@pytest.mark.parametrize("parts, code", [([("a", b""), ("a", b"")], "DUPLICATE_ENTRY"), ([("../a", b"")], "ZIP_SLIP"), ([("/a", b"")], "ZIP_SLIP"), ([("", b"")], "ZIP_SLIP")])
def test_zip_writer_rejects(parts, code):
    with pytest.raises(ZipError) as e:
        build(parts)
    assert e.value.code == code


def test_zip_bombs_and_damage():
    o = io.BytesIO()
    with zipfile.ZipFile(o, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big.xml", b"\0" * (2 << 20))
    b = bytearray(o.getvalue())
    with pytest.raises(ZipError, match="ratio"):
        Archive(bytes(b))
    at = b.rindex(b"PK\x01\x02")
    b[at + 24 : at + 28] = (32).to_bytes(4, "little")
    with pytest.raises(ZipError) as e:
        Archive(bytes(b)).read("big.xml")
    assert e.value.code == "ZIP_BOMB"
    with pytest.raises(ZipError, match="End of central"):
        Archive(b"PK\3\4 nothing")


def test_tiff_and_png_text():
    ok, _, fields, place = images.tiff(make.tiff({0x010F: "Cam", 0x013B: "Someone"}, (37, 33, 5960), (126, 58, 4170)))
    assert ok and dict(fields) == {0x010F: "Cam", 0x013B: "Someone"} and place == "37.566556, 126.978250"
    assert images.tiff(b"XX\0\0\0\0\0\0")[:2] == (False, "Invalid TIFF byte order.")
    big = images.Piece("zTXt", 0, 0, b"k\0\0" + zlib.compress(b"x" * (6 << 20)))
    assert images.png_text(big) == ("k", "(compressed zTXt)")
    assert images.png_text(images.Piece("iTXt", 0, 0, b"k\0\0\0en\0t\0text")) == ("k", "text")


def test_pdf_strings_and_streams():
    assert pdfs.literal(r"(a\(b\)\101\n)") == "a(b)A" and pdfs.literal("<FEFF00410042>") == "AB"
    assert "/Launch" in pdfs.text(make.pdf(packed="/Launch x"))
    text = "/URI (https://a.example/x) https://a.example/x mailto:m@a.example"
    assert pdfs.urls(text, pdfs.values(text)[1]) == ["https://a.example/x", "mailto:m@a.example"]


def test_image_cleaning_keeps_pixels():
    for kind, b in (("png", make.png((("Author", "x"),), make.tiff({0x010F: "Camera"}))), ("jpeg", make.jpeg("note", make.tiff({0x010F: "Camera"}), "cap")), ("webp", make.webp(make.tiff({0x010F: "Camera"}), "<x/>"))):
        out, gone = clean.clean_image(kind, b)
        assert gone and images.pixel_bytes(kind, out) == images.pixel_bytes(kind, b) and clean.clean_image(kind, out) == (out, [])
    assert [p.kind for p in images.webp(clean.clean_image("webp", make.webp(b"x", "y"))[0])] == ["VP8X", "VP8L"]
    with pytest.raises(clean.Refused):
        clean.clean_image("png", make.png(provenance=True))
    assert not any(images.role("png", p) == "provenance" for p in images.png(clean.clean_image("png", make.png(provenance=True), True)[0]))


def test_package_cleaning():
    b = make.docx("Hello", "Ann", inserted=2, hidden=1, link="https://x.example/a", comments=2, thumbnail=True, custom=True)
    out, removed, changed, warnings = clean.clean_package(b, "docx", set(dims.ACTIONS))
    text = Archive(out).text("word/document.xml")
    assert "w:ins" not in text and "new1" in text and "word/comments.xml" in removed and "docProps/core.xml" in changed and len(warnings) == 3
    assert dims.REMOVED_TARGET in Archive(out).text("word/_rels/document.xml.rels")
    signed = make.docx("x", signed=True)
    with pytest.raises(clean.Refused):
        clean.clean_package(signed, "docx", {"office-properties"})
    assert "_xmlsignatures/sig1.xml" not in Archive(clean.clean_package(signed, "docx", set(), True)[0]).entries


def test_scan_and_clean(spark):
    files = frame(
        spark, ("r.docx", make.docx("Hello", "Ann", inserted=1, hidden=1, link="file:///c/x", comments=1)), ("p.png", make.png((("Author", "Ann"),))), ("c.pdf", make.pdf("Ann", script=True)),
        ("wrong.pdf", make.png()), ("x.txt", b"text"), ("m.docm", make.docx("x", extra=(("word/vbaProject.bin", b"1"),))), ("bad.docx", b"PK\3\4zzz"),
    )
    s = inspect.scan(files)
    titles = {}
    for r in s.findings.orderBy("file_id", "place").collect():
        titles.setdefault(r["file_id"], []).append(r["title"])
    assert titles["r.docx"] == ["Comments and reviewer identities", "Tracked revisions", "External hyperlink", "Document author", "Hidden Word text"]
    assert titles["p.png"] == ["PNG text: Author"] and titles["c.pdf"] == ["Embedded JavaScript", "PDF Author"]
    assert titles["wrong.pdf"] == ["File type mismatch"] and titles["x.txt"] == ["File type mismatch", "Unsupported file type"]
    assert titles["m.docm"] == ["Macros or ActiveX content"] and titles["bad.docx"] == ["Invalid or unsafe ZIP package", "File type mismatch"]
    levels = {r["file_id"]: (r["level"], r["score"]) for r in s.summary.collect()}
    assert levels["x.txt"] == ("low", 8) and levels["m.docm"] == ("critical", 28) and levels["p.png"] == ("low", 8)
    rows = {r["file_id"]: r for r in cleaning.clean(s).collect()}
    assert rows["r.docx"]["same_content"] and (rows["r.docx"]["original_findings"], rows["r.docx"]["sanitized_findings"]) == (5, 3) and rows["r.docx"]["name"] == "r.safe.docx"
    assert rows["p.png"]["sanitized_findings"] == 0 and rows["c.pdf"]["error"]
    report = inspect.markdown_reports(inspect.reports(s)).where("file_id = 'c.pdf'").first()["markdown"]
    assert "CRITICAL (36/100)" in report and "### CRITICAL · Embedded JavaScript" in report


ORACLES = ["external_links", "extract_title", "evidence_truncate", "output_filename", "format_bytes", "findings_ranked", "risk_summary", "facet_buttons", "top_categories", "threshold_gate", "actions_offered", "png_scan", "hostile_zip", "docx_properties", "docx_active", "zip_limits", "dispatch_scan", "pdf_features", "jpeg_metadata", "png_parts_scan", "clean_everything", "clean_markup", "report_markdown_text", "arrivals_stream"]


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    rel = c.sql(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})")
    assert sorted(map(repr, (tuple(r[x] for x in cols) for r in got.collect()))) == sorted(map(repr, rel.fetchall()))


def test_xml_is_rewritten_by_elements():
    acts = {"d": Do.DROP, "u": Do.UNWRAP}
    one = lambda xml: rewrite(xml, lambda t: acts.get(t.name, Do.KEEP))
    assert one("<a>1<d>2<d>3</d>4<u>5</u></d>6<u k='>'>7<d/><u/>8</u></a>") == "<a>1678</a>"
    assert one("<a><!-- <d> --><![CDATA[<d>]]><?d?></b></a><d>rest") == "<a><!-- <d> --><![CDATA[<d>]]><?d?></b></a>"
    assert without_hollow("<r><p><q/></p> </r><r/><r><t/></r><r>x</r><r><r></r></r>", "r", "p") == "<r/><r><t/></r><r>x</r><r></r>"
    tag = []
    assert rewrite("<R Id='1' Target='x' />", lambda t: (tag.append(t.get("target")), t.write(Target="y", TargetMode="E"), Do.KEEP)[-1]) == "<R Id='1' Target=\"y\" TargetMode=\"E\" />" and tag == ["x"]


def test_copies_are_written_by_tasks(spark, tmp_path):
    copies = cleaning.clean(inspect.scan(frame(spark, ("a.docx", make.docx("Hello", "Ann")), ("b.png", make.png((("Author", "x"),))), ("c.pdf", make.pdf("x")))))
    rows = {r["file_id"]: r for r in cleaning.write_copies(copies, str(tmp_path)).collect()}
    assert rows["c.pdf"]["path"] is None and rows["a.docx"]["path"].endswith("/a.safe.docx")
    assert all(len(open(r["path"], "rb").read()) == r["length"] for r in rows.values() if r["path"])
    assert sum(p.is_file() for p in tmp_path.rglob("*") if not p.name.endswith(".crc")) == 2


def test_command_line(spark, tmp_path, capsys):
    from docveil.__main__ import main

    assert main(["scan", "x", "--fail-on", "clear"], spark) == 1 and main(["scan", "x", "--fail-on", "grave"], spark) == 1 and main([], spark) == 0
    with pytest.raises(SystemExit) as e:
        main(["scan", "--unknown"], spark)
    assert e.value.code == 1

    f = tmp_path / "a.docx"
    f.write_bytes(make.docx("Hello", "Ann", comments=1))
    assert main(["scan", str(f), "--fail-on", "low"], spark) == 2 and "1 file(s), 2 finding(s)" in capsys.readouterr().out
    assert main(["clean", str(f)], spark) == 0 and "Findings: 2 → 0" in capsys.readouterr().out
    assert (tmp_path / "a.safe.docx").exists()
