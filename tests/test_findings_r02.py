"""Findings of round 2 on the inspection queries."""

import zlib

import pyarrow as pa

from docveil.plans import queries
from docveil.plans.queries_wide import slides_of
from docveil.sources import carriers as make
from docveil.sources import facts, pdfs


def with_checksum(checksum: bytes, n: int = 256) -> bytes:
    """Letters whose Adler-32, the last four bytes of their zlib stream, is the given one."""
    high, low = int.from_bytes(checksum[:2], "big"), int.from_bytes(checksum[2:], "big")
    data = bytearray((low - 1 + k) // n for k in range(n))
    missing = (high - (zlib.adler32(data) >> 16)) % 65521
    for k in range(n // 2):  # moving one up by some places adds as much to the upper half
        times = min(20, missing // (n - 1 - 2 * k))
        data[k] += times
        data[n - 1 - k] -= times
        missing -= times * (n - 1 - 2 * k)
    return bytes(data)


def test_names_in_packed_bytes_mark_nothing():
    body = with_checksum(b"/JS ")
    packed = zlib.compress(body)
    assert packed.endswith(b"/JS ") and b"/JS" not in body
    file = lambda more: b"%PDF-1.6\n1 0 obj << /Filter /FlateDecode >> stream\n" + packed + more + b"\nendstream endobj\nstartxref\n0\n%%EOF\n"
    marks = lambda b: next(value for fact, _, _, value, _ in facts.pdf_facts(b) if fact == "pdf")
    assert marks(file(b"")) == "" and pdfs.streams(file(b"")) == [body]
    assert marks(file(b"/OpenAction 1")) == "opens"  # behind the stream's end nothing is packed
    assert marks(file(b"")[:-30] + b" /JS (x)") == "javascript"
    assert marks(make.pdf(packed="/Launch x")) == "launch"
    damaged = file(b"").replace(packed, packed[1:])
    assert marks(damaged) == "javascript"  # can't be inflated: the raw bytes are looked at


def test_slides_leave_no_text_in_facts_and_files_come_in_small_batches():
    rows = pa.RecordBatch.from_pylist([{"doc_id": k, "text": "wörd " * 20_000, "lang": "en", "source": "s"} for k in range(60)])
    files = list(queries.wrapped([rows], "pptx", slides_of))
    assert sum(b.num_rows for b in files) == 60 and sum(b.nbytes for b in files) > 60e6 and max(b.nbytes for b in files) < 8e6
    parts = [value for fact, path, _, value, _ in facts.zip_facts(files[0]["content"][0].as_py()) if fact == "part" and path.startswith("ppt/slides/")]
    assert parts == [""] * 12


def test_hidden_slides_are_found_by_their_attribute():
    package = make.pptx(3, hidden=2)
    parts = {path: value for fact, path, _, value, _ in facts.zip_facts(package) if fact == "part" and path.startswith("ppt/slides/")}
    assert parts == {"ppt/slides/slide1.xml": 'show="0"', "ppt/slides/slide2.xml": 'show="0"', "ppt/slides/slide3.xml": ""}
