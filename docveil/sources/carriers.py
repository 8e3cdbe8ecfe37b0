"""Example files made from table rows, for tests and queries: what is in them follows from the row."""

from __future__ import annotations

import struct
import zlib
from xml.sax.saxutils import escape

from .zipfiles import CENTRAL, build

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def rels(*items: tuple[str, str, bool]) -> bytes:
    rows = "".join(f'<Relationship Id="rId{k}" Type="{REL}/{kind}" Target="{escape(target)}"{" TargetMode=" + chr(34) + "External" + chr(34) if ext else ""}/>' for k, (kind, target, ext) in enumerate(items, 1))
    return f"<?xml version='1.0'?><Relationships>{rows}</Relationships>".encode()


def core(author: str = "", editor: str = "") -> bytes:
    cells = [(f"<dc:creator>{escape(author)}</dc:creator>" if author else ""), (f"<cp:lastModifiedBy>{escape(editor)}</cp:lastModifiedBy>" if editor else "")]
    return f"<cp:coreProperties>{''.join(cells)}</cp:coreProperties>".encode()


def docx(body: str, author: str = "", inserted: int = 0, hidden: int = 0, link: str = "", comments: int = 0, thumbnail: bool = False, zero_width: int = 0, custom: bool = False, signed: bool = False, extra: tuple = (), core_xml: bytes | None = None, document: bytes | None = None, types: bytes = b"<Types><Override PartName=\"/word/document.xml\" ContentType=\"main\"/></Types>") -> bytes:
    runs = f"<w:p><w:r><w:t>{escape(body)}{chr(0x200B) * zero_width}</w:t></w:r></w:p>"
    runs += "".join(f'<w:p><w:ins w:id="{k}" w:author="x"><w:r><w:t>new{k}</w:t></w:r></w:ins></w:p>' for k in range(inserted))
    runs += "<w:p><w:r><w:rPr><w:vanish/></w:rPr><w:t>h</w:t></w:r></w:p>" * hidden
    body_xml = document or f"<w:document {W}><w:body>{runs}</w:body></w:document>".encode()
    parts = [("[Content_Types].xml", types), ("_rels/.rels", rels(("officeDocument", "word/document.xml", False))), ("docProps/core.xml", core_xml or core(author)), ("word/document.xml", body_xml)]
    if link:
        parts.append(("word/_rels/document.xml.rels", rels(("hyperlink", link, True))))
    if comments:
        parts.append(("word/comments.xml", ("<w:comments>" + "".join(f'<w:comment w:id="{k}" w:author="reviewer"/>' for k in range(comments)) + "</w:comments>").encode()))
    if thumbnail:
        parts.append(("docProps/thumbnail.jpeg", b"\xff\xd8\xff"))
    if custom:
        parts.append(("customXml/item1.xml", b"<a/>"))
    if signed:
        parts.append(("_xmlsignatures/sig1.xml", b"<s/>"))
    return build([*parts, *extra])


def xlsx(author: str = "", hidden: int = 0, external: bool = False) -> bytes:
    sheets = '<sheet name="Data" sheetId="1"/>' + "".join(f'<sheet name="H{k}" sheetId="{k + 2}" state="veryHidden"/>' for k in range(hidden))
    parts = [("[Content_Types].xml", b"<Types/>"), ("docProps/core.xml", core(author)), ("xl/workbook.xml", f"<workbook><sheets>{sheets}</sheets></workbook>".encode()), ("xl/worksheets/sheet1.xml", b"<worksheet/>")]
    if external:
        parts += [("xl/externalLinks/externalLink1.xml", b"<externalLink/>"), ("xl/externalLinks/_rels/externalLink1.xml.rels", rels(("externalLinkPath", "file:///C:/book.xlsx", True)))]
    return build(parts)


def pptx(slides: int = 1, hidden: int = 0, notes: int = 0, editor: str = "") -> bytes:
    parts = [("[Content_Types].xml", b"<Types/>"), ("docProps/core.xml", core("", editor)), ("ppt/presentation.xml", b"<p:presentation/>")]
    parts += [(f"ppt/slides/slide{k + 1}.xml", f'<p:sld{" show=" + chr(34) + "0" + chr(34) if k < hidden else ""}><a:t>slide {k}</a:t></p:sld>'.encode()) for k in range(slides)]
    parts += [(f"ppt/notesSlides/notesSlide{k + 1}.xml", b"<p:notes/>") for k in range(notes)]
    return build(parts)


def chunk(kind: bytes, data: bytes, damage: int = 0) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data) ^ damage)


def png(texts: tuple = (), exif: bytes = b"", provenance: bool = False, extra: tuple = ()) -> bytes:
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", 1, 1, 8, 2, 0, 0, 0))
    out += b"".join(chunk(b"tEXt", k.encode() + b"\0" + v.encode()) for k, v in texts)
    out += (chunk(b"eXIf", exif) if exif else b"") + (chunk(b"caBX", b"jumb") if provenance else b"") + b"".join(extra)
    return out + chunk(b"IDAT", zlib.compress(b"\0\1\2\3")) + chunk(b"IEND", b"")


def tiff(fields: dict[int, str], north: tuple | None = None, east: tuple | None = None, sides: tuple[str, str] = ("N", "E")) -> bytes:
    """A little-endian TIFF block with text fields, and coordinates as (degrees, minutes, hundredths of seconds)."""
    n = len(fields) + (north is not None)
    gps_at = 8 + 2 + 12 * n + 4
    blob, entries = b"", []
    data_at = gps_at + (2 + 12 * 4 + 4 if north is not None else 0)
    for tag in sorted(fields):
        raw = fields[tag].encode() + b"\0"
        entries.append(struct.pack("<2HI", tag, 2, len(raw)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", data_at + len(blob))))
        blob += raw if len(raw) > 4 else b""
    gps = b""
    if north is not None:
        entries.append(struct.pack("<2H2I", 0x8825, 4, 1, gps_at))
        three = lambda v: struct.pack("<6I", v[0], 1, v[1], 1, v[2], 100)
        side = lambda tag, s: struct.pack("<2HI", tag, 2, 2) + s.encode().ljust(4, b"\0")
        at = data_at + len(blob)
        blob += three(north) + three(east)
        gps = struct.pack("<H", 4) + side(1, sides[0]) + struct.pack("<2H2I", 2, 5, 3, at) + side(3, sides[1]) + struct.pack("<2H2I", 4, 5, 3, at + 24) + struct.pack("<I", 0)
    return b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", len(entries)) + b"".join(entries) + struct.pack("<I", 0) + gps + blob


def jpeg(comment: str = "", exif: bytes = b"", iptc: str = "", provenance: bool = False, xmp: str = "") -> bytes:
    seg = lambda m, d: b"\xff" + bytes([m]) + struct.pack(">H", len(d) + 2) + d
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0")
    out += (seg(0xE1, b"Exif\0\0" + exif) if exif else b"") + (seg(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + xmp.encode()) if xmp else b"") + (seg(0xED, iptc.encode()) if iptc else b"") + (seg(0xEB, b"JP\0\0c2pa") if provenance else b"") + (seg(0xFE, comment.encode()) if comment else b"")
    return out + seg(0xDA, b"\1\1\0\0\x3f\0") + b"\x12\x34" + b"\xff\xd9"


def webp(exif: bytes = b"", xmp: str = "", provenance: bool = False) -> bytes:
    part = lambda k, d: k + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2)
    body = part(b"VP8X", bytes([0x0C]) + b"\0" * 9) + (part(b"EXIF", exif) if exif else b"") + (part(b"XMP ", xmp.encode()) if xmp else b"") + (part(b"C2PA", b"jumb") if provenance else b"") + part(b"VP8L", b"\x2f\0\0\0\0")
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def pdf(author: str = "", title: str = "", links: tuple = (), script: bool = False, form: bool = False, packed: str = "", saves: int = 1) -> bytes:
    rows = [f"1 0 obj << /Type /Catalog {'/OpenAction << /S /JavaScript /JS (x) >>' if script else ''} {'/AcroForm << >>' if form else ''} >> endobj"]
    info = (f"/Author ({author}) " if author else "") + (f"/Title ({title}) " if title else "")
    rows.append(f"2 0 obj << {info}>> endobj")
    rows += [f"{k} 0 obj << /A << /URI ({u}) >> >> endobj" for k, u in enumerate(links, 3)]
    out = "%PDF-1.7\n" + "\n".join(rows) + "\n"
    body = out.encode("latin-1")
    if packed:
        data = zlib.compress(packed.encode())
        body += b"9 0 obj << /Filter /FlateDecode /Length " + str(len(data)).encode() + b" >> stream\n" + data + b"\nendstream endobj\n"
    return body + b"startxref\n0\n%%EOF\n" * saves


def directory_entry(package: bytes, name: str) -> int:
    """Where the central directory's record of a part begins."""
    return package.index(name.encode(), package.index(CENTRAL)) - 46


def forged(package: bytes, name: str, size: int, packed: int | None = None) -> bytes:
    """A package that lies about the size of a part (and its packed size)."""
    out, at = bytearray(package), directory_entry(package, name)
    out[at + 24 : at + 28] = struct.pack("<I", size)
    if packed is not None:
        out[at + 20 : at + 24] = struct.pack("<I", packed)
    return bytes(out)


def encrypted(package: bytes, name: str) -> bytes:
    """A package in which a part is marked as encrypted."""
    out, at = bytearray(package), directory_entry(package, name)
    out[at + 8] |= 1
    return bytes(out)
