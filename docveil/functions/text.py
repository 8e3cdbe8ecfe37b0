"""Text and name functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docveil.operators import dims

#: White space as web pages and office software count it; Java's \\s alone is ASCII.
SPACE = r"[\s\u000B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
ZERO_WIDTH = "[\\u200B\\u200C\\u200D\\u2060\\uFEFF]"
BIDI = "[\\u202A-\\u202E\\u2066-\\u2069]"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def truncate(c: Column, n: int = 180) -> Column:
    flat = collapse(F.coalesce(c, F.lit("")))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n - 1), F.lit("…"))).otherwise(flat)


def unescape_xml(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def strip_xml(c: Column) -> Column:
    return unescape_xml(collapse(F.regexp_replace(c, "<[^>]+>", " ")))


def escape_html(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def tag_text(xml: Column, tag: str) -> Column:
    """Text of the first element ``tag``; null if there is none or it is empty."""
    return null_if_empty(strip_xml(F.regexp_extract(xml, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)))


def attribute(fragment: Column, name: str) -> Column:
    """Value of an attribute, decoded; null if it isn't there. The last one counts if it is repeated."""
    every = F.regexp_extract_all(fragment, F.lit(rf"""(?<![\w:.-])({name}\s*=\s*(?:"[^"]*"|'[^']*'))"""), F.lit(1))
    last = F.try_element_at(every, F.lit(-1))
    return unescape_xml(F.regexp_extract(last, r"""(?s)=\s*["'](.*)["']$""", 1))


def attribute_map(fragment: Column) -> Column:
    """All attributes of a tag as a map; the last of equal names counts."""
    pairs = F.regexp_extract_all(fragment, F.lit(r"""([A-Za-z_:][\w:.-]*\s*=\s*(?:"[^"]*"|'[^']*'))"""), F.lit(1))
    entries = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^([^\s=]+)", 1).alias("k"), unescape_xml(F.regexp_extract(p, r"""(?s)=\s*["'](.*)["']$""", 1)).alias("v")))
    names = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"]))


def count_matches(c: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0))


def extension(name: Column) -> Column:
    return F.regexp_extract(F.lower(name), r"\.([a-z0-9]+)$", 1)


def mime_of(name: Column) -> Column:
    """MIME type by extension; a name without a dot that is an extension counts as one."""
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    table = F.create_map(*[F.lit(x) for pair in dims.MIME.items() for x in pair])
    return F.coalesce(F.try_element_at(table, ext), F.lit(dims.OCTETS))


def safe_filename(name: Column) -> Column:
    clean = collapse(F.regexp_replace(F.coalesce(null_if_empty(name), F.lit("file")), r'[\\/:*?"<>|\u0000-\u001f]', "-"))
    return F.coalesce(null_if_empty(F.substring(clean, 1, 160)), F.lit("file"))


def output_filename(name: Column, suffix: str = ".safe") -> Column:
    """The suffix goes before the last dot; names without one, or that begin with their only dot, get it at the end."""
    clean = safe_filename(name)
    dot = F.length(clean) - F.length(F.element_at(F.split(clean, r"\."), -1))
    return F.when(dot <= 1, F.concat(clean, F.lit(suffix))).otherwise(F.concat(clean.substr(F.lit(1), dot - 1), F.lit(suffix), clean.substr(dot, F.length(clean))))


def format_bytes(n: Column) -> Column:
    n = n.cast("double")
    out = F.when(n.isNull() | F.isnan(n) | (n < 0), F.lit("—")).when(n < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B")))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        x = n / float(1024**power)
        text = F.when(x >= 10, F.format_string("%.1f", x)).otherwise(F.format_string("%.2f", x))
        text = F.concat(text, F.lit(" " + unit))
        out = out.when(x < 1024, text) if unit != "TB" else out.otherwise(text)
    return out


def is_url(c: Column) -> Column:
    return F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))).isin("http", "https", "mailto", "ftp", "file")


def utf8(b: Column) -> Column:
    """Bytes as UTF-8: what can't be decoded becomes U+FFFD, a leading byte order mark goes."""
    return F.regexp_replace(F.make_valid_utf8(b.cast("string")), r"^\uFEFF", "")


def cp1252(b: Column) -> Column:
    """Bytes as windows-1252, one character a byte."""
    codes = [c for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
    return F.translate(F.decode(b, "ISO-8859-1"), "".join(map(chr, codes)), bytes(codes).decode("cp1252"))


def iso_date(c: Column) -> Column:
    """A date or time as ISO 8601 in UTC; empty is null, what can't be read stays as it is."""
    at = F.try_to_timestamp(c)
    return F.when(c == "", None).when(at.isNotNull(), F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))).otherwise(c)
