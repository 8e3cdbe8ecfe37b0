"""Inspection rules: columns over facts that give findings.

``row_findings`` looks at one fact at a time (no shuffle); ``file_findings`` needs all facts of a file (one groupBy).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docveil.functions import text as tx

from . import dims

FIELDS = "stage int, item int, category string, severity string, title string, description string, evidence string, path string, remediation string, cleanable boolean, clean_action string, tags array<string>"

IMAGE, PROPERTIES, COMMENTS, THUMBNAIL, CUSTOM, LINKS, CHANGES = dims.ACTIONS


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def finding(stage: int, category, severity, title, evidence=None, path=None, description: str = "", remediation=None, action=None, item=0, tags: Iterable[str] = ()) -> Column:
    """A finding with its evidence as it is; ``exploded`` cuts it."""
    e = lit(evidence).cast("string")
    action = lit(action).cast("string")
    cells = (lit(stage), lit(item).cast("int"), lit(category), lit(severity), lit(title), lit(description), e, lit(path).cast("string"), lit(remediation).cast("string"), action.isNotNull(), action, F.array(*map(F.lit, tags)).cast("array<string>"))
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return F.struct(*[c.alias(n) for c, n in zip(cells, names, strict=True)])


def exploded(rows: DataFrame, *keep: Column | str, found: Column) -> DataFrame:
    """A row for each finding of the array; evidence is collapsed and cut, and null if there is none."""
    out = rows.select(*keep, F.explode(found).alias("f")).select(*[k if isinstance(k, str) else "seq" for k in keep], "f.*")
    return out.withColumn("evidence", F.when(F.col("evidence") != "", tx.truncate(F.col("evidence"), dims.EVIDENCE)))


def some(condition: Column, one: Column) -> Column:
    """An array of the finding, or an empty one."""
    return F.when(condition, F.array(one))


def each(items: Column, make) -> Column:
    return F.transform(items, make)


#: Beginnings of targets that lead outside; TIFF fields that identify a device or a person.
EXTERNAL = r"(?i)^(?:https?:|ftp:|file:|mailto:|\\\\|[A-Za-z]:\\)"
HIDDEN_IN_TIFF = ["cameraOwner", "bodySerial", "lensSerial", "imageUniqueId"]
PERSONAL_IN_TIFF = ["artist", "copyright", "userComment", "description"]


def lookup(table: dict, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), default)


def image_rules() -> dict[str, Column]:
    label = lookup({k: v for v, k in dims.TIFF_TAGS.values()}, F.col("key"), F.col("key"))
    device, person = F.col("key").isin(HIDDEN_IN_TIFF), F.col("key").isin(PERSONAL_IN_TIFF)
    advice = "Clean the image before sharing it."
    where = F.col("key").startswith("GPS")
    author = F.lower(F.col("key")).rlike("author|artist|creator|copyright")
    telling = F.lower(F.col("key")).rlike("author|artist|creator|copyright|comment|description|software|date|time|location|gps")
    image = {"action": IMAGE, "path": F.col("path")}
    return {
        "gps": finding(20, "location", "high", "Exact GPS coordinates", F.col("value"), description="The place where the picture was taken, to a few metres.", remediation=advice, **image),
        "tiff": finding(20, F.when(device | person, "identity").otherwise("privacy"), F.when(device, "high").when(person, "medium").otherwise("low"), label, F.col("value"), description="A camera or editor field that the picture doesn't show.", remediation=advice, **image),
        "bad_exif": finding(20, "integrity", "low", "Malformed EXIF block", F.col("value"), description="The EXIF block can't be read as a whole.", **image),
        "xmp_packet": finding(20, "privacy", "low", "XMP metadata packet", description="An XMP packet without known values.", **image),
        "xmp": finding(20, F.when(where, "location").when(F.col("key") == "Creator", "identity").otherwise("privacy"), F.when(where, "high").when(F.col("key") == "Creator", "medium").otherwise("low"), F.concat(F.lit("XMP "), F.col("key")), F.col("value"), description="XMP tells who made the image, when, where or with what.", **image),
        "iptc": finding(20, "identity", "medium", "IPTC / Photoshop metadata", F.col("value"), description="A block that may hold names and captions.", **image),
        "comment": finding(20, "privacy", "medium", "JPEG comment", F.col("value"), description="A comment stored in the file.", **image),
        "bad_crc": finding(20, "integrity", "high", "Invalid PNG chunk checksum", F.col("key"), F.col("path"), description="A chunk was changed or damaged."),
        "png_text": finding(20, F.when(author, "identity").otherwise("privacy"), F.when(telling, "medium").otherwise("low"), F.concat(F.lit("PNG text: "), F.coalesce(tx.null_if_empty(F.col("key")), F.lit("unnamed field"))), F.col("value"), description="A text field stored in the image.", **image),
        "png_time": finding(20, "privacy", "low", "PNG modification time", F.col("value"), description="When the image was last changed.", **image),
        "webp_xmp": finding(20, "privacy", F.when(F.col("n") > 0, "medium").otherwise("low"), "WebP XMP metadata", F.col("value"), description="The image carries an XMP packet.", **image),
    }


def pdf_rules() -> list[tuple[str, Column]]:
    """(fact, findings); the marks of a PDF are found while it is parsed."""
    marks = F.split(F.col("value"), " ")
    has = lambda mark: F.array_contains(marks, mark)
    author = F.lower(F.col("key")).contains("author")
    return [
        ("pdf_property", some(F.col("value").isNotNull(), finding(30, F.when(author, "identity").otherwise("privacy"), F.when(author, "medium").otherwise("low"), F.concat(F.lit("PDF "), F.col("key")), F.col("value"), F.col("path"), "A property that pages don't show.", "Rewrite the file with an editor that removes properties."))),
        ("pdf_urls", some(F.col("n") > 0, finding(31, "external", "medium", "External links", F.col("value"), F.col("path"), "Links to the web or to mail addresses; following one can be noticed."))),
        ("pdf", some(has("javascript"), finding(32, "active", "critical", "Embedded JavaScript", F.when(has("opens"), "JavaScript with automatic or additional actions").otherwise("JavaScript action"), "PDF actions", "Scripts that some readers run.", "Open only in a hardened reader."))),
        ("pdf", some(has("opens") & ~has("javascript"), finding(33, "active", "high", "Automatic document action", None, "PDF OpenAction/AA", "Something happens when the file or a page is opened."))),
        ("pdf", some(has("launch"), finding(34, "active", "critical", "Launch or submit action", None, "PDF actions", "Starts a program, sends a form or fetches data."))),
        ("pdf", some(has("embedded"), finding(35, "embedded", "high", "Embedded files or rich media", None, "PDF name tree / file specification", "Other files are stored or referred to inside."))),
        ("pdf", some(has("form"), finding(36, "structure", "medium", "Interactive form data", None, "PDF AcroForm/XFA", "Form fields may hold what was typed into them."))),
        ("pdf", some(has("encrypted"), finding(37, "structure", "high", "Encrypted PDF", None, "PDF trailer", "Parts can't be looked at without a password."))),
        ("pdf", some(has("signature"), finding(38, "integrity", "info", "Digital signature data", None, "PDF signature dictionary", "Signed; rewriting makes the signature invalid."))),
        ("pdf_saves", some(F.col("n") > 1, finding(39, "structure", "medium", "Incremental save history", F.col("value"), "PDF structure", "Saved more than once; older states may still be inside."))),
        ("pdf", some(has("provenance"), finding(40, "provenance", "info", "Possible Content Credentials data", None, "PDF metadata/boxes", "Strings of provenance data."))),
    ]


def property_array(fields: list[tuple], stage: int) -> Column:
    made = [F.struct(tx.tag_text(F.col("value"), tag).alias("v"), F.lit(k).alias("k")) for k, (tag, *_) in enumerate(fields)]
    out = F.array()
    for k, (_, title, category, severity) in enumerate(fields):
        value = made[k]["v"]
        out = F.concat(out, F.coalesce(some(value.isNotNull(), finding(stage, category, severity, title, value, F.col("path"), "A document property that pages don't show.", action=PROPERTIES, item=k)), F.array().cast(f"array<struct<{as_ddl()}>>")))
    return out


def as_ddl() -> str:
    return ", ".join(f.replace(" ", ": ", 1) for f in FIELDS.split(", "))


def relation_findings() -> Column:
    """A finding for each relationship of a .rels part that leads outside."""
    tags = F.regexp_extract_all(F.col("value"), F.lit(r"(?i)(<Relationship\b[^>]*>)"), F.lit(1))
    read = lambda tag, name: F.coalesce(tx.attribute(tag, name), tx.attribute(tag, name[0].lower() + name[1:]), F.lit(""))
    rows = F.transform(tags, lambda t, i: F.struct(read(t, "Type").alias("type"), read(t, "Target").alias("target"), read(t, "TargetMode").alias("mode"), i.alias("i")))
    outside = F.filter(rows, lambda r: (r["mode"].rlike("(?i)^external$") | r["target"].rlike(EXTERNAL)) & ~r["target"].contains("docveil.invalid/removed"))

    def make(r: Column) -> Column:
        tail = F.coalesce(tx.null_if_empty(F.element_at(F.split(r["type"], "/"), -1)), F.lit("relationship"))
        grave = r["type"].rlike("(?i)attachedTemplate|externalLink|oleObject|package|image|audio|video") | r["target"].rlike(r"^file:|^[A-Za-z]:\\|^\\\\")
        return finding(54, "external", F.when(grave, "high").otherwise("medium"), lookup(dims.RELATION_LABEL, tail, F.concat(F.lit("External "), tail)), r["target"], F.col("path"), "Opening or refreshing the document may contact this place.", "Neutralize the target in a copy if it isn't needed.", LINKS, item=r["i"])

    return each(outside, make)


def office_rules() -> list[tuple[Column, Column]]:
    """(which parts, findings). The patterns are fixed values: elements and attributes of Office Open XML."""
    part = lambda name: F.col("path") == name
    props = F.regexp_extract_all(F.col("value"), F.lit(r"(?is)(<property\b[^>]*>.*?</property>)"), F.lit(1))
    listed = F.transform(F.slice(props, 1, 30), lambda p: F.concat(F.coalesce(tx.attribute(F.regexp_extract(p, r"(?is)^(<property\b[^>]*>)", 1), "name"), F.lit("Unnamed")), F.lit(": "), tx.truncate(tx.strip_xml(F.regexp_extract(p, r"(?is)^<property\b[^>]*>(.*)</property>$", 1)), 100)))
    custom = F.coalesce(tx.null_if_empty(F.array_join(listed, " · ")), F.lit("Custom properties part present"))
    hidden = tx.count_matches(F.col("value"), r"(?i)<w:(?:vanish|webHidden)(?![A-Za-z0-9_])")
    codes = F.filter(F.transform(F.regexp_extract_all(F.col("value"), F.lit(r"(?is)<w:instrText[^>]*>(.*?)</w:instrText>"), F.lit(1)), tx.strip_xml), lambda c: c.rlike("(?i)DDEAUTO|DDE|INCLUDETEXT|INCLUDEPICTURE|LINK|DATABASE"))
    sheets = F.regexp_extract_all(F.col("value"), F.lit(r"(?i)(<sheet\b[^>]*/>)"), F.lit(1))
    sheets = F.filter(sheets, lambda t: F.lower(F.coalesce(tx.attribute(t, "state"), F.lit(""))).isin("hidden", "veryhidden"))
    shown = F.array_join(F.transform(sheets, lambda t: F.concat(F.coalesce(tx.null_if_empty(tx.attribute(t, "name")), F.lit("Unnamed")), F.lit(" ("), tx.attribute(t, "state"), F.lit(")"))), ", ")
    return [
        (part("docProps/core.xml"), property_array(dims.CORE_PROPERTIES, 51)),
        (part("docProps/app.xml"), property_array(dims.APP_PROPERTIES, 52)),
        (part("docProps/custom.xml"), F.array(finding(53, "privacy", "medium", "Custom document properties", custom, F.col("path"), "Fields of a workflow, often with internal names.", action=CUSTOM))),
        (F.col("path").endswith(".rels"), relation_findings()),
        (part("word/document.xml") & (F.col("key") == "docx"), F.concat(F.coalesce(some(hidden > 0, finding(64, "structure", "medium", "Hidden Word text", F.concat(hidden.cast("string"), F.lit(" hidden text markers")), F.col("path"), "Text that is formatted as hidden.")), F.array().cast(f"array<struct<{as_ddl()}>>")),
            F.coalesce(some(F.size(codes) > 0, finding(65, "active", "high", "External or dynamic field codes", F.array_join(F.slice(codes, 1, 8), " · "), F.col("path"), "Fields that fetch data or talk to other programs.")), F.array().cast(f"array<struct<{as_ddl()}>>")))),
        (part("xl/workbook.xml") & (F.col("key") == "xlsx"), some(F.size(sheets) > 0, finding(66, "structure", "high", "Hidden workbook sheets", shown, F.col("path"), "Sheets that a reader can show again."))),
    ]


def row_findings(facts: DataFrame) -> DataFrame:
    """Findings that one fact is enough for: file_id, seq and the finding's fields."""
    empty = F.array().cast(f"array<struct<{as_ddl()}>>")
    rules = F.lit(None).cast(f"array<struct<{as_ddl()}>>")
    cases = None
    for fact, one in image_rules().items():
        cases = F.when(F.col("fact") == fact, F.array(one)) if cases is None else cases.when(F.col("fact") == fact, F.array(one))
    by_fact: dict[str, list[Column]] = {}
    for fact, found in pdf_rules():
        by_fact.setdefault(fact, []).append(F.coalesce(found, empty))
    for fact, found in by_fact.items():
        cases = cases.when(F.col("fact") == fact, F.concat(*found))
    part = F.col("fact") == "part"
    for which, found in office_rules():
        cases = cases.when(part & which, found)
    rules = cases.otherwise(empty)
    wanted = [*image_rules(), *by_fact, "part"]
    return exploded(facts.where(F.col("fact").isin(wanted)), "file_id", "seq", found=rules)


def type_columns(facts: DataFrame) -> DataFrame:
    """file_id, name, length, claimed_mime, sha256, type_name, kind, label, mime, extension, mismatch, error."""
    of = lambda fact, column: F.max(F.when(F.col("fact") == fact, F.col(column)))
    rows = facts.where("fact in ('file', 'type')").groupBy("file_id").agg(
        of("file", "path").alias("name"), of("file", "key").alias("claimed_mime"), of("file", "n").alias("length"), of("file", "value").alias("sha256"), of("type", "key").alias("type_name"), of("type", "value").alias("error")
    )
    spec = lambda at: F.create_map(*[F.lit(x) for k, v in dims.TYPES.items() for x in (k, v[at])])[F.col("type_name")]
    allowed = F.create_map(*[x for k, v in dims.TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v[3])).cast("array<string>"))])[F.col("type_name")]
    ext = tx.extension(F.col("name"))
    rows = rows.select("*", spec(0).alias("kind"), spec(1).alias("own_mime"), spec(2).alias("label"), ext.alias("extension"), ((ext == "") | F.array_contains(allowed, ext)).alias("ext_ok"))
    by_name = tx.mime_of(F.col("name"))
    mime = F.when(F.col("ext_ok") & (by_name != dims.OCTETS), by_name).otherwise(F.col("own_mime"))
    claimed = F.col("claimed_mime")
    fits = claimed.isin(dims.OCTETS, "") | (claimed == F.col("own_mime")) | (claimed == mime)
    return rows.select("file_id", "name", "length", "claimed_mime", "sha256", "type_name", "kind", "label", mime.alias("mime"), "extension", (~F.col("ext_ok") | ~fits).alias("mismatch"), "error")


def dispatch_findings(types: DataFrame) -> DataFrame:
    shown = F.concat(F.lit("Detected "), F.col("label"), F.lit("; extension ."), F.coalesce(tx.null_if_empty(F.col("extension")), F.lit("(none)")), F.lit("; claimed "), F.col("claimed_mime"))
    empty = F.array().cast(f"array<struct<{as_ddl()}>>")
    bad = F.col("error").isNotNull()
    rules = [
        some(F.col("mismatch"), finding(0, "compatibility", "medium", "File type mismatch", shown, "File header", "Name or claimed type and content differ.")),
        some(bad, finding(1, "integrity", "critical", "Invalid or unsafe ZIP package", F.col("error"), "ZIP central directory", "The archive can't be opened safely; nothing in it was looked at.")),
        some((F.col("kind") == "zip") & ~bad, finding(2, "compatibility", "info", "Generic ZIP archive", None, "ZIP package", "Only Office packages are looked into.")),
        some(F.col("kind") == "unknown", finding(3, "compatibility", "info", "Unsupported file type", None, "File header", "JPEG, PNG, WebP, PDF, DOCX, XLSX and PPTX files are supported.")),
    ]
    return exploded(types, "file_id", F.lit(-1).alias("seq"), found=F.concat(*[F.coalesce(r, empty) for r in rules]))


def file_findings(facts: DataFrame, types: DataFrame) -> DataFrame:
    """Findings that need several facts of a file. A file's parts are bounded by the archive limits."""
    named = types.select("file_id", F.col("name").alias("file_name"), "type_name")
    rows = facts.where("fact in ('entry', 'part', 'provenance', 'invisible')").join(named, "file_id")
    entry, part, name = F.col("fact") == "entry", F.col("fact") == "part", F.col("path")
    real = entry & ~name.endswith("/")
    names = lambda c: F.array_sort(F.collect_list(F.when(c, F.struct("seq", "path"))))
    plain = lambda c: F.transform(c, lambda x: x["path"])
    total = lambda c, v: F.sum(F.when(c, v).otherwise(0))
    discussion = name.rlike(r"(?i)(?:^|/)(?:comments|threadedComments|persons)\d*\.xml$|word/(?:commentsExtended|commentsIds|people)\.xml$")
    invisible_ = F.col("fact") == "invisible"
    authors = F.regexp_extract_all(F.col("value"), F.lit(r"""(?i)author=["']([^"']+)["']"""), F.lit(1))
    one = rows.groupBy("file_id", "file_name", "type_name").agg(
        total(entry & (F.col("key") == "encrypted"), 1).alias("encrypted"),
        names(entry & discussion).alias("talk"),
        F.array_sort(F.collect_list(F.when(part & discussion, F.struct("seq", tx.count_matches(F.col("value"), r"(?i)<(?:w:comment|comment|threadedComment)(?![A-Za-z0-9_])").alias("n"), authors.alias("authors"))))).alias("talks"),
        total(real & name.startswith("customXml/"), 1).alias("custom"),
        names(entry & name.rlike(r"(?i)^docProps/thumbnail\.")).alias("thumbs"),
        names(real & name.rlike(r"(?i)/(?:embeddings|objects)/")).alias("embedded"),
        names(entry & name.rlike(r"(?i)vbaProject|vbaData|activeX|\.bin$")).alias("macros"),
        total(real & name.startswith("_xmlsignatures/"), 1).alias("signatures"),
        (total(part & (name == "word/document.xml"), tx.count_matches(F.col("value"), r"(?i)<w:(?:ins|del|moveFrom|moveTo)(?![A-Za-z0-9_])")) + total(part & (name == "word/settings.xml"), tx.count_matches(F.col("value"), r"(?i)<w:trackRevisions(?![A-Za-z0-9_])"))).alias("tracked"),
        names(real & name.startswith("xl/externalLinks/")).alias("books"),
        names(part & name.rlike(r"(?i)^ppt/slides/slide\d+\.xml$") & F.col("value").rlike(r"""(?i)(?<![A-Za-z0-9_])show=["']0["']""")).alias("slides"),
        total(entry & name.rlike(r"(?i)^ppt/notesSlides/notesSlide\d+\.xml$"), 1).alias("notes"),
        total(invisible_ & (F.col("key") == "zero_width"), F.col("n")).alias("zero"), total(invisible_ & (F.col("key") == "bidi"), F.col("n")).alias("bidi"),
        names(invisible_).alias("affected"),
        F.max(F.when(F.col("fact") == "provenance", F.col("path"))).alias("provenance"),
    )
    kind, office = F.col("type_name"), F.col("type_name").isin("docx", "xlsx", "pptx")
    head = lambda c, n: F.array_join(F.slice(F.array_distinct(plain(F.col(c))), 1, n), ", ")
    joined = lambda c: F.array_join(plain(F.col(c)), ", ")
    counted = lambda c, words: F.concat(F.col(c).cast("string"), F.lit(words))
    talks = F.slice(F.col("talks"), 1, 20)
    records = F.aggregate(F.transform(talks, lambda t: t["n"]), F.lit(0), lambda a, b: a + b)
    people = F.array_join(F.array_distinct(F.flatten(F.transform(talks, lambda t: t["authors"]))), ", ")
    talk = F.concat(F.when(records > 0, records).otherwise(F.size("talk")).cast("string"), F.lit(" comment records"), F.when(people != "", F.concat(F.lit(" · authors: "), people)).otherwise(""))
    word = kind == "docx"
    macro = (F.size("macros") > 0) | F.col("file_name").rlike(r"(?i)\.(?:docm|xlsm|pptm)$")
    invisible = lambda c, words: F.concat(F.col(c).cast("string"), F.lit(words), head("affected", 8))
    rules = [
        some(office & (F.col("encrypted") > 0), finding(50, "structure", "high", "Encrypted package entries", counted("encrypted", " encrypted entries"), "OOXML package", "Some parts are encrypted and weren't looked at.")),
        some(F.size("talk") > 0, finding(55, "collaboration", "high", "Comments and reviewer identities", talk, joined("talk"), "Comments, or names of people who made them.", "Remove comments from a copy before sharing it.", F.when(word, COMMENTS))),
        some(F.col("custom") > 0, finding(56, "structure", "medium", "Custom XML data", counted("custom", " custom XML parts"), "customXml/", "Data of a workflow that pages don't show.", "Remove it if nothing in the document is bound to it.", CUSTOM)),
        some(F.size("thumbs") > 0, finding(57, "privacy", "low", "Cached document thumbnail", joined("thumbs"), "docProps/", "A picture of an earlier state.", action=THUMBNAIL)),
        some(F.size("embedded") > 0, finding(58, "embedded", "high", "Embedded files or OLE objects", head("embedded", 12), "OOXML package", "Other files are stored inside.", "Look at them in a sandbox; remove what isn't needed.")),
        some(office & macro, finding(59, "active", "critical", "Macros or ActiveX content", F.coalesce(tx.null_if_empty(head("macros", 12)), F.lit("Macro-enabled file extension")), "OOXML package", "Code that Office can run.", "Keep macros off unless you trust their source.")),
        some(F.col("signatures") > 0, finding(60, "integrity", "info", "Office digital signature", counted("signatures", " signature parts"), "_xmlsignatures/", "Signed; any change makes the signature invalid.")),
        some(word & (F.col("tracked") > 0), finding(63, "collaboration", "high", "Tracked revisions", counted("tracked", " revision markers"), "word/document.xml / word/settings.xml", "Inserted, deleted or moved text is still there.", "Accept all changes in a copy.", CHANGES)),
        some((kind == "xlsx") & (F.size("books") > 0), finding(67, "external", "high", "External workbook link parts", joined("books"), "xl/externalLinks/", "Links to another workbook, or what was copied from it.")),
        some((kind == "pptx") & (F.size("slides") > 0), finding(68, "structure", "medium", "Hidden presentation slides", joined("slides"), "ppt/slides/", "Slides that a reader can show again.")),
        some((kind == "pptx") & (F.col("notes") > 0), finding(69, "collaboration", "medium", "Presenter notes", counted("notes", " notes slides"), "ppt/notesSlides/", "Notes that a show doesn't display.")),
        some(F.col("bidi") > 0, finding(70, "active", "high", "Bidirectional control characters", invisible("bidi", " controls in "), "OOXML text parts", "Text may read otherwise than it is stored.")),
        some(F.col("zero") > 0, finding(71, "structure", "medium", "Zero-width Unicode characters", invisible("zero", " characters in "), "OOXML text parts", "Invisible characters can mark copies or hide words.")),
        some(F.col("provenance").isNotNull(), finding(72, "provenance", "info", "Content Credentials data detected", None, F.col("provenance"), "A provenance manifest seems to be inside.", F.when(kind != "webp", "Keep it unless you want an unsigned copy."))),
    ]
    empty = F.array().cast(f"array<struct<{as_ddl()}>>")
    return exploded(one, "file_id", F.lit(1_000_000).alias("seq"), found=F.concat(*[F.coalesce(r, empty) for r in rules]))
