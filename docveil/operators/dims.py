"""Dimension tables of the inspection rules.

Fixed values: severities with weights and ranks, categories, levels, file types, tags and labels of file formats.
"""

WEIGHT = {"critical": 28, "high": 16, "medium": 8, "low": 3, "info": 0}
RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
LEVEL_RANK = {"clear": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}

CATEGORY_LABEL = {
    "identity": "Identity", "location": "Location", "collaboration": "Collaboration", "external": "External connections", "embedded": "Embedded content",
    "active": "Active content", "provenance": "Provenance", "structure": "Structure", "privacy": "Privacy", "integrity": "Integrity", "compatibility": "Compatibility",
}

OCTETS = "application/octet-stream"
_OFFICE = "application/vnd.openxmlformats-officedocument."
MIME = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "pdf": "application/pdf",
    "docx": _OFFICE + "wordprocessingml.document", "docm": "application/vnd.ms-word.document.macroEnabled.12",
    "xlsx": _OFFICE + "spreadsheetml.sheet", "xlsm": "application/vnd.ms-excel.sheet.macroEnabled.12",
    "pptx": _OFFICE + "presentationml.presentation", "pptm": "application/vnd.ms-powerpoint.presentation.macroEnabled.12",
}

#: name: (kind, MIME type, label, extensions)
TYPES = {
    "jpeg": ("jpeg", MIME["jpeg"], "JPEG image", ["jpg", "jpeg"]),
    "png": ("png", MIME["png"], "PNG image", ["png"]),
    "webp": ("webp", MIME["webp"], "WebP image", ["webp"]),
    "pdf": ("pdf", MIME["pdf"], "PDF document", ["pdf"]),
    "docx": ("ooxml", MIME["docx"], "Word document", ["docx", "docm"]),
    "xlsx": ("ooxml", MIME["xlsx"], "Excel workbook", ["xlsx", "xlsm"]),
    "pptx": ("ooxml", MIME["pptx"], "PowerPoint presentation", ["pptx", "pptm"]),
    "zip": ("zip", "application/zip", "ZIP archive", ["zip"]),
    "unknown": ("unknown", OCTETS, "Unknown file", []),
}

TIFF_TAGS = {
    0x010E: ("Image description", "description"), 0x010F: ("Camera make", "make"), 0x0110: ("Camera model", "model"), 0x0131: ("Editing software", "software"),
    0x0132: ("Modified time", "datetime"), 0x013B: ("Artist", "artist"), 0x8298: ("Copyright", "copyright"), 0x9003: ("Original capture time", "dateTimeOriginal"),
    0x9004: ("Digitized time", "dateTimeDigitized"), 0x9286: ("User comment", "userComment"), 0xA420: ("Image unique ID", "imageUniqueId"), 0xA430: ("Camera owner", "cameraOwner"),
    0xA431: ("Camera body serial", "bodySerial"), 0xA434: ("Lens model", "lensModel"), 0xA435: ("Lens serial", "lensSerial"),
}
TIFF_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}

RELATION_LABEL = {
    "hyperlink": "External hyperlink", "image": "Externally linked image", "attachedTemplate": "External document template", "externalLink": "External workbook data link",
    "oleObject": "External OLE object", "package": "External package", "audio": "Externally linked audio", "video": "Externally linked video",
}

#: (element, title, category, severity) of docProps/core.xml and docProps/app.xml
CORE_PROPERTIES = [
    ("dc:creator", "Document author", "identity", "medium"), ("cp:lastModifiedBy", "Last editor", "identity", "medium"), ("cp:keywords", "Document keywords", "privacy", "low"),
    ("dc:subject", "Document subject", "privacy", "low"), ("cp:category", "Document category", "privacy", "low"), ("dcterms:created", "Created time", "privacy", "low"),
    ("dcterms:modified", "Modified time", "privacy", "low"), ("cp:lastPrinted", "Last printed time", "privacy", "low"),
]
APP_PROPERTIES = [
    ("Company", "Company name", "identity", "medium"), ("Manager", "Manager name", "identity", "medium"), ("Template", "Document template", "privacy", "low"),
    ("Application", "Creating application", "privacy", "low"), ("AppVersion", "Application version", "privacy", "low"), ("HyperlinkBase", "Hyperlink base", "external", "medium"),
]
CLEANED_CORE = ["dc:creator", "cp:lastModifiedBy", "cp:keywords", "cp:category", "cp:contentStatus", "cp:lastPrinted", "cp:revision", "dcterms:created", "dcterms:modified"]
CLEANED_APP = ["Company", "Manager", "Template", "Application", "AppVersion", "TotalTime", "HyperlinkBase"]

#: id: (label, on by default, destructive)
ACTIONS = {
    "image-metadata": ("Remove image metadata", True, False),
    "office-properties": ("Remove author and application properties", True, False),
    "office-comments": ("Remove Word comments and reviewers", True, True),
    "office-thumbnail": ("Remove the cached thumbnail", True, False),
    "office-customxml": ("Remove custom properties and custom XML", False, True),
    "office-external-links": ("Neutralize external targets", False, True),
    "office-accept-changes": ("Accept tracked changes", False, True),
}

REMOVED_TARGET = "https://docveil.invalid/removed"

# Limits that change results
MAX_FILE = 300 << 20
ZIP_ENTRIES, ZIP_TOTAL, ZIP_ENTRY, ZIP_RATIO = 10_000, 350 << 20, 120 << 20, 500
TEXT_METADATA = 4 << 20
PDF_STREAMS, PDF_STREAM_BYTES, PDF_DICTIONARY = 80, 32 << 20, 16_000
EVIDENCE = 360
