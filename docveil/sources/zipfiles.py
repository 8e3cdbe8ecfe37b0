"""ZIP packages: a strict directory reader with limits, and a deterministic writer of stored entries."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

from docveil.operators import dims

END, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04"
END_SEARCH = 65_557


class ZipError(Exception):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Entry:
    name: str
    flags: int
    method: int
    crc: int
    packed: int
    size: int
    at: int
    directory: bool

    @property
    def encrypted(self) -> bool:
        return bool(self.flags & 1)


def decode_utf8(b: bytes) -> str:
    return b.decode("utf-8", "replace").removeprefix("\ufeff")


def unsafe(name: str) -> bool:
    return not name or name.startswith("/") or "\0" in name or ".." in name.split("/")


def inflate(data: bytes, most: int, raw: bool = True) -> bytes | None:
    """At most ``most`` bytes; None if there are more. Raises zlib.error on bad or unended data."""
    return inflate_first(data, most, raw)[0]


def inflate_first(data: bytes, most: int, raw: bool = True) -> tuple[bytes | None, bytes]:
    """The same, and what stands behind the stream's end."""
    stream = zlib.decompressobj(-15 if raw else 15)
    out = stream.decompress(data, most + 1)
    if len(out) > most:
        return None, b""
    if not stream.eof:
        raise zlib.error("the stream does not end")
    return out, stream.unused_data


class Archive:
    """Directory of a package; parts are inflated when asked for."""

    def __init__(self, data: bytes, entries: int = dims.ZIP_ENTRIES, total: int = dims.ZIP_TOTAL, entry: int = dims.ZIP_ENTRY, ratio: int = dims.ZIP_RATIO) -> None:
        self.data, self.entry_limit = data, entry
        end = data.rfind(END, max(0, len(data) - END_SEARCH), max(0, len(data) - 22 + 4))
        if end < 0 or len(data) < 22:
            raise ZipError("INVALID_ZIP", "End of central directory was not found.")
        disk, central_disk, here, count, size, at = struct.unpack_from("<4H2I", data, end + 4)
        if disk or central_disk or here != count:
            raise ZipError("MULTI_DISK", "Multi-disk ZIP archives are not supported.")
        if count > entries:
            raise ZipError("TOO_MANY_ENTRIES", f"Archive contains too many entries ({count}).")
        if at + size > len(data):
            raise ZipError("INVALID_ZIP", "Central directory points outside the file.")
        self.entries: dict[str, Entry] = {}
        held = 0
        for _ in range(count):
            new, at = self._record(at)
            if unsafe(new.name):
                raise ZipError("ZIP_SLIP", f"Unsafe archive path: {new.name or '(empty)'}")
            if new.name in self.entries:
                raise ZipError("DUPLICATE_ENTRY", f"Duplicate archive path: {new.name}")
            held += new.size
            if new.size > entry or held > total:
                raise ZipError("ZIP_BOMB", "Archive expands beyond the configured safety limit.")
            if new.packed and new.size > 1 << 20 and new.size > ratio * new.packed:
                raise ZipError("ZIP_BOMB", f"Suspicious compression ratio in {new.name}.")
            self.entries[new.name] = self._located(new)

    def _record(self, at: int) -> tuple[Entry, int]:
        data = self.data
        if data[at : at + 4] != CENTRAL:
            raise ZipError("INVALID_ZIP", "Invalid central directory entry.")
        if at + 46 > len(data):
            raise ZipError("INVALID_ZIP", "Truncated central directory.")
        flags, method, _, crc, packed, size, n, extra, comment, _, _, attributes, local = struct.unpack_from("<2HI3I5H2I", data, at + 8)
        after = at + 46 + n + extra + comment
        if after > len(data):
            raise ZipError("INVALID_ZIP", "Truncated central directory.")
        name = decode_utf8(data[at + 46 : at + 46 + n]).replace("\\", "/")
        return Entry(name, flags, method, crc, packed, size, local, name.endswith("/") or bool(attributes & 0x10)), after

    def _located(self, e: Entry) -> Entry:
        if e.at + 30 > len(self.data) or self.data[e.at : e.at + 4] != LOCAL:
            raise ZipError("INVALID_ZIP", f"Invalid local header for {e.name}.")
        n, extra = struct.unpack_from("<2H", self.data, e.at + 26)
        start = e.at + 30 + n + extra
        if start + e.packed > len(self.data):
            raise ZipError("INVALID_ZIP", f"Truncated archive entry: {e.name}")
        return Entry(e.name, e.flags, e.method, e.crc, e.packed, e.size, start, e.directory)

    def read(self, name: str) -> bytes | None:
        e = self.entries.get(name)
        if e is None:
            return None
        if e.directory:
            return b""
        if e.encrypted:
            raise ZipError("ENCRYPTED", f"Encrypted entry cannot be read: {name}")
        packed = self.data[e.at : e.at + e.packed]
        if e.method == 8:
            try:
                out = inflate(packed, min(e.size, self.entry_limit))
            except zlib.error as x:
                raise ZipError("INVALID_ZIP", f"Archive entry could not be decompressed: {x}") from x
            if out is None:
                raise ZipError("ZIP_BOMB", "Archive entry expands beyond its declared or configured limit.")
        elif e.method == 0:
            out = packed
        else:
            raise ZipError("UNSUPPORTED_COMPRESSION", f"Unsupported compression method {e.method}.")
        if len(out) != e.size:
            raise ZipError("INVALID_ZIP", f"Size mismatch while reading {name}.")
        if zlib.crc32(out) != e.crc:
            raise ZipError("INVALID_ZIP", f"CRC mismatch while reading {name}.")
        return out

    def text(self, name: str) -> str | None:
        """A part's text; None if it isn't there or can't be read."""
        try:
            b = self.read(name)
        except ZipError:
            return None
        return None if b is None else decode_utf8(b)


def dos_time(year: int, month: int, day: int, hour: int = 0, minute: int = 0, second: int = 0) -> tuple[int, int]:
    return hour << 11 | minute << 5 | second // 2, (min(max(year, 1980), 2107) - 1980) << 9 | month << 5 | day


def build(parts: list[tuple[str, bytes]], when: tuple = (2026, 1, 1)) -> bytes:
    """A package of stored entries in the given order; equal parts give equal bytes."""
    time, date = dos_time(*when)
    seen: set[str] = set()
    body, directory = bytearray(), bytearray()
    for name, data in parts:
        name = name.replace("\\", "/")
        if unsafe(name):
            raise ZipError("ZIP_SLIP", f"Unsafe output archive path: {name or '(empty)'}")
        if name in seen:
            raise ZipError("DUPLICATE_ENTRY", f"Duplicate output archive path: {name}")
        seen.add(name)
        raw = name.encode()
        common = struct.pack("<4H3I2H", 0x800, 0, time, date, zlib.crc32(data), len(data), len(data), len(raw), 0)
        directory += CENTRAL + struct.pack("<2H", 0x314, 20) + common + struct.pack("<3H2I", 0, 0, 0, 0x10 if name.endswith("/") else 0, len(body)) + raw
        body += LOCAL + struct.pack("<H", 20) + common + raw + data
    n = len(seen)
    return bytes(body + directory + END + struct.pack("<4H2IH", 0, 0, n, n, len(directory), len(body), 0))
