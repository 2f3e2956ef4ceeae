"""ELF headers and content types from bytes."""

from __future__ import annotations

import struct

ELF_MAGIC = b"\x7fELF"
# Names of the ELF header's numbers.
CLASSES = {1: "ELFCLASS32", 2: "ELFCLASS64"}
ORDERS = {1: "ELFDATA2LSB", 2: "ELFDATA2MSB"}
TYPES = {0: "ET_NONE", 1: "ET_REL", 2: "ET_EXEC", 3: "ET_DYN", 4: "ET_CORE"}
MACHINES = {0: "EM_NONE", 2: "EM_SPARC", 3: "EM_386", 8: "EM_MIPS", 20: "EM_PPC", 21: "EM_PPC64", 22: "EM_S390", 40: "EM_ARM", 43: "EM_SPARCV9", 62: "EM_X86_64", 183: "EM_AARCH64", 243: "EM_RISCV", 258: "EM_LOONGARCH"}
#: First bytes that name a content type.
SIGNATURES = (
    (b"%PDF-", "application/pdf"),
    (b"%!PS-Adobe-", "application/postscript"),
    (b"\xef\xbb\xbf", "text/plain; charset=utf-8"),
    (b"\xfe\xff", "text/plain; charset=utf-16be"),
    (b"\xff\xfe", "text/plain; charset=utf-16le"),
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"GIF87a", "image/gif"),
    (b"GIF89a", "image/gif"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"BM", "image/bmp"),
    (b"\x00\x00\x01\x00", "image/x-icon"),
    (b"OggS\x00", "application/ogg"),
    (b"\x1f\x8b\x08", "application/x-gzip"),
    (b"PK\x03\x04", "application/zip"),
    (b"\x00asm", "application/wasm"),
    (b"wOF2", "font/woff2"),
    (b"wOFF", "font/woff"),
)
MARKUP = (b"<!DOCTYPE HTML", b"<HTML", b"<HEAD", b"<SCRIPT", b"<IFRAME", b"<H1", b"<DIV", b"<FONT", b"<TABLE", b"<A", b"<STYLE", b"<TITLE", b"<B", b"<BODY", b"<BR", b"<P", b"<!--")


def content_type(data: bytes) -> str:
    """By the first 512 bytes; text unless they hold bytes that text has not."""
    head = data[:512]
    if head.startswith(ELF_MAGIC):
        return "application/x-elf"
    bare = head.lstrip(b"\t\n\x0c\r ")
    for tag in MARKUP:
        if bare[: len(tag)].upper() == tag and (tag == b"<!--" or bare[len(tag) : len(tag) + 1] in (b" ", b">")):
            return "text/html; charset=utf-8"
    if bare.startswith(b"<?xml"):
        return "text/xml; charset=utf-8"
    for signature, name in SIGNATURES:
        if head.startswith(signature):
            return name
    if head[:4] == b"RIFF" and head[8:14] == b"WEBPVP":
        return "image/webp"
    binary = any(b <= 0x08 or b == 0x0B or 0x0E <= b <= 0x1A or 0x1C <= b <= 0x1F for b in head)
    return "application/octet-stream" if binary else "text/plain; charset=utf-8"


def elf(data: bytes) -> dict | None:
    """Class, order, machine, type, interpreter, sorted libraries and whether there are symbols; None
    where the headers can't be read. What is not established is empty, never missing."""
    try:
        wide, little = data[4], data[5]
        if not data.startswith(ELF_MAGIC) or wide not in CLASSES or little not in ORDERS or data[6] != 1:
            return None
        o = "<" if little == 1 else ">"
        kind, machine = struct.unpack_from(o + "HH", data, 16)
        if wide == 2:
            phoff, shoff = struct.unpack_from(o + "QQ", data, 32)
            phsize, phnum, shsize, shnum = struct.unpack_from(o + "HHHH", data, 54)
        else:
            phoff, shoff = struct.unpack_from(o + "II", data, 28)
            phsize, phnum, shsize, shnum = struct.unpack_from(o + "HHHH", data, 42)
        interpreter = ""
        for i in range(phnum):
            at = phoff + i * phsize
            if wide == 2:
                what, _, off, _, _, size = struct.unpack_from(o + "IIQQQQ", data, at)
            else:
                what, off, _, _, size = struct.unpack_from(o + "IIIII", data, at)
            if what == 3:  # PT_INTERP
                if 1 <= size <= 4096 and off + size <= len(data):
                    interpreter = data[off : off + size].rstrip(b"\0").decode("utf-8", "replace")
                break
        sections = []
        for i in range(shnum if shoff else 0):
            at = shoff + i * shsize
            if wide == 2:
                _, what, _, _, off, size, link = struct.unpack_from(o + "IIQQQQI", data, at)
            else:
                _, what, _, _, off, size, link = struct.unpack_from(o + "IIIIIII", data, at)
            sections.append((what, off, size, link))
        libraries = []
        for what, off, size, link in sections:
            if what == 6 and link < len(sections):  # SHT_DYNAMIC
                names = data[sections[link][1] : sections[link][1] + sections[link][2]]
                step, form = (16, "qQ") if wide == 2 else (8, "iI")
                for at in range(off, min(off + size, len(data) - step + 1), step):
                    tag, value = struct.unpack_from(o + form, data, at)
                    if tag == 0:
                        break
                    if tag == 1:  # DT_NEEDED
                        libraries.append(names[value:].partition(b"\0")[0].decode("utf-8", "replace"))
    except (struct.error, IndexError):
        return None
    return {
        "format": "ELF",
        "class": CLASSES[wide],
        "byte_order": ORDERS[little],
        "machine": MACHINES.get(machine, str(machine)),
        "type": TYPES.get(kind, str(kind)),
        "interpreter": interpreter,
        "libraries": sorted(libraries),
        "imported_symbols": [],
        "extracted_strings": [],
        "embedded_urls": [],
        "file_capabilities": [],
        "capability_effective": False,
        "setuid": False,
        "setgid": False,
        "has_symbols": any(what == 2 and size > 0 for what, _, size, _ in sections),
    }
