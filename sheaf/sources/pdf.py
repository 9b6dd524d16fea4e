"""Texts of the pages of PDF files, as far as they can be read without a font library.

Objects are found by their headers, streams are inflated, and a page's text is what its content streams show with the
operators ' " Tj TJ, through the font's ToUnicode map where there is one and as Latin-1 otherwise.  Pages whose text is
empty or reads as codes are reported as unreadable; encrypted and damaged files give nothing.
"""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

MOST_STREAM = 16 * 1024 * 1024
_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s\[\]()<>/]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|.|\n)", re.S)
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b""}
SCHEMA = "struct<content string, pages array<struct<page int, start_offset bigint, end_offset bigint>>, unreadable_pages array<int>>"


class Broken(Exception):
    """A file that is no readable PDF."""


def _inflated(body: bytes) -> bytes:
    m = _STREAM.search(body)
    if not m:
        return b""
    if b"/FlateDecode" not in body[: m.start()]:
        return m[1] if b"/Filter" not in body[: m.start()] else b""
    work = zlib.decompressobj()
    try:
        data = work.decompress(m[1], MOST_STREAM)
    except zlib.error:
        return b""
    return b"" if work.unconsumed_tail else data


def _objects(data: bytes) -> dict[int, bytes]:
    found = {int(n): body for n, _, body in _OBJECT.findall(data)}
    for body in list(found.values()):
        if b"/ObjStm" in body:
            inner = _inflated(body)
            first = re.search(rb"/First\s+(\d+)", body)
            if inner and first:
                numbers = [int(x) for x in inner[: int(first[1])].split()]
                at = [int(first[1]) + x for x in numbers[1::2]] + [len(inner)]
                for n, a, b in zip(numbers[::2], at, at[1:]):
                    found.setdefault(n, inner[a:b])
    return found


def _refs(body: bytes, name: bytes) -> list[int]:
    m = re.search(rb"/" + name + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(x) for x in _REF.findall(m[1])] if m else []


def _pages(objects: dict[int, bytes]) -> list[int]:
    """Numbers of the page objects, in reading order where there is a page tree."""
    roots = [n for n, b in objects.items() if re.search(rb"/Type\s*/Pages\b", b) and not re.search(rb"/Parent\b", b)]
    order: list[int] = []
    stack, seen = list(reversed(roots)), set()
    while stack:
        n = stack.pop()
        if n in seen or n not in objects:
            continue
        seen.add(n)
        if re.search(rb"/Type\s*/Page\b", objects[n]):
            order.append(n)
        stack.extend(reversed(_refs(objects[n], b"Kids")))
    return order or sorted(n for n, b in objects.items() if re.search(rb"/Type\s*/Page\b", b))


def _unicode_map(cmap: bytes) -> dict[int, str]:
    def text(code: bytes) -> str:
        return bytes.fromhex(re.sub(rb"\s", b"", code).decode()).decode("utf-16-be", "replace")

    out: dict[int, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f\s]+)>", block):
            out[int(a, 16)] = text(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            for k in range(int(a, 16), min(int(b, 16), int(a, 16) + 65535) + 1):
                base = text(c)
                out[k] = base[:-1] + chr(ord(base[-1]) + k - int(a, 16)) if base else ""
    return out


def _fonts(page: bytes, objects: dict[int, bytes]) -> dict[bytes, tuple[dict[int, str], int]]:
    """Per font name of a page its map of codes and the bytes of a code."""
    resources = page
    for n in _refs(page, b"Resources"):
        resources += objects.get(n, b"")
    m = re.search(rb"/Font\s*<<(.*?)>>", resources, re.S)
    listed = m[1] if m else b"".join(objects.get(n, b"") for n in _refs(resources, b"Font"))
    fonts = {}
    for name, n in re.findall(rb"(/[^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", listed):
        font = objects.get(int(n), b"")
        maps = [_unicode_map(_inflated(objects.get(x, b""))) for x in _refs(font, b"ToUnicode")]
        fonts[name] = (maps[0] if maps else {}, 2 if b"/Type0" in font else 1)
    return fonts


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def plain(m) -> bytes:
        c = m[1]
        return bytes([int(c, 8) & 255]) if c[:1] in b"01234567" else _PLAIN.get(c, c)

    return _ESCAPE.sub(plain, token[1:-1])


def _shown(content: bytes, fonts: dict) -> str:
    out: list[str] = []
    stack: list[bytes] = []
    table, width = {}, 1

    def show(token: bytes) -> None:
        raw = _string(token)
        if table:
            out.append("".join(table.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width)))
        else:
            out.append(raw.decode("latin-1") if width == 1 else "")

    for t in _TOKEN.findall(content):
        c = t[:1]
        if c in b"(<[]/" or c.isdigit() or c in b"+-.":
            stack.append(t)
            continue
        strings = [x for x in stack if x[:1] in (b"(", b"<")]
        if t == b"Tf":
            name = next((x for x in reversed(stack) if x[:1] == b"/"), b"")
            table, width = fonts.get(name, ({}, 1))
        elif t in (b"Tj", b"'", b'"') and strings:
            if t != b"Tj":
                out.append("\n")
            show(strings[-1])
        elif t == b"TJ":
            for x in stack:
                if x[:1] in (b"(", b"<"):
                    show(x)
                elif re.fullmatch(rb"-\d*\.?\d+", x) and float(x) < -200:
                    out.append(" ")
        elif t in (b"T*", b"Td", b"TD", b"Tm", b"ET"):
            if t in (b"T*", b"ET") or (t == b"Tm") or (len(stack) > 1 and stack[-1].strip(b"+-0.") != b""):
                out.append("\n")
        stack = []
    lines = (re.sub(r"[^\S\n]+", " ", line).strip() for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def page_texts(data: bytes) -> list[str]:
    """The text of every page of a PDF, '' where there is none; Broken for files that are encrypted or no PDF."""
    if not data.startswith(b"%PDF-") or b"/Encrypt" in data:
        raise Broken
    objects = _objects(data)
    pages = _pages(objects)
    if not pages:
        raise Broken
    return [_shown(b"\n".join(_inflated(objects.get(n, b"")) for n in _refs(objects[p], b"Contents")), _fonts(objects[p], objects)) for p in pages]


def _reads(text: str) -> bool:
    """Whether a page reads as language: mostly letters, digits, space and common signs."""
    seen = [c for c in text if not c.isspace()]
    return bool(seen) and sum(c.isalnum() or 32 < ord(c) < 127 or c in "–—‘’“”…•₱°" for c in seen) >= 0.75 * len(seen)


def extract(data: bytes | None) -> tuple | None:
    """(content, pages, unreadable pages): readable pages joined by a blank line, with the byte range of each."""
    if data is None:
        return None
    try:
        texts = page_texts(bytes(data))
    except (Broken, ValueError, RecursionError):
        return None
    content, ranges, skipped, at = [], [], [], 0
    for n, text in enumerate(texts, 1):
        if not _reads(text):
            skipped.append(n)
            continue
        at += 2 if content else 0
        size = len(text.encode())
        content.append(text)
        ranges.append((n, at, at + size))
        at += size
    return ("\n\n".join(content), ranges, skipped) if content else (None, [], skipped)


def with_pages(files: DataFrame, data: str, name: str) -> DataFrame:
    """`files` with a struct of content, pages and unreadable_pages for what column `data` holds; null for null and for what is no readable PDF.

    Files without data never leave the JVM as more than a null.
    """
    @F.pandas_udf(SCHEMA)
    def read(files_: pd.Series) -> pd.DataFrame:
        got = [extract(x) or (None, None, None) for x in files_]
        pages = [None if p is None else [{"page": n, "start_offset": a, "end_offset": b} for n, a, b in p] for _, p, _ in got]
        return pd.DataFrame({"content": [g[0] for g in got], "pages": pages, "unreadable_pages": [g[2] for g in got]}, dtype=object)

    return files.withColumn(name, read(F.col(data)))
