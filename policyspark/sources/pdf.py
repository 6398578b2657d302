"""PDF without a library: a plain writer, and a reader of text for documents whose fonts are simple."""

from __future__ import annotations

import re
import textwrap
import zlib
from collections.abc import Iterator

WIDE, HIGH, LEFT, TOP, STEP, LINES = 595, 842, 56, 780, 16, 44


def _escaped(text: str) -> bytes:
    return text.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")


def render(blocks: list[tuple[str, str]], title: str) -> bytes:
    """A PDF of (kind, text) blocks, kind heading or paragraph: the same bytes for the same blocks.

    Headings are bold and larger, every page has a running title and its number. ValueError names
    characters that the standard fonts don't have; nothing is ever written as something else.
    """
    text = "".join(t for _, t in blocks) + title
    lost = sorted({c for c in text if c not in "\n\t" and not _has(c)})
    if lost:
        raise ValueError("no glyph for " + ", ".join(f"U+{ord(c):04X}" for c in lost[:8]))
    lines: list[tuple[str, str]] = []
    for kind, t in blocks:
        for part in t.split("\n"):
            lines += [(kind, x) for x in textwrap.wrap(part, 60 if kind == "heading" else 84) or [""]]
        lines.append(("gap", ""))
    pages = [lines[i : i + LINES] for i in range(0, len(lines), LINES)] or [[]]
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", *(f"<< /Type /Font /Subtype /Type1 /BaseFont /{f} /Encoding /WinAnsiEncoding >>".encode() for f in ("Helvetica", "Helvetica-Bold"))]
    kids = []
    for n, page in enumerate(pages, 1):
        out = [f"BT /F1 8 Tf 1 0 0 1 {LEFT} 815 Tm (".encode() + _escaped(title) + b") Tj ET"]
        for i, (kind, t) in enumerate(page):
            if t:
                font = "/F2 14" if kind == "heading" else "/F1 11"
                out.append(f"BT {font} Tf 1 0 0 1 {LEFT} {TOP - i * STEP} Tm (".encode() + _escaped(t) + b") Tj ET")
        out.append(f"BT /F1 8 Tf 1 0 0 1 {LEFT} 30 Tm (Page {n} of {len(pages)}) Tj ET".encode())
        stream = zlib.compress(b"\n".join(out), 9)
        kids.append(len(objects) + 1)
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {WIDE} {HIGH}] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents {len(objects) + 2} 0 R >>".encode())
        objects.append(f"<< /Length {len(stream)} /Filter /FlateDecode >>\nstream\n".encode() + stream + b"\nendstream")
    objects[1] = f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>".encode()
    data, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(data))
        data += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
    start = len(data)
    data += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
    return bytes(data + f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode())


def _has(c: str) -> bool:
    try:
        return c.isprintable() and bool(c.encode("cp1252"))
    except UnicodeEncodeError:
        return False


OBJECT = re.compile(rb"(\d+) \d+ obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)


def _string(token: bytes) -> str:
    if token.startswith(b"<"):
        return bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode()).decode("cp1252", "replace")
    plain = re.sub(rb"\\([nrtbf()\\]|[0-7]{1,3})", lambda m: {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(m[1]) or (bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1]), token[1:-1])
    return plain.decode("cp1252", "replace")


def spans(content: bytes) -> Iterator[tuple[int, float, float, float, bool, str]]:
    """(page from 1, x, y from the top, size, bold, text) of every shown text, as a page's commands show them.

    ValueError: not a PDF, or one that is locked. Pages without text give nothing.
    """
    if not content.startswith(b"%PDF"):
        raise ValueError("not a PDF")
    if re.search(rb"/Encrypt\b", content):
        raise ValueError("the PDF is locked by a password")
    objects = {int(n): body for n, body in OBJECT.findall(content)}
    pages = [b for b in objects.values() if re.search(rb"/Type\s*/Page\b(?!s)", b)]
    for number, page in enumerate(pages, 1):
        fonts = {}
        for name, ref in re.findall(rb"/(\w+)\s+(\d+) 0 R", page):
            base = re.search(rb"/BaseFont\s*/([^\s/>]+)", objects.get(int(ref), b""))
            if base:
                fonts[name] = b"Bold" in base[1]
        box = re.search(rb"/MediaBox\s*\[\s*[\d.]+\s+[\d.]+\s+[\d.]+\s+([\d.]+)", page)
        high = float(box[1]) if box else float(HIGH)
        refs = re.search(rb"/Contents\s*(?:\[([^\]]*)\]|(\d+) 0 R)", page)
        ids = [int(x) for x in re.findall(rb"(\d+) 0 R", refs[1])] if refs and refs[1] else [int(refs[2])] if refs else []
        x = y = 0.0
        lead, size, bold, stack = 0.0, 12.0, False, []
        for i in ids:
            m = STREAM.search(objects.get(i, b""))
            if not m:
                continue
            data = zlib.decompress(m[1]) if b"/FlateDecode" in objects[i].split(b"stream")[0] else m[1]
            for token in TOKEN.findall(data):
                if token[:1] in b"(<[]/" or re.fullmatch(rb"[-+]?\d*\.?\d+", token):
                    stack.append(token)
                    continue
                numbers = [float(t) for t in stack if re.fullmatch(rb"[-+]?\d*\.?\d+", t)]
                if token == b"Tf" and numbers:
                    names = [t[1:] for t in stack if t.startswith(b"/")]
                    size, bold = numbers[-1], fonts.get(names[-1] if names else b"", False)
                elif token == b"Tm" and len(numbers) >= 6:
                    x, y = numbers[-2], numbers[-1]
                elif token in (b"Td", b"TD") and len(numbers) >= 2:
                    x, y = x + numbers[-2], y + numbers[-1]
                    lead = -numbers[-1] if token == b"TD" else lead
                elif token == b"TL" and numbers:
                    lead = numbers[-1]
                elif token in (b"T*", b"'"):
                    y -= lead
                if token in (b"Tj", b"TJ", b"'", b'"'):
                    text = "".join(_string(t) for t in stack if t[:1] in b"(<")
                    if text.strip():
                        yield number, x, high - y, size, bold, text
                stack = []


def blocks(content: bytes) -> list[tuple[int, str, str]]:
    """(page, kind, text): lines of one font that follow each other closely are one block; ValueError where there is no text at all."""
    out: list[list] = []
    last = None
    for page, x, y, size, bold, text in spans(content):
        kind = "other" if y < 40 or y > HIGH - 60 else "heading" if bold or size > 12.5 else "paragraph"
        if last and last[0] == page and last[1] == kind != "other" and 0 < y - last[2] <= 1.6 * size and abs(x - last[3]) < 1:
            out[-1][2] += "\n" + text
        else:
            out.append([page, kind, text])
        last = (page, kind, y, x)
    if not out:
        raise ValueError("no text")
    return [tuple(b) for b in out]
