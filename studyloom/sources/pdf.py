"""Text of PDF files: objects by cross-reference table or stream, pages by the page tree, characters by each font's map.

A helper for one file; Spark reads the files and deals them over tasks.
"""

from __future__ import annotations

import re
import struct
import zlib
from binascii import unhexlify
from collections.abc import Iterator

#: Kerning, in thousandths of a font's size, that is taken for a blank.
BLANK = -180
_TOKEN = re.compile(rb"(?:[\0\t\n\f\r ]|%[^\r\n]*)*(<<|>>|[\[\]{}]|/[^\0\t\n\f\r ()<>\[\]{}/%]*|\(|<[0-9A-Fa-f\0\t\n\f\r ]*>|[^\0\t\n\f\r ()<>\[\]{}/%]+|\)|>)", re.S)
_STRING = re.compile(rb"\\(?:\r\n|.)|[()]", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_OBJECT = re.compile(rb"(?<!\d)(\d{1,10})\s+(\d{1,5})\s+obj\b")
_INTEGER, _REAL = re.compile(rb"[+-]?\d+"), re.compile(rb"[+-]?(\d+\.\d*|\.\d+)")
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


class Name(str):
    """A name such as /Type, without the slash."""


class Operator(bytes):
    """A word that is no value."""


class Ref(int):
    """The number of an object."""


class Stream:
    def __init__(self, entries: dict, raw: bytes) -> None:
        self.entries, self.raw = entries, raw


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string behind its opening bracket; brackets nest."""
    depth, start = 1, at
    while depth:
        m = _STRING.search(data, at)
        if not m:
            raise ValueError("a string has no end")
        depth, at = depth + {b"(": 1, b")": -1}.get(m[0], 0), m.end()
    raw = data[start : at - 1]
    if b"\\" not in raw:
        return raw, at
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() and m[1] < b"8" else _ESCAPED.get(m[1], m[1]), raw), at


def values(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Values and operators from ``at`` on, each with the place behind it; references are told apart from numbers."""
    stack: list[list] = []
    held: list[tuple[object, int]] = []  # numbers that may begin a reference, only outside of lists
    while m := _TOKEN.match(data, at):
        token, at = m[1], m.end()
        if token == b"R" and (stack and len(stack[-1]) >= 2 or len(held) == 2):
            if stack:
                stack[-1][-2:] = [Ref(stack[-1][-2])]
            else:
                yield Ref(held[0][0]), at
                held = []
            continue
        if held and not (token.isdigit() and len(held) < 2):
            yield from held
            held = []
        first = token[:1]
        if token in (b"<<", b"["):
            stack.append([])
            continue
        if token in (b">>", b"]"):
            if not stack:
                continue
            items = stack.pop()
            value = dict(zip(items[::2], items[1::2], strict=False)) if token == b">>" else items
        elif first == b"/":
            value = Name((re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), token) if b"#" in token else token)[1:].decode("latin-1"))
        elif token == b"(":
            value, at = _literal(data, at)
        elif first == b"<":
            digits = token.translate(None, b"<>\0\t\n\f\r ")
            value = unhexlify(digits + b"0" * (len(digits) % 2))
        elif first not in b"+-.0123456789":
            value = Operator(token)
        elif _INTEGER.fullmatch(token):
            value = int(token)
            if not stack and token.isdigit():
                held.append((value, at))
                continue
        else:
            value = float(token) if _REAL.fullmatch(token) else Operator(token)
        if stack:
            stack[-1].append(value)
        else:
            yield value, at
    yield from held


def _predicted(data: bytes, parms: dict) -> bytes:
    """Undoes the prediction of rows that cross-reference streams use."""
    if parms.get("Predictor", 1) < 10:
        return data
    bpp = max(1, parms.get("Colors", 1) * parms.get("BitsPerComponent", 8) // 8)
    width = -(-parms.get("Columns", 1) * parms.get("Colors", 1) * parms.get("BitsPerComponent", 8) // 8)
    above, out = bytes(width), []
    for k in range(0, len(data), width + 1):
        kind, row = data[k], bytearray(data[k + 1 : k + 1 + width])
        for i in range(len(row)):
            a, b, c = (row[i - bpp], above[i], above[i - bpp]) if i >= bpp else (0, above[i], 0)
            p = a + b - c
            row[i] = (row[i] + (0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2])[kind]) & 255
        above = bytes(row).ljust(width, b"\0")
        out.append(bytes(row))
    return b"".join(out)


class Document:
    """Objects of a file by number, read when they are asked for."""

    def __init__(self, data: bytes) -> None:
        if not data.startswith(b"%PDF"):
            raise ValueError("no PDF header")
        self.data, self.made = data, {}
        try:
            self.places, self.trailer = self._cross_references()
            if not isinstance(self.entry(self.get(self.trailer.get("Root")), "Pages"), dict):
                raise ValueError("no page tree")
        except (ValueError, KeyError, IndexError, TypeError, AttributeError, zlib.error):
            self.made, (self.places, self.trailer) = {}, self._scanned()
        if "Encrypt" in self.trailer:
            raise ValueError("encrypted")

    def _cross_references(self) -> tuple[dict, dict]:
        """Where each object is: ("at", offset) or ("in", object stream, index); the newest section of a file that was changed wins."""
        at = int(re.findall(rb"startxref\s+(\d+)", self.data)[-1])
        places, trailer, seen, todo = {}, {}, set(), [at]
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            if re.match(rb"\s*xref\b", self.data[at : at + 40]):
                found, own = self._table(at)
            else:
                found, own = self._section(self._at(at))
            places = found | places
            trailer = own | trailer
            todo += [own[k] for k in ("XRefStm", "Prev") if isinstance(own.get(k), int)]
        return {n: p for n, p in places.items() if p}, trailer

    def _table(self, at: int) -> tuple[dict, dict]:
        end = self.data.index(b"trailer", at)
        words, found, k = self.data[at:end].split()[1:], {}, 0
        while k < len(words):
            first, n = int(words[k]), int(words[k + 1])
            for i in range(n):
                offset, _, kind = words[k + 2 + 3 * i : k + 5 + 3 * i]
                found[first + i] = ("at", int(offset)) if kind == b"n" else None
            k += 2 + 3 * n
        return found, next(values(self.data, end + 7))[0]

    def _section(self, stream: object) -> tuple[dict, dict]:
        """A cross-reference stream: rows of three numbers whose widths it tells."""
        if not isinstance(stream, Stream) or stream.entries.get("Type") != "XRef":
            raise ValueError("no cross-reference section")
        e, data = stream.entries, self.content(stream)
        w, index = e["W"], e.get("Index", [0, e["Size"]])
        numbers = [n for a, c in zip(index[::2], index[1::2], strict=True) for n in range(a, a + c)]
        found = {}
        for n, k in zip(numbers, range(0, len(data), sum(w)), strict=False):
            kind, x, y = (int.from_bytes(data[k + sum(w[:i]) : k + sum(w[: i + 1])], "big") for i in range(3))
            found[n] = {1: ("at", x), 2: ("in", x, y)}.get(1 if w[0] == 0 else kind)
        return found, e

    def _scanned(self) -> tuple[dict, dict]:
        """Where the references are broken: all objects in the order of the file, the last of a number wins."""
        places = {int(m[1]): ("at", m.start()) for m in _OBJECT.finditer(self.data)}
        self.places, packed, trailer = places, {}, {}
        for m in re.finditer(rb"\btrailer\b", self.data):
            own = next(values(self.data, m.end()), (None, 0))[0]
            trailer |= own if isinstance(own, dict) else {}
        for n in places:
            value = self.get(Ref(n))
            e = value.entries if isinstance(value, Stream) else value if isinstance(value, dict) else {}
            if e.get("Type") == "ObjStm":
                packed |= {m: ("in", n, k) for k, m in enumerate(self._packed(n))}
            elif e.get("Type") == "XRef":
                trailer = e | trailer
        self.places = packed | places
        for n in self.places:
            value = self.get(Ref(n))
            if isinstance(value, dict) and value.get("Type") == "Catalog":
                trailer["Root"] = Ref(n)
        return self.places, trailer

    def _at(self, offset: int) -> object:
        m = _OBJECT.match(self.data, offset) or _OBJECT.search(self.data, offset, offset + 40)
        if not m:
            raise ValueError("no object")
        value, end = next(values(self.data, m.end()))
        s = re.compile(rb"\s*stream(\r\n|\n|\r)").match(self.data, end) if isinstance(value, dict) else None
        if not s:
            return value
        length = self.get(value.get("Length"))
        if not isinstance(length, int) or not re.match(rb"\s*endstream", self.data[s.end() + length : s.end() + length + 20]):
            length = len(re.compile(rb"(.*?)\r?\n?endstream", re.S).match(self.data, s.end())[1])
        return Stream(value, self.data[s.end() : s.end() + length])

    def _packed(self, n: int) -> dict[int, object]:
        """The objects of an object stream by number."""
        if ("all", n) not in self.made:
            stream = self.get(Ref(n))
            content, first = self.content(stream), self.get(stream.entries["First"])
            heads = [int(x) for x in content[:first].split()]
            self.made["all", n] = {m: next(values(content, first + a), (None, 0))[0] for m, a in zip(heads[::2], heads[1::2], strict=True)}
        return self.made["all", n]

    def get(self, value: object) -> object:
        """What a reference stands for; other values are themselves."""
        for _ in range(20):
            if not isinstance(value, Ref):
                return value
            if value not in self.made:
                place = self.places.get(int(value)) if hasattr(self, "places") else None
                self.made[value] = None  # a reference to itself is nothing
                self.made[value] = self._at(place[1]) if place and place[0] == "at" else self._packed(place[1]).get(int(value)) if place else None
            value = self.made[value]
        return None

    def entry(self, holder: object, *names: str) -> object:
        for name in names:
            holder = self.get(holder)
            holder = (holder.entries if isinstance(holder, Stream) else holder if isinstance(holder, dict) else {}).get(name)
        return self.get(holder)

    def content(self, stream: Stream) -> bytes:
        """A stream's bytes without its filters; only deflation and ASCII hex are known."""
        filters, parms, data = (self.get(stream.entries.get(k)) for k in ("Filter", "DecodeParms", "-"))
        filters = [] if filters is None else filters if isinstance(filters, list) else [filters]
        parms = parms if isinstance(parms, list) else [parms] * len(filters)
        data = stream.raw
        for f, p in zip(filters, parms, strict=False):
            if f in ("FlateDecode", "Fl"):
                data = _predicted(zlib.decompressobj().decompress(data), self.get(p) or {})
            elif f in ("ASCIIHexDecode", "AHx"):
                data = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0]).decode())
            else:
                raise ValueError(f"unknown filter {f}")
        return data

    def pages(self) -> Iterator[tuple[dict, dict]]:
        """Each page and its resources, in the order of the page tree; resources come down from its branches."""
        # no function that knows itself: it would keep the file until the collector comes by
        seen, found, ahead = set(), [], [(self.entry(self.get(self.trailer.get("Root")), "Pages"), {})]
        while ahead:
            node, resources = ahead.pop()
            if isinstance(node, Ref):
                if node in seen:
                    continue
                seen.add(node)
            body = self.get(node)
            if not isinstance(body, dict):
                continue
            resources = self.get(body.get("Resources")) or resources
            if "Kids" in body:
                ahead += [(kid, resources) for kid in reversed(self.get(body["Kids"]) or [])]
            else:
                found.append((body, resources))
        if not found:  # no tree: pages as they come
            own = [self.get(Ref(n)) for n in sorted(self.places)]
            found = [(b, self.get(b.get("Resources")) or {}) for b in own if isinstance(b, dict) and b.get("Type") == "Page"]
        yield from found


class _Characters(dict):
    """Characters by the number of their code."""

    def __missing__(self, number: int) -> str:
        return "\ufffd"


class Font:
    """Characters of a font's codes: by its ToUnicode table, else by the usual one-byte encodings."""

    def __init__(self, doc: Document, body: object) -> None:
        self.wide = doc.entry(body, "Subtype") == "Type0"
        self.windows = "WinAnsiEncoding" in (doc.entry(body, "Encoding"), doc.entry(body, "Encoding", "BaseEncoding"))
        table = doc.entry(body, "ToUnicode")
        self.sizes, self.map = to_unicode(doc.content(table)) if isinstance(table, Stream) else ([], {})
        whole = [len(low) for low, high in self.sizes if not any(low) and high == b"\xff" * len(low)]
        self.step = whole[0] if whole and len(whole) == len(self.sizes) == 1 else 0  # all codes have this length
        self.numbers = _Characters((int.from_bytes(k, "big"), c) for k, c in self.map.items() if len(k) == self.step)

    def text(self, codes: bytes) -> str:
        if not self.map and not self.wide:
            return codes.decode("cp1252" if self.windows else "latin-1", "replace")
        if self.step in (1, 2) and len(codes) % self.step == 0:
            return "".join(map(self.numbers.__getitem__, codes if self.step == 1 else struct.unpack(f">{len(codes) // 2}H", codes)))
        if self.step and len(codes) % self.step == 0:
            return "".join([self.map.get(codes[k : k + self.step], "\ufffd") for k in range(0, len(codes), self.step)])
        out, at = [], 0
        while at < len(codes):
            # a code is as long as the range that its bytes fall into
            size = next((len(low) for low, high in self.sizes if at + len(low) <= len(codes) and all(a <= c <= b for a, c, b in zip(low, codes[at : at + len(low)], high, strict=True))), 2 if self.wide else 1)
            out.append(self.map.get(codes[at : at + size], "\ufffd"))
            at += size
        return "".join(out)


def to_unicode(data: bytes) -> tuple[list[tuple[bytes, bytes]], dict[bytes, str]]:
    """(code-space ranges, shortest first; characters by code) of a ToUnicode table."""
    text = lambda b: b.decode("utf-16-be", "replace")
    sizes, found, operands = [], {}, []
    for value, _ in values(data):
        if not isinstance(value, Operator):
            operands.append(value)
            continue
        if value == b"endcodespacerange":
            sizes += [(a, b) for a, b in zip(operands[::2], operands[1::2], strict=False)]
        elif value == b"endbfchar":
            found.update((a, text(b)) for a, b in zip(operands[::2], operands[1::2], strict=False))
        elif value == b"endbfrange":
            for low, high, to in zip(operands[::3], operands[1::3], operands[2::3], strict=False):
                first, last = int.from_bytes(low, "big"), int.from_bytes(high, "big")
                for k in range(min(last - first + 1, 1 << 16)):
                    code = (first + k).to_bytes(len(low), "big")
                    if isinstance(to, list):
                        if k < len(to):
                            found[code] = text(to[k])
                    else:
                        found[code] = text(to[:-2] + (int.from_bytes(to[-2:], "big") + k & 0xFFFF).to_bytes(2, "big"))
        operands = []
    return sorted(sizes, key=lambda x: len(x[0])), found


def _page_text(doc: Document, content: bytes, resources: dict, fonts: dict[object, Font]) -> str:
    """Strings as they are shown; a new line where the text moves up or down."""
    out, operands, font, line = [], [], None, None

    def broken() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    def shown(codes: bytes) -> None:
        out.append(codes.decode("latin-1") if font is None else font.text(codes))

    for value, _ in values(content):
        if not isinstance(value, Operator):
            operands.append(value)
            continue
        if value == b"Tf" and len(operands) >= 2:
            key = (doc.entry(resources, "Font") or {}).get(operands[-2])
            name = key if isinstance(key, Ref) else id(key)
            if name not in fonts:
                fonts[name] = Font(doc, key)
            font = fonts[name]
        elif value in (b"T*", b"ET"):
            broken()
        elif value in (b"Td", b"TD") and len(operands) >= 2:
            if operands[-1]:
                broken()
        elif value == b"Tm" and len(operands) >= 6:
            if line is not None and operands[-1] != line:
                broken()
            line = operands[-1]
        elif value in (b"Tj", b"'", b'"') and operands and isinstance(operands[-1], bytes):
            if value != b"Tj":
                broken()
            shown(operands[-1])
        elif value == b"TJ" and operands and isinstance(operands[-1], list):
            for part in operands[-1]:
                if isinstance(part, bytes):
                    shown(part)
                elif isinstance(part, (int, float)) and part <= BLANK and out and not out[-1].endswith((" ", "\n")):
                    out.append(" ")
        operands = []
    return "".join(out)


def pdf_pages(data: bytes) -> list[str]:
    """The text of each page, in page order; an error for what can't be read."""
    doc, fonts, out = Document(data), {}, []
    for body, resources in doc.pages():
        parts = doc.get(body.get("Contents"))
        streams = [doc.get(x) for x in (parts if isinstance(parts, list) else [parts])]
        content = b"\n".join(doc.content(s) for s in streams if isinstance(s, Stream))
        out.append(_page_text(doc, content, resources, fonts))
    if not out:
        raise ValueError("no page found")
    return out


def pdf_bytes(pages: list[str], wide: bool = False) -> bytes:
    """A PDF of pages, whose lines are shown one by one; later pages stand first in the file.

    Plain ones have a one-byte font (Windows' Latin-1) and a cross-reference table; ``wide`` ones a two-byte font with a
    ToUnicode table, object streams and a cross-reference stream.
    """
    codes = {c: k for k, c in enumerate(sorted(set("".join(pages))), 1)}
    hexes = {c: f"{k:04X}" for c, k in codes.items()}
    escaped = lambda s: re.sub(rb"([\\()])", rb"\\\1", s.encode("cp1252"))
    shown = (lambda s: b"<%s> Tj T*" % "".join(map(hexes.__getitem__, s)).encode()) if wide else (lambda s: b"(" + escaped(s) + b") Tj T*")
    n, streams = len(pages), {}
    plain = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 3 0 R >> >> >>" % (n, b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(n)))}
    for k in reversed(range(n)):
        plain[10 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents %d 0 R >>" % (11 + 2 * k)
        streams[11 + 2 * k] = b"BT /F1 12 Tf 14 TL 72 720 Td\n" + b"\n".join(shown(line) for line in pages[k].split("\n")) + b"\nET"
    if wide:
        plain[3] = b"<< /Type /Font /Subtype /Type0 /BaseFont /Any /Encoding /Identity-H /ToUnicode 4 0 R >>"
        rows = [b"<%04X> <%s>" % (k, c.encode("utf-16-be").hex().encode()) for c, k in codes.items()]
        blocks = [rows[k : k + 100] for k in range(0, len(rows), 100)]  # a block has no more
        streams[4] = b"1 begincodespacerange <0000> <FFFF> endcodespacerange\n" + b"\n".join(b"%d beginbfchar\n%s\nendbfchar" % (len(b), b"\n".join(b)) for b in blocks)
    else:
        plain[3] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"
    out, places = bytearray(b"%PDF-1.5\n"), {}

    def put(number: int, body: bytes) -> None:
        places[number] = (1, len(out), 0)
        out.extend(b"%d 0 obj\n%s\nendobj\n" % (number, body))

    def stream(number: int, data: bytes, entries: bytes = b"") -> None:
        packed = zlib.compress(data)
        put(number, b"<< %s /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (entries, len(packed), packed))

    for number, data in streams.items():
        stream(number, data)
    last = 10 + 2 * n
    if not wide:
        for number, body in plain.items():
            put(number, body)
        start, rows = len(out), [b"%010d 00000 n" % places[k][1] if k in places else b"0000000000 65535 f" for k in range(last)]
        return bytes(out) + b"xref\n0 %d\n%s \ntrailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (last, b" \n".join(rows), last, start)
    heads, bodies, at = [], [], 0
    for k, (number, body) in enumerate(plain.items()):
        heads.append(b"%d %d" % (number, at))
        bodies.append(body)
        at += len(body) + 1
        places[number] = (2, last, k)
    head = b" ".join(heads) + b" "
    stream(last, head + b"\n".join(bodies), b"/Type /ObjStm /N %d /First %d" % (len(bodies), len(head)))
    start = len(out)
    places[last + 1] = (1, start, 0)
    table = [b"%c%s%s" % (kind, x.to_bytes(4, "big"), y.to_bytes(2, "big")) for kind, x, y in (places.get(k, (0, 0, 0)) for k in range(last + 2))]
    above, predicted = bytes(7), []
    for row in table:
        predicted.append(b"\2" + bytes((a - b) & 255 for a, b in zip(row, above, strict=True)))
        above = row
    stream(last + 1, b"".join(predicted), b"/Type /XRef /Size %d /W [1 4 2] /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 7 >>" % (last + 2))
    return bytes(out) + b"startxref\n%d\n%%%%EOF" % start
