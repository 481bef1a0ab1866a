"""The text of PDF files that hold text: pages in order, one block each.

No library for PDF is needed. Objects are found by their own marks, so a
damaged cross-reference table doesn't matter; streams may be plain or
deflated, objects may be packed into object streams, and codes become text by
a font's ToUnicode table, else as Windows-1252. Text is put together in the
order in which the page shows it; a new line begins where the text moves down.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_OBJECT = re.compile(rb"(?:^|[\r\n\s])(\d+)\s+(\d+)\s+obj\b")
_TOKEN = re.compile(rb"<<|>>|\[|\]|/[^\s<>\[\]()/%{}]*|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|%[^\r\n]*|[^\s<>\[\]()/%{}]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class PdfError(ValueError):
    """The code of what is wrong with a file."""


class Ref(tuple):
    """The number of an object that is kept elsewhere."""


class Name(str):
    pass


def _string(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    plain = re.sub(rb"\\\r?\n", b"", token[1:-1])
    return re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1]), plain, flags=re.S)


def parse_value(tokens: list[bytes], at: int = 0):
    """(value, next place) of the value that begins at a token; operators are bytes."""
    token = tokens[at]
    if token in (b"<<", b"["):
        items, at = [], at + 1
        end = b">>" if token == b"<<" else b"]"
        while at < len(tokens) and tokens[at] != end:
            value, at = parse_value(tokens, at)
            if value == b"R" and len(items) >= 2:
                number = items[-2:]
                del items[-2:]
                value = Ref(int(x) for x in number)
            items.append(value)
        return (items if end == b"]" else dict(zip(items[::2], items[1::2], strict=False))), at + 1
    if token.startswith(b"/"):
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), token[1:]).decode("latin-1")), at + 1
    if token.startswith((b"(", b"<")):
        return _string(token), at + 1
    try:
        return (float(token) if b"." in token else int(token)), at + 1
    except ValueError:
        return {b"true": True, b"false": False, b"null": None}.get(token, token), at + 1


def _tokens(data: bytes) -> list[bytes]:
    return [t for t in _TOKEN.findall(data) if not t.startswith(b"%")]


class Pdf:
    """The objects of a file."""

    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF-"):
            raise PdfError("invalid_pdf")
        if re.search(rb"/Encrypt\b", data):
            raise PdfError("encrypted_pdf")
        self.objects: dict[int, tuple[object, bytes | None]] = {}
        found = list(_OBJECT.finditer(data))
        for mark, following in zip(found, [*found[1:], None], strict=True):
            self._take(int(mark[1]), data[mark.end() : following.start() if following else len(data)])
        for value, stream in list(self.objects.values()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm" and stream is not None:
                self._unpack(value, stream)

    def _take(self, number: int, body: bytes) -> None:
        head, mark, rest = body.partition(b"stream")
        stream = None
        if mark and b"<<" in head:
            rest = rest[2:] if rest.startswith(b"\r\n") else rest[1:] if rest[:1] in (b"\n", b"\r") else rest
            stream = rest[: rest.rfind(b"endstream")] if b"endstream" in rest else rest
        else:
            head = body.split(b"endobj")[0]
        tokens = _tokens(head)
        if tokens:
            self.objects[number] = (parse_value(tokens)[0], stream)

    def _unpack(self, value: dict, stream: bytes) -> None:
        data = self.decoded(value, stream)
        first, head = self.get(value["First"]), _tokens(data[: self.get(value["First"])])
        places = [(int(head[i]), int(head[i + 1])) for i in range(0, 2 * self.get(value["N"]), 2)]
        for (number, start), stop in zip(places, [*(s for _, s in places[1:]), len(data)], strict=True):
            tokens = _tokens(data[first + start : first + stop if stop != len(data) else len(data)])
            if tokens and number not in self.objects:
                self.objects[number] = (parse_value(tokens)[0], None)

    def get(self, value):
        seen = 0
        while isinstance(value, Ref) and seen < 50:
            value, seen = self.objects.get(value[0], (None, None))[0], seen + 1
        return value

    def decoded(self, value: dict, stream: bytes) -> bytes:
        filters = self.get(value.get("Filter")) or []
        for name in filters if isinstance(filters, list) else [filters]:
            if name != "FlateDecode":
                return b""  # images and the like: no text
            stream = zlib.decompressobj().decompress(stream)
        return stream

    def stream(self, ref) -> bytes:
        value, data = self.objects.get(ref[0], (None, None)) if isinstance(ref, Ref) else (None, None)
        return self.decoded(value, data) if data is not None else b""

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with what they inherit."""
        roots = [v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"]
        out: list[dict] = []

        def walk(ref, given: dict, depth: int) -> None:
            node = self.get(ref)
            if not isinstance(node, dict) or depth > 60:
                return
            given = given | {k: node[k] for k in ("Resources",) if k in node}
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    walk(kid, given, depth + 1)
            else:
                out.append(given | node)

        for root in roots[-1:]:
            walk(root.get("Pages"), {}, 0)
        return out

    def text(self, page: dict) -> str:
        contents = self.get(page.get("Contents"))
        refs = contents if isinstance(contents, list) else [page.get("Contents")]
        fonts = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        tables = {name: self._font(self.get(f) or {}) for name, f in fonts.items()}
        return shown_text(b"\n".join(self.stream(r) for r in refs if r is not None), tables)

    def _font(self, font: dict) -> tuple[int, dict[int, str]]:
        """Bytes of a code, and what codes stand for."""
        wide = 2 if font.get("Subtype") == "Type0" else 1
        return wide, unicode_table(self.stream(font["ToUnicode"])) if "ToUnicode" in font else {}


def unicode_table(data: bytes) -> dict[int, str]:
    """What codes stand for by a ToUnicode table."""
    table: dict[int, str] = {}
    text = lambda x: x.decode("utf-16-be", "replace")
    for kind, body in re.findall(rb"beginbf(char|range)(.*?)endbf", data, re.S):
        tokens, items, at = _tokens(body), [], 0
        while at < len(tokens):
            value, at = parse_value(tokens, at)
            items.append(value)
        if kind == b"char":
            table |= {int.from_bytes(a, "big"): text(b) for a, b in zip(items[::2], items[1::2], strict=False)}
        for low, high, to in zip(items[::3], items[1::3], items[2::3], strict=False) if kind == b"range" else ():
            begin = int.from_bytes(low, "big")
            for i in range(min(65536, int.from_bytes(high, "big") - begin + 1)):
                if isinstance(to, list):
                    table[begin + i] = text(to[i]) if i < len(to) else ""
                else:
                    table[begin + i] = text(to[:-2] + (int.from_bytes(to[-2:], "big") + i).to_bytes(3, "big")[-2:])
    return table


def shown_text(data: bytes, fonts: dict[str, tuple[int, dict[int, str]]]) -> str:
    """What a content stream shows."""
    tokens, out, stack, at = _tokens(data), [], [], 0
    wide, table = 1, {}

    def show(code: bytes) -> str:
        if not table:
            return code.decode("utf-16-be" if wide == 2 else "cp1252", "replace")
        return "".join(table.get(int.from_bytes(code[i : i + wide], "big"), "") for i in range(0, len(code), wide))

    while at < len(tokens):
        value, at = parse_value(tokens, at)
        if not isinstance(value, bytes) or tokens[at - 1].startswith((b"(", b"<")):
            stack.append(value)
            continue
        if value == b"Tf" and len(stack) >= 2:
            wide, table = fonts.get(stack[-2], (1, {}))
        elif value in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], bytes):
            out.append(("\n" if value != b"Tj" else "") + show(stack[-1]))
        elif value == b"TJ" and stack and isinstance(stack[-1], list):
            out.append("".join(show(x) if isinstance(x, bytes) else " " if isinstance(x, (int, float)) and x < -200 else "" for x in stack[-1]))
        elif value in (b"Td", b"TD") and len(stack) >= 2:
            out.append("\n" if stack[-1] else " ")
        elif value in (b"T*", b"Tm", b"ET"):
            out.append("\n")
        stack = []
    lines = (re.sub(r"[ \t]+", " ", line).strip() for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def read(data: bytes, max_pages: int = 200, max_chars: int = 1_000_000) -> list[str]:
    """The texts of all pages, or PdfError: encrypted_pdf, too_many_pages, too_much_extracted_text or invalid_pdf."""
    try:
        pdf = Pdf(data)
        pages = pdf.pages()
        if not pages:
            raise PdfError("invalid_pdf")
        if len(pages) > max_pages:
            raise PdfError("too_many_pages")
        out, total = [], 0
        for page in pages:
            out.append(pdf.text(page))
            total += len(out[-1])
            if total > max_chars:
                raise PdfError("too_much_extracted_text")
        return out
    except PdfError:
        raise
    except Exception as error:
        raise PdfError("invalid_pdf") from error


def pdf_pages(documents: DataFrame, max_pages: int = 200, max_chars: int = 1_000_000) -> DataFrame:
    """document_id, page, block, section, text of every page, and error_code (page null) of files that can't be read. Takes document_id and data."""
    kind = documents.schema["document_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            owner = []
            for i, data in enumerate(batch.column("data").to_pylist()):
                try:
                    own = [(n, 0, None, text, None) for n, text in enumerate(read(data or b"", max_pages, max_chars), 1)]
                except PdfError as error:
                    own = [(None, None, None, None, str(error))]
                rows += own
                owner += [i] * len(own)
            if rows:
                types = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("document_id").take(pa.array(owner)), *columns], ["document_id", "page", "block", "section", "text", "error_code"])

    return documents.select("document_id", "data").mapInArrow(run, f"document_id {kind}, page int, block int, section string, text string, error_code string")


def write(pages: list[str]) -> bytes:
    """A small PDF with these pages, for tests and demonstrations: Windows-1252 text, a line a line."""
    objects: list[bytes] = [b"<</Type/Catalog/Pages 2 0 R>>", b"", b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"]
    kids = []
    for text in pages:
        shown = b"".join(b"(" + re.sub(rb"([()\\])", rb"\\\1", line.encode("cp1252", "replace")) + b") Tj T*\n" for line in text.split("\n"))
        body = zlib.compress(b"BT /F1 12 Tf 14 TL 50 780 Td\n" + shown + b"ET")
        objects.append(b"<</Length %d/Filter/FlateDecode>>\nstream\n%s\nendstream" % (len(body), body))
        objects.append(b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 595 842]/Resources<</Font<</F1 3 0 R>>>>/Contents %d 0 R>>" % len(objects))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<</Type/Pages/Count %d/Kids[%s]>>" % (len(kids), b" ".join(kids))
    out, places = b"%PDF-1.4\n", []
    for number, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, table, len(objects) + 1, len(out))
