"""A Spark data source for PDF files: ``spark.read.format("pdf").option("table", "pages").load(paths)``.

Each file is read by one task and gives the rows of one table. A broken file gives what can be read, with its repairs and
warnings in the ``documents`` table and what went wrong in the ``errors`` table; it never fails the job. Objects are found
by scanning the file for them, later definitions replacing earlier ones, in object streams too, which reads good files,
appended revisions and damaged ones alike; the option ``revision`` reads the file as it stood then. Encrypted files are
opened with the option ``password``, or an empty one; without the right one they give ``documents``, ``objects``,
``revisions`` and ``permissions`` only.

Files are listed and read through the file system that their address names, so any store that pyarrow knows will do;
``from_binary`` reads rows of ``binaryFile`` instead, for stores that only Spark can list, and for streams.
"""

from __future__ import annotations

import fnmatch
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import codecs, crypt, pdftext

SCHEMAS = {
    "documents": "path string, file_size bigint, pdf_version string, title string, author string, subject string, keywords string, creator string, producer string, encrypted boolean, tagged boolean, has_javascript boolean, xfa string, warnings array<string>, repairs array<string>",
    "pages": "path string, page int, label string, width float, height float, crop array<float>, rotation int",
    "annotations": "path string, page int, index int, subtype string, author string, contents string, modified string, name string, in_reply_to string, state string, intent string, rect array<float>, color array<float>, quads array<array<float>>, locked boolean",
    "fields": "path string, name string, kind string, value array<string>, default_value array<string>, flags int, max_len int, options array<struct<export_value:string,display_text:string>>, tooltip string, page int, rect array<double>",
    "outline": "path string, at array<int>, title string, page int, open boolean",
    "links": "path string, page int, rect array<float>, kind string, target_page int, uri string, other string",
    "layers": "path string, obj_num int, name string, visible boolean",
    "fonts": "path string, name string, kind string, embedded boolean, subset boolean, encoding string",
    "attachments": "path string, name string, description string, size bigint, source string, content binary",
    "objects": "path string, num bigint, gen int, type string, value string, stream_bytes bigint",
    "revisions": "path string, n int, xref_offset bigint, end_offset bigint",
    "content_ops": "path string, page int, seq int, op string, operands string",
    "text": "path string, page int, text string",
    "scripts": "path string, name string, script string",
    "images": "path string, obj_num bigint, width int, height int, filter string, bytes bigint, content binary",
    "xfa_packets": "path string, name string, xml string",
    "glyphs": "path string, page int, ord int, text string, rect array<float>, line int, space_before boolean",
    "words": "path string, page int, ord int, text string, rect array<float>, line int",
    "boxes": "path string, page int, media array<float>, crop array<float>, bleed array<float>, trim array<float>, art array<float>",
    "structure": "path string, id int, parent_id int, preorder int, type string, alt string, actual_text string, title string, lang string, page int, summary string, colspan int, rowspan int, has_content boolean, has_annots boolean",
    "xmp": "path string, key string, value string",
    "permissions": "path string, encrypted boolean, opened boolean, revision int, permissions int",
    "signatures": "path string, field string, signed boolean, sub_filter string, signer string, reason string, signed_at string, ranges array<bigint>, covers_file boolean",
    "errors": "path string, `table` string, error string",
}

_WHITE = b" \t\r\n\f\0"
_DELIMS = b"()<>[]{}/%"


class Name(str):
    """A name object; text strings are plain str, byte strings bytes."""


@dataclass(frozen=True)
class Ref:
    num: int
    gen: int = 0


@dataclass
class Stream:
    dict: dict
    raw: bytes


class Broken(ValueError):
    pass


class Lexer:
    """Objects of the syntax, from a position on."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.d, self.at = data, at

    def skip(self) -> None:
        d, n = self.d, len(self.d)
        while self.at < n:
            if d[self.at] in _WHITE:
                self.at += 1
            elif d[self.at] == 0x25:
                while self.at < n and d[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def word(self) -> bytes:
        start = self.at
        while self.at < len(self.d) and self.d[self.at] not in _WHITE and self.d[self.at] not in _DELIMS:
            self.at += 1
        return self.d[start : self.at]

    def object(self, depth: int = 0):
        if depth > 100:
            raise Broken("nested too deeply")
        self.skip()
        d = self.d
        if self.at >= len(d):
            raise Broken("end of data")
        c = d[self.at : self.at + 1]
        if c == b"/":
            self.at += 1
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), self.word()).decode("latin-1"))
        if c == b"(":
            return self._string()
        if d[self.at : self.at + 2] == b"<<":
            self.at += 2
            out = {}
            while True:
                self.skip()
                if d[self.at : self.at + 2] == b">>":
                    self.at += 2
                    return out
                key = self.object(depth + 1)
                if not isinstance(key, Name):
                    raise Broken("a key is no name")
                out[str(key)] = self.object(depth + 1)
        if c == b"<":
            end = d.find(b">", self.at)
            hexa = re.sub(rb"[^0-9A-Fa-f]", b"", d[self.at + 1 : end if end >= 0 else len(d)])
            self.at = end + 1 if end >= 0 else len(d)
            return bytes.fromhex((hexa + b"0" * (len(hexa) % 2)).decode())
        if c == b"[":
            self.at += 1
            items = []
            while True:
                self.skip()
                if self.at >= len(d):
                    raise Broken("end of data")
                if d[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return items
                items.append(self.object(depth + 1))
        if c in b")>]{}":
            self.at += 1
            raise Broken("unexpected delimiter")
        if m := re.compile(rb"(\d+)\s+(\d+)\s+R(?![\w])").match(d, self.at):
            self.at = m.end()
            return Ref(int(m[1]), int(m[2]))
        w = self.word()
        if w in (b"true", b"false", b"null"):
            return {b"true": True, b"false": False, b"null": None}[w]
        if re.fullmatch(rb"[+-]?\d+", w):
            return int(w)
        if re.fullmatch(rb"[+-]?(\d+\.?\d*|\.\d+)", w):
            x = float(w)
            return int(x) if x == int(x) and abs(x) < 2**53 else x
        if not w:
            self.at += 1
            raise Broken("unexpected byte")
        return Keyword(w.decode("latin-1"))

    def _string(self) -> bytes:
        d, i, depth, out = self.d, self.at + 1, 1, bytearray()
        while i < len(d):
            c = d[i]
            if c == 0x5C and i + 1 < len(d):
                i += 1
                e = d[i : i + 1]
                if e in b"01234567":
                    m = re.compile(rb"[0-7]{1,3}").match(d, i)
                    out.append(int(m[0], 8) & 255)
                    i = m.end()
                    continue
                if e in b"\r\n":
                    i += 2 if d[i : i + 2] == b"\r\n" else 1
                    continue
                out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(e, e)
            elif c == 0x28:
                depth += 1
                out.append(c)
            elif c == 0x29:
                depth -= 1
                if not depth:
                    self.at = i + 1
                    return bytes(out)
                out.append(c)
            else:
                out.append(c)
            i += 1
        self.at = i
        return bytes(out)


class Keyword(str):
    pass


# Where the encoding of text strings differs from Latin-1.
_DOC = dict(zip(range(0x18, 0x20), "˘ˇˆ˙˝˛˚˜", strict=True)) | dict(zip(range(0x80, 0x9F), "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž", strict=True)) | {0xA0: "€"}


def text(v) -> str | None:
    """A text string: UTF-16 or UTF-8 after their mark, else the encoding of such strings."""
    if isinstance(v, Name):
        return str(v)
    if not isinstance(v, bytes):
        return None
    if v[:2] == b"\xfe\xff":
        return v[2:].decode("utf-16-be", "replace")
    if v[:3] == b"\xef\xbb\xbf":
        return v[3:].decode("utf-8", "replace")
    return v.decode("latin-1").translate(_DOC)


@dataclass
class Document:
    data: bytes
    objects: dict[int, object] = field(default_factory=dict)
    gens: dict[int, int] = field(default_factory=dict)
    trailer: dict = field(default_factory=dict)
    repairs: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    #: Where each object was defined last: that of its stream for one inside an object stream.
    places: dict[int, int] = field(default_factory=dict)
    opened: bool = True

    def get(self, v, depth: int = 0):
        while isinstance(v, Ref) and depth < 64:
            v, depth = self.objects.get(v.num), depth + 1
        return None if isinstance(v, Ref) else v

    def dict(self, v) -> dict:
        v = self.get(v)
        return v.dict if isinstance(v, Stream) else v if isinstance(v, dict) else {}

    def list(self, v) -> list:
        v = self.get(v)
        return v if isinstance(v, list) else []

    def stream(self, v) -> bytes:
        s = self.get(v)
        if not isinstance(s, Stream):
            return b""
        f = self.get(s.dict.get("Filter", s.dict.get("F")))
        filters = [str(self.get(x)) for x in (f if isinstance(f, list) else [f] if f else [])]
        p = self.get(s.dict.get("DecodeParms", s.dict.get("DP")))
        parms = [{k: self.get(x) for k, x in self.dict(q).items()} for q in (p if isinstance(p, list) else [p] if p else [])]
        out, cut = codecs.decode(s.raw, filters, parms)
        if cut and "a stream was cut off" not in self.warnings:
            self.warnings.append("a stream was cut off")
        return out

    @property
    def root(self) -> dict:
        return self.dict(self.trailer.get("Root"))


_OBJ = re.compile(rb"(?<![0-9])(\d{1,10})\s+(\d{1,5})\s+obj\b")


def _decrypt(doc: Document, password: str) -> None:
    """Strings and streams of an encrypted file in place; ``opened`` says whether the password fits."""
    ref = doc.trailer.get("Encrypt")
    plain = lambda v: {k: plain(x) for k, x in v.items()} if isinstance(v := doc.get(v), dict) else v
    ids = doc.list(doc.trailer.get("ID"))
    handler = crypt.Handler(plain(ref) or {}, ids[0] if ids and isinstance(ids[0], bytes) else b"", password)
    doc.opened = handler.key is not None
    if not doc.opened:
        return

    def walk(v, num: int, gen: int):
        if isinstance(v, bytes):
            return handler.decrypt(v, num, gen, "string")
        if isinstance(v, dict):
            return {k: walk(x, num, gen) for k, x in v.items()}
        return [walk(x, num, gen) for x in v] if isinstance(v, list) else v

    own = ref.num if isinstance(ref, Ref) else None
    for n, o in doc.objects.items():
        gen = doc.gens.get(n, 0)
        if n == own:
            continue
        if isinstance(o, Stream):
            kind = o.dict.get("Type")
            if kind == "XRef":
                continue
            raw = o.raw if kind == "Metadata" and not handler.meta else handler.decrypt(o.raw, n, gen, "stream")
            doc.objects[n] = Stream(walk(o.dict, n, gen), raw)
        else:
            doc.objects[n] = walk(o, n, gen)


def revision_ends(data: bytes) -> list[int]:
    return [m.end() for m in re.finditer(rb"%%EOF[\r\n]*", data)]


def parse(data: bytes, password: str = "", revision: int | None = None) -> Document:
    if revision is not None:
        ends = revision_ends(data)
        data = data[: ends[revision - 1]] if 0 < revision <= len(ends) else b""
    doc = Document(data)
    if data[:1024].find(b"%PDF-") < 0:
        doc.repairs.append("no header")
    at = 0
    while m := _OBJ.search(data, at):
        at = m.end()
        lex = Lexer(data, at)
        try:
            value = lex.object()
        except (Broken, RecursionError) as e:
            doc.repairs.append(f"object {int(m[1])}: {e}")
            continue
        at = lex.at
        if isinstance(value, dict) and (s := re.compile(rb"\s*stream(\r\n|\n|\r)?").match(data, at)):
            n = value.get("Length")
            end = s.end() + n if isinstance(n, int) and n >= 0 else -1
            if end < 0 or not re.compile(rb"\s*endstream").match(data, end):
                end = data.find(b"endstream", s.end())
                if end < 0:
                    end = len(data)
                    doc.repairs.append(f"object {int(m[1])}: stream cut off")
                elif isinstance(n, int):
                    doc.repairs.append(f"object {int(m[1])}: length corrected")
                while end > s.end() and data[end - 1 : end] in (b"\r", b"\n") and not isinstance(n, int):
                    end -= 1
            value = Stream(value, data[s.end() : end])
            at = end
        doc.objects[int(m[1])] = value
        doc.gens[int(m[1])] = int(m[2])
        doc.places[int(m[1])] = m.start()
    for m in re.finditer(rb"trailer\s*(?=<<)", data):
        try:
            t = Lexer(data, m.end()).object()
            doc.trailer |= {k: v for k, v in t.items() if k not in doc.trailer or k in ("Root", "Info", "Encrypt")}
        except (Broken, RecursionError):
            doc.repairs.append("trailer unreadable")
    packed = [o for o in list(doc.objects.values()) if isinstance(o, Stream)]
    for s in packed:
        if s.dict.get("Type") == "XRef":
            doc.trailer |= {k: v for k, v in s.dict.items() if k in ("Root", "Info", "Encrypt", "ID")}
    if "Encrypt" in doc.trailer:
        _decrypt(doc, password)
    if doc.opened:
        for n in sorted((n for n, o in doc.objects.items() if isinstance(o, Stream) and o.dict.get("Type") == "ObjStm"), key=lambda n: doc.places[n]):
            _open_object_stream(doc, doc.objects[n], doc.places[n])
    if not doc.root:
        found = next((n for n, o in doc.objects.items() if isinstance(o, dict) and o.get("Type") == "Catalog"), None)
        if found is not None:
            doc.trailer["Root"] = Ref(found)
            doc.repairs.append("catalog found by scan")
    return doc


def _open_object_stream(doc: Document, s: Stream, place: int) -> None:
    """Objects in a stream replace those defined before it in the file."""
    body = doc.stream(s)
    first, n = doc.get(s.dict.get("First")), doc.get(s.dict.get("N"))
    if not isinstance(first, int) or not isinstance(n, int):
        return
    heads = re.findall(rb"\d+", body[:first])[: 2 * n]
    for num, offset in zip(heads[::2], heads[1::2], strict=False):
        if doc.places.get(int(num), -1) < place:
            try:
                doc.objects[int(num)] = Lexer(body, first + int(offset)).object()
                doc.gens[int(num)] = 0
                doc.places[int(num)] = place
            except (Broken, RecursionError):
                doc.repairs.append(f"object {int(num)}: unreadable in its stream")


def page_list(doc: Document) -> list[dict]:
    """Pages in order, with what they inherit."""
    out: list[dict] = []
    seen: set[int] = set()

    def walk(ref, inherited: dict, depth: int) -> None:
        node = doc.dict(ref)
        if not node or depth > 60 or (isinstance(ref, Ref) and ref.num in seen):
            return
        if isinstance(ref, Ref):
            seen.add(ref.num)
        own = inherited | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}
        kids = doc.list(node.get("Kids"))
        if kids or node.get("Type") == "Pages":
            for k in kids:
                walk(k, own, depth + 1)
        else:
            out.append(own | node | {"_ref": ref})

    walk(doc.root.get("Pages"), {}, 0)
    if not out:
        out = [o | {"_ref": Ref(n)} for n, o in sorted(doc.objects.items()) if isinstance(o, dict) and o.get("Type") == "Page"]
        if out:
            doc.repairs.append("pages found by scan")
    return out


def content(doc: Document, page: dict) -> bytes:
    c = doc.get(page.get("Contents"))
    return b"\n".join(doc.stream(x) for x in c) if isinstance(c, list) else doc.stream(page.get("Contents"))


def operators(data: bytes) -> Iterator[tuple[str, list]]:
    """Operators of a content stream with their operands; inline images come as one BI with their dictionary."""
    lex, operands = Lexer(data), []
    while True:
        lex.skip()
        if lex.at >= len(data):
            return
        try:
            v = lex.object()
        except Broken:
            continue
        if not isinstance(v, Keyword):
            operands.append(v)
            continue
        if v == "BI":
            m = re.compile(rb"\sID[\s]").search(data, lex.at)
            end = re.compile(rb"\sEI(?=\s|$)").search(data, m.end() if m else lex.at)
            lex.at = end.end() if end else len(data)
        yield str(v), operands
        operands = []


def plain_text(doc: Document, page: dict) -> str:
    """Text a page shows, in the order of its content; a new line where the text position moves down."""
    out: list[str] = []
    y = last = 0.0
    for op, args in operators(content(doc, page)):
        if op in ("Td", "TD") and len(args) == 2 and isinstance(args[1], (int, float)):
            y += args[1]
        elif op == "Tm" and len(args) == 6 and isinstance(args[5], (int, float)):
            y = args[5]
        elif op in ("T*", "'", '"'):
            y -= 1
        elif op == "BT":
            y = 0.0
        if op in ("Tj", "'", '"', "TJ"):
            parts = args[-1] if args and isinstance(args[-1], list) else args[-1:]
            t = "".join(" " if isinstance(x, (int, float)) and x < -200 else text(x) or "" for x in parts)
            if out and y != last:
                out.append("\n")
            out.append(t)
            last = y
    return "".join(out)


def as_json(v, depth: int = 0) -> object:
    """An object as plain data: names begin with a slash, references are ``{"ref": number}``, text strings are texts."""
    if isinstance(v, Stream):
        v = v.dict
    if isinstance(v, Name):
        return f"/{v}"
    if isinstance(v, Ref):
        return {"ref": v.num}
    if isinstance(v, bytes):
        return text(v)
    if isinstance(v, dict):
        return {k: as_json(x, depth + 1) for k, x in v.items()}
    return [as_json(x, depth + 1) for x in v] if isinstance(v, list) else str(v) if isinstance(v, Keyword) else v


def entry(value, *keys: str):
    """A column with an entry of an object's dictionary, at any depth: ``entry("value", "Font", "Type")``."""
    from pyspark.sql import functions as F

    return F.get_json_object(value, "$" + "".join(f"['{k}']" for k in keys))


def _numbers(v) -> list[float] | None:
    return [float(x) for x in v if isinstance(x, (int, float))] if isinstance(v, list) else None


def _values(doc: Document, v) -> list[str] | None:
    v = doc.get(v)
    if v is None:
        return None
    return [text(doc.get(x)) or "" for x in v] if isinstance(v, list) else [text(v) if text(v) is not None else str(v)]


def _labels(doc: Document, n: int) -> list[str | None]:
    from_page: dict[int, dict] = {}

    def walk(node: dict, depth: int = 0) -> None:
        nums = doc.list(node.get("Nums"))
        for k, v in zip(nums[::2], nums[1::2], strict=False):
            if isinstance(k, int):
                from_page[k] = doc.dict(v)
        for kid in doc.list(node.get("Kids")) if depth < 20 else []:
            walk(doc.dict(kid), depth + 1)

    walk(doc.dict(doc.root.get("PageLabels")))
    if not from_page:
        return [None] * n
    out, now, first = [], {}, 0
    for p in range(n):
        if p in from_page:
            now, first = from_page[p], p
        k = p - first + (doc.get(now.get("St")) if isinstance(doc.get(now.get("St")), int) else 1)
        out.append((text(doc.get(now.get("P"))) or "") + label(str(now.get("S", "")), k))
    return out


def label(style: str, k: int) -> str:
    if style == "D":
        return str(k)
    if style in "Rr" and style:
        t, n = "", k
        for v, s in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            t, n = t + s * (n // v), n % v
        return t.upper() if style == "R" else t
    if style in "Aa" and style and k > 0:
        t = chr(97 + (k - 1) % 26) * ((k - 1) // 26 + 1)
        return t.upper() if style == "A" else t
    return ""


_FIELD_KINDS = {"Tx": "text", "Btn": "checkbox", "Ch": "list", "Sig": "signature"}


def _fields(doc: Document, page_of: dict[int, int]) -> Iterator[tuple]:
    def walk(ref, up: dict, name: str, depth: int) -> Iterator[tuple]:
        node = doc.dict(ref)
        own = up | {k: node[k] for k in ("FT", "V", "DV", "Ff", "MaxLen", "Opt") if k in node}
        part = text(doc.get(node.get("T")))
        full = f"{name}.{part}" if name and part else part or name
        kids = [k for k in doc.list(node.get("Kids")) if "T" in doc.dict(k)] if depth < 40 else []
        if kids:
            for k in kids:
                yield from walk(k, own, full, depth + 1)
            return
        flags = doc.get(own.get("Ff")) or 0
        kind = _FIELD_KINDS.get(str(own.get("FT")), "text")
        if kind == "checkbox":
            kind = "button" if flags & 1 << 16 else "radio" if flags & 1 << 15 else "checkbox"
        if kind == "list" and flags & 1 << 17:
            kind = "combo"
        options = [{"export_value": (o := doc.get(x)) and text(doc.get(o[0]) if isinstance(o, list) and o else o), "display_text": text(doc.get(o[1]) if isinstance(o, list) and len(o) > 1 else o)} for x in doc.list(own.get("Opt"))]
        widget = doc.dict(doc.list(node.get("Kids"))[0]) if doc.list(node.get("Kids")) else node
        at = widget.get("P")
        rect = _numbers(doc.list(widget.get("Rect")))
        yield full, kind, _values(doc, own.get("V")), _values(doc, own.get("DV")), flags, doc.get(own.get("MaxLen")), options or None, text(doc.get(node.get("TU"))), page_of.get(at.num) if isinstance(at, Ref) else None, rect

    for f in doc.list(doc.dict(doc.root.get("AcroForm")).get("Fields")):
        yield from walk(f, {}, "", 0)


def _signature_fields(doc: Document) -> Iterator[tuple[str, dict]]:
    def walk(ref, kind, name: str, depth: int) -> Iterator[tuple[str, dict]]:
        node = doc.dict(ref)
        kind = node.get("FT", kind)
        part = text(doc.get(node.get("T")))
        full = f"{name}.{part}" if name and part else part or name
        kids = [k for k in doc.list(node.get("Kids")) if "T" in doc.dict(k)] if depth < 40 else []
        if kind == "Sig" and not kids:
            yield full, doc.dict(node.get("V"))
        for k in kids:
            yield from walk(k, kind, full, depth + 1)

    for f in doc.list(doc.dict(doc.root.get("AcroForm")).get("Fields")):
        yield from walk(f, None, "", 0)


def _target(doc: Document, dest, page_of: dict[int, int]) -> int | None:
    dest = doc.get(dest)
    if isinstance(dest, dict):
        dest = doc.get(dest.get("D"))
    if isinstance(dest, (bytes, Name)):
        dest = _named(doc).get(text(dest))
        dest = doc.get(dest.get("D")) if isinstance(dest, dict) else dest
    if isinstance(dest, list) and dest:
        return page_of.get(dest[0].num) if isinstance(dest[0], Ref) else dest[0] + 1 if isinstance(dest[0], int) else None
    return None


def _named(doc: Document) -> dict:
    out = {k: doc.get(v) for k, v in doc.dict(doc.root.get("Dests")).items()}
    out |= dict(_name_tree(doc, doc.dict(doc.root.get("Names")).get("Dests")))
    return out


def _name_tree(doc: Document, ref, depth: int = 0) -> Iterator[tuple[str, object]]:
    node = doc.dict(ref)
    names = doc.list(node.get("Names"))
    for k, v in zip(names[::2], names[1::2], strict=False):
        yield text(doc.get(k)) or "", doc.get(v)
    for kid in doc.list(node.get("Kids")) if depth < 20 else []:
        yield from _name_tree(doc, kid, depth + 1)


_XMP_PART = re.compile(r"<([A-Za-z][\w.-]*:[A-Za-z][\w.-]*)(?:\s[^>]*)?>([^<]*)</\1>", re.S)
_XMP_SHORT = re.compile(r"\b((?!xmlns|rdf|xml)[A-Za-z][\w.-]*:[A-Za-z][\w.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_XMP_LIST = re.compile(r"<([A-Za-z][\w.-]*:[A-Za-z][\w.-]*)[^>]*>\s*<rdf:(?:Alt|Bag|Seq)>(.*?)</rdf:(?:Alt|Bag|Seq)>", re.S)


def xmp(raw: bytes) -> Iterator[tuple[str, str]]:
    """Keys and values of a metadata packet; lists give a row for each entry."""
    from html import unescape

    t = raw.decode("utf-8", "replace")
    for m in _XMP_LIST.finditer(t):
        for x in re.findall(r"<rdf:li[^>]*>(.*?)</rdf:li>", m[2], re.S):
            yield m[1], unescape(x.strip())
    rest = _XMP_LIST.sub("", t)
    for m in _XMP_PART.finditer(rest):
        if not m[1].startswith("rdf:"):
            yield m[1], unescape(m[2].strip())
    for m in _XMP_SHORT.finditer(" ".join(re.findall(r"<rdf:Description[^>]*>", rest))):
        yield m[1], unescape(m[2] if m[2] is not None else m[3])


def structure(doc: Document, page_of: dict[int, int]) -> Iterator[tuple]:
    """Structure elements in preorder; role names are mapped to the standard ones."""
    tree = doc.dict(doc.root.get("StructTreeRoot"))
    roles = {k: str(doc.get(v)) for k, v in doc.dict(tree.get("RoleMap")).items()}
    seen: set[int] = set()
    n = 0
    stack = [(tree.get("K"), None, None)]
    out: list[list] = []
    while stack:
        ref, parent, page = stack.pop()
        v = doc.get(ref)
        if isinstance(v, list):
            stack += [(x, parent, page) for x in reversed(v)]
            continue
        if isinstance(v, int):
            if parent is not None:
                out[parent][-2] = True
            continue
        if not isinstance(v, dict) or (isinstance(ref, Ref) and ref.num in seen):
            continue
        if isinstance(ref, Ref):
            seen.add(ref.num)
        if v.get("Type") in ("MCR", "OBJR"):
            if parent is not None:
                out[parent][-2 if v["Type"] == "MCR" else -1] = True
            continue
        kind = str(v.get("S", ""))
        for _ in range(16):
            if kind not in roles:
                break
            kind = roles[kind]
        at = v.get("Pg")
        page = page_of.get(at.num, page) if isinstance(at, Ref) else page
        attrs = [doc.dict(a) for a in (doc.get(v.get("A")) if isinstance(doc.get(v.get("A")), list) else [v.get("A")])]
        of = lambda k: next((doc.get(a[k]) for a in attrs if k in a), None)  # noqa: B023, E731
        spans = [x if isinstance(x := of(k), int) else None for k in ("ColSpan", "RowSpan")]
        out.append([n, parent, n, kind, text(doc.get(v.get("Alt"))), text(doc.get(v.get("ActualText"))), text(doc.get(v.get("T"))), text(doc.get(v.get("Lang"))), page, text(of("Summary")), *spans, False, False])
        stack.append((v.get("K"), n, page))
        n += 1
    yield from map(tuple, out)


def rows(path: str, data: bytes, table: str, password: str = "", revision: int | None = None) -> Iterator[tuple]:
    """Rows of one table of one file."""
    if table == "errors":
        for t in SCHEMAS:
            if t != "errors":
                try:
                    for _ in rows(path, data, t, password, revision):
                        pass
                except Exception as e:  # noqa: BLE001 - what is wrong is the result
                    yield path, t, f"{type(e).__name__}: {e}"
        return
    doc = parse(data, password, revision)
    data = doc.data
    pages = page_list(doc)
    page_of = {p["_ref"].num: i + 1 for i, p in enumerate(pages) if isinstance(p.get("_ref"), Ref)}
    encrypted = "Encrypt" in doc.trailer
    if table == "documents":
        info = doc.dict(doc.trailer.get("Info"))
        version = re.search(rb"%PDF-(\d\.\d)", data[:1024])
        form = doc.dict(doc.root.get("AcroForm"))
        js = bool(doc.dict(doc.root.get("Names")).get("JavaScript")) or any(isinstance(o, dict) and (o.get("S") == "JavaScript" or "JS" in o or "JS" in doc.dict(o.get("A"))) for o in doc.objects.values())
        marked = doc.get(doc.dict(doc.root.get("MarkInfo")).get("Marked")) is True
        xfa = None if "XFA" not in form else "dynamic" if doc.get(doc.root.get("NeedsRendering")) is True else "static"
        yield path, len(data), str(doc.get(doc.root.get("Version")) or (version and version[1].decode()) or ""), *(None if not doc.opened else text(doc.get(info.get(k))) for k in ("Title", "Author", "Subject", "Keywords", "Creator", "Producer")), encrypted, marked, js, xfa, doc.warnings, doc.repairs
        return
    if table == "revisions":
        ends = [m.end() for m in re.finditer(rb"%%EOF", data)]
        starts = [int(m[1]) for m in re.finditer(rb"startxref\s+(\d+)", data)]
        for n, (a, b) in enumerate(zip(starts, ends, strict=False), 1):
            yield path, n, a, b
        return
    if table == "objects":
        for n, o in sorted(doc.objects.items()):
            d = o.dict if isinstance(o, Stream) else o if isinstance(o, dict) else {}
            yield path, n, doc.gens.get(n, 0), str(d["Type"]) if isinstance(d.get("Type"), Name) else None, json.dumps(as_json(o), ensure_ascii=False), len(o.raw) if isinstance(o, Stream) else None
        return
    if table == "permissions":
        e = doc.dict(doc.trailer.get("Encrypt"))
        yield path, encrypted, doc.opened, doc.get(e.get("R")), doc.get(e.get("P")) if encrypted else None
        return
    if not doc.opened:
        return
    if table in ("glyphs", "words"):
        for i, p in enumerate(pages):
            got = pdftext.page_glyphs(doc, p, content(doc, p), operators)
            if table == "glyphs":
                for k, (t, r, line, space) in enumerate(got):
                    yield path, i + 1, k, t, r, line, space
                continue
            words: list[list] = []
            for t, r, line, space in got:
                if words and words[-1][2] == line and not space:
                    w = words[-1]
                    w[0] += t
                    w[1] = [min(w[1][0], r[0]), min(w[1][1], r[1]), max(w[1][2], r[2]), max(w[1][3], r[3])]
                else:
                    words.append([t, list(r), line])
            for k, (t, r, line) in enumerate(words):
                yield path, i + 1, k, t, r, line
        return
    if table == "boxes":
        for i, p in enumerate(pages):
            yield path, i + 1, *(_numbers([doc.get(x) for x in doc.list(p.get(k))]) or None for k in ("MediaBox", "CropBox", "BleedBox", "TrimBox", "ArtBox"))
        return
    if table == "structure":
        yield from ((path, *r) for r in structure(doc, page_of))
        return
    if table == "xmp":
        yield from ((path, k, v) for k, v in xmp(doc.stream(doc.root.get("Metadata"))))
        return
    if table == "signatures":
        for name, value in _signature_fields(doc):
            ranges = [x for x in doc.list(value.get("ByteRange")) if isinstance(x, int)]
            covers = len(ranges) == 4 and ranges[0] == 0 and ranges[2] + ranges[3] == len(data)
            yield path, name, bool(value), str(value["SubFilter"]) if "SubFilter" in value else None, text(doc.get(value.get("Name"))), text(doc.get(value.get("Reason"))), text(doc.get(value.get("M"))), ranges or None, covers
        return
    if table == "pages":
        labels = _labels(doc, len(pages))
        for i, p in enumerate(pages):
            box = _numbers(doc.list(p.get("MediaBox"))) or [0.0, 0.0, 612.0, 792.0]
            crop = _numbers(doc.list(p.get("CropBox"))) or None
            yield path, i + 1, labels[i], abs(box[2] - box[0]), abs(box[3] - box[1]), crop, int(doc.get(p.get("Rotate")) or 0) % 360
    elif table in ("annotations", "links"):
        for i, p in enumerate(pages):
            for k, ref in enumerate(doc.list(p.get("Annots"))):
                a = doc.dict(ref)
                sub = str(a.get("Subtype", ""))
                rect = _numbers(doc.list(a.get("Rect")))
                if table == "links" and sub == "Link":
                    act = doc.dict(a.get("A"))
                    s = str(act.get("S", ""))
                    page = _target(doc, a.get("Dest") if "Dest" in a else act.get("D"), page_of) if "Dest" in a or s == "GoTo" else None
                    yield path, i + 1, rect, "page" if page else "uri" if s == "URI" else "other", page, text(doc.get(act.get("URI"))), None if page or s == "URI" else s or None
                elif table == "annotations" and sub not in ("Link", "Widget", "Popup"):
                    quads = _numbers(doc.list(a.get("QuadPoints"))) or []
                    yield path, i + 1, k, sub, text(doc.get(a.get("T"))), text(doc.get(a.get("Contents"))), text(doc.get(a.get("M"))), text(doc.get(a.get("NM"))), text(doc.get(doc.dict(a.get("IRT")).get("NM"))), text(doc.get(a.get("State"))), str(a["IT"]) if "IT" in a else None, rect, _numbers(doc.list(a.get("C"))), [quads[q : q + 8] for q in range(0, len(quads), 8)], bool((doc.get(a.get("F")) or 0) & 128)
    elif table == "fields":
        for f in _fields(doc, page_of):
            yield path, *f
    elif table == "outline":
        stack = [(doc.dict(doc.root.get("Outlines")).get("First"), [0])]
        visited: set[int] = set()
        while stack:
            ref, at = stack.pop()
            node = doc.dict(ref)
            # a bookmark that comes again is a circle
            if not node or (isinstance(ref, Ref) and ref.num in visited):
                continue
            if isinstance(ref, Ref):
                visited.add(ref.num)
            dest = node.get("Dest") if "Dest" in node else doc.dict(node.get("A")).get("D")
            yield path, at, text(doc.get(node.get("Title"))), _target(doc, dest, page_of), (doc.get(node.get("Count")) or 0) > 0
            stack.append((node.get("Next"), [*at[:-1], at[-1] + 1]))
            stack.append((node.get("First"), [*at, 0]))
    elif table == "layers":
        off = {r.num for r in doc.list(doc.dict(doc.dict(doc.root.get("OCProperties")).get("D")).get("OFF")) if isinstance(r, Ref)}
        for r in doc.list(doc.dict(doc.root.get("OCProperties")).get("OCGs")):
            if isinstance(r, Ref):
                yield path, r.num, text(doc.get(doc.dict(r).get("Name"))), r.num not in off
    elif table == "fonts":
        for o in doc.objects.values():
            if isinstance(o, dict) and o.get("Type") == "Font" and "BaseFont" in o:
                name = str(o["BaseFont"])
                desc = doc.dict(o.get("FontDescriptor"))
                enc = doc.get(o.get("Encoding"))
                yield path, name, str(o.get("Subtype", "")), any(k in desc for k in ("FontFile", "FontFile2", "FontFile3")), bool(re.match(r"[A-Z]{6}\+", name)), str(enc) if isinstance(enc, Name) else "custom" if enc else None
    elif table == "attachments":
        for name, spec in _name_tree(doc, doc.dict(doc.root.get("Names")).get("EmbeddedFiles")):
            d = doc.dict(spec)
            body = doc.stream(doc.dict(d.get("EF")).get("F"))
            yield path, text(doc.get(d.get("UF"))) or text(doc.get(d.get("F"))) or name, text(doc.get(d.get("Desc"))), len(body), "document", body
    elif table == "content_ops":
        for i, p in enumerate(pages):
            for k, (op, args) in enumerate(operators(content(doc, p))):
                yield path, i + 1, k, op, repr(args)
    elif table == "text":
        for i, p in enumerate(pages):
            yield path, i + 1, plain_text(doc, p)
    elif table == "scripts":
        for name, act in _name_tree(doc, doc.dict(doc.root.get("Names")).get("JavaScript")):
            js = doc.dict(act).get("JS")
            yield path, name, text(doc.get(js)) if isinstance(doc.get(js), bytes) else doc.stream(js).decode("latin-1")
    elif table == "images":
        for n, o in sorted(doc.objects.items()):
            if isinstance(o, Stream) and o.dict.get("Subtype") == "Image":
                f = doc.get(o.dict.get("Filter"))
                yield path, n, doc.get(o.dict.get("Width")), doc.get(o.dict.get("Height")), ",".join(map(str, f if isinstance(f, list) else [f])) if f else None, len(o.raw), doc.stream(o)
    elif table == "xfa_packets":
        x = doc.get(doc.dict(doc.root.get("AcroForm")).get("XFA"))
        if isinstance(x, list):
            for name, part in zip(x[::2], x[1::2], strict=False):
                yield path, text(doc.get(name)), doc.stream(part).decode("utf-8", "replace")
        elif x is not None:
            yield path, "xdp", doc.stream(x).decode("utf-8", "replace")


class _File(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class PdfReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.table = options.get("table", "documents")
        self.per_task = int(options.get("filespertask", options.get("filesPerTask", "16")))
        self.path = options.get("path", "")
        self.password = options.get("password", "")
        revision = options.get("revision")
        self.revision = int(revision) if revision else None

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files: list[str] = []
        for p in filter(None, self.path.split(",")):
            store, at = _store(p)
            head, _, pattern = at.rpartition("/") if any(c in at for c in "*?[") else (at, "", "")
            info = store.get_file_info(head)
            if info.type == fs.FileType.Directory:
                listed = sorted(x.path for x in store.get_file_info(fs.FileSelector(head, recursive=not pattern)) if x.type == fs.FileType.File)
                files += [_address(p, x) for x in listed if (fnmatch.fnmatch(os.path.basename(x), pattern) if pattern else x.lower().endswith(".pdf"))]
            elif info.type == fs.FileType.File:
                files.append(p)
        return [_File(files[i : i + self.per_task]) for i in range(0, len(files), self.per_task)] or [_File([])]

    def read(self, partition: _File) -> Iterator[tuple]:
        for p in partition.paths:
            store, at = _store(p)
            with store.open_input_stream(at) as f:
                data = f.read()
            yield from safe_rows(p.removeprefix("file://").removeprefix("file:"), data, self.table, self.password, self.revision)


def _store(path: str):
    """The file system of an address and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _address(asked: str, found: str) -> str:
    """The whole address of a file found under an address."""
    scheme, sep, rest = asked.partition("://")
    if not sep or scheme == "file":
        return found
    return f"{scheme}://{rest.partition('/')[0]}{found if found.startswith('/') else '/' + found}" if scheme == "hdfs" else f"{scheme}://{found}"


def safe_rows(path: str, data: bytes, table: str, password: str = "", revision: int | None = None) -> Iterator[tuple]:
    """Rows as far as they can be read. What stops them is in the ``documents`` row and in the ``errors`` table."""
    try:
        yield from rows(path, data, table, password, revision)
    except Exception as e:  # noqa: BLE001 - one broken file must not fail the job
        if table == "documents":
            yield path, len(data), "", *[None] * 6, False, False, False, None, [str(e)], []


class PdfDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "documents")]

    def reader(self, schema) -> DataSourceReader:
        return PdfReader(self.options)


def from_binary(files, table: str, password: str = "", revision: int | None = None):
    """The same over a DataFrame of ``binaryFile``: for stores that only Spark can list, and for streams."""

    def run(frames):
        import pandas as pd

        names = [x.strip().split()[0].strip("`") for x in re.split(r",(?![^<]*>)", SCHEMAS[table])]
        for f in frames:
            out = []
            for p, c in zip(f["path"], f["content"], strict=True):
                out += safe_rows(p, bytes(c), table, password, revision)
            yield pd.DataFrame(out, columns=names)

    return files.select("path", "content").mapInPandas(run, SCHEMAS[table])
