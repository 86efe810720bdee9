"""Form data files as rows ``path, seq, name, value``: XFDF, FDF, XML, CSV and TSV, one field value a row, in the order of the file.

Files are read whole as binary rows (``binaryFile``), so a listing runs on the cluster and no task sees more than its files.

Defined results: a file that is none of these or is damaged gives no rows; of CSV and TSV the header names the fields and
the first record counts; a field of several values has a row for each; byte order marks are dropped.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FDF_TEXT = r"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>(?!>)"
_FDF_FIELD = re.compile(rf"/(T|V|Kids)\s*({_FDF_TEXT}|\[|/[^\s/<>\[\]()]+)?|<<|>>|\]", re.S)
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
_SPACES = re.compile(r"\{[^}]*\}")


def _decode(data: bytes) -> str:
    if data[:2] == b"\xfe\xff":
        return data[2:].decode("utf-16-be", "replace")
    if data[:3] == b"\xef\xbb\xbf":
        return data[3:].decode("utf-8", "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _fdf_text(token: str) -> str:
    if token.startswith("/"):
        return token[1:]
    if token.startswith("<"):
        raw = re.sub(r"\s", "", token[1:-1])
        return _decode(bytes.fromhex(raw + "0" * (len(raw) % 2)))
    text = re.sub(r"\\(\r\n|\r|\n|[0-7]{1,3}|.)", lambda m: "" if m[1] in "\r\n" or m[1] == "\r\n" else chr(int(m[1], 8)) if m[1][0] in "01234567" else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    try:
        return _decode(text.encode("latin-1"))
    except UnicodeEncodeError:
        return text


def read_fdf(data: bytes) -> Iterator[tuple[str, str]]:
    """Names and values of nested field dictionaries; a name continues that of the field it is in."""
    text = data.decode("latin-1")
    at = text.find("/Fields")
    stack: list[dict] = []
    pending: list[str] | None = None
    for m in _FDF_FIELD.finditer(text, max(at, 0)) if at >= 0 else ():
        if pending is not None and m[0] not in ("]",):
            pending = None
        if m[0] == "<<":
            stack.append({"name": None, "values": None})
        elif m[0] == ">>" and stack:
            top = stack.pop()
            if top["values"] is not None and top["name"] is not None:
                full = ".".join([x["name"] for x in stack if x["name"]] + [top["name"]])
                yield from ((full, v) for v in top["values"])
        elif m[1] == "T" and m[2] and stack:
            stack[-1]["name"] = _fdf_text(m[2])
        elif m[1] == "V" and m[2] and stack:
            if m[2] == "[":
                end = text.find("]", m.end())
                stack[-1]["values"] = [_fdf_text(t) for t in re.findall(_FDF_TEXT, text[m.end() : end if end >= 0 else len(text)], re.S)]
            else:
                stack[-1]["values"] = [_fdf_text(m[2])]


def read_xfdf(data: bytes) -> Iterator[tuple[str, str]]:
    def walk(e: ET.Element, up: str) -> Iterator[tuple[str, str]]:
        for f in e:
            if _SPACES.sub("", f.tag) == "field":
                name = f.get("name", "")
                full = f"{up}.{name}" if up else name
                for v in f:
                    if _SPACES.sub("", v.tag) == "value":
                        yield full, "".join(v.itertext())
                yield from walk(f, full)

    root = ET.fromstring(data)
    for fields in root:
        if _SPACES.sub("", fields.tag) == "fields":
            yield from walk(fields, "")


def read_xml(data: bytes) -> Iterator[tuple[str, str]]:
    """Leaves of a data file, named by the elements above them without the root; the first record where the root repeats one."""
    root = ET.fromstring(data)
    kids = list(root)
    if len(kids) > 1 and len({k.tag for k in kids}) == 1 and any(len(k) for k in kids):
        root = kids[0]

    def walk(e: ET.Element, up: str) -> Iterator[tuple[str, str]]:
        for k in e:
            name = _SPACES.sub("", k.tag)
            full = f"{up}.{name}" if up else name
            if len(k):
                yield from walk(k, full)
            else:
                yield full, k.text or ""

    yield from walk(root, "")


def read_table(data: bytes, delimiter: str) -> Iterator[tuple[str, str]]:
    rows = csv.reader(io.StringIO(_decode(data), newline=""), delimiter=delimiter)
    header, record = next(rows, []), next(rows, [])
    yield from zip(header, record, strict=False)


def read_any(path: str, data: bytes) -> list[tuple[str, str]]:
    """Names and values of a file, whatever kind it is."""
    head, low = data[:2048].lstrip(b"\xef\xbb\xbf \r\n\t"), path.lower()
    try:
        if b"%FDF-" in head:
            return list(read_fdf(data))
        if head.startswith(b"<"):
            return list(read_xfdf(data) if re.search(rb"<(?:\w+:)?xfdf\b", head) else read_xml(data))
        if low.endswith((".tsv", ".tab")) or (low.endswith(".txt") and b"\t" in head):
            return list(read_table(data, "\t"))
        if low.endswith(".csv"):
            return list(read_table(data, ","))
    except (ET.ParseError, csv.Error, ValueError):
        return []
    return []


_COMMENT = "path string, seq int, page int, subtype string, name string, author string, in_reply_to string, state string, contents string, rect array<double>"


def read_comments(data: bytes) -> Iterator[tuple]:
    """(page from 1, subtype, name, author, in_reply_to, state, contents, rect) of the comments in an XFDF file."""
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        return
    for annots in root:
        if _SPACES.sub("", annots.tag) != "annots":
            continue
        for e in annots:
            page, rect = e.get("page", ""), [x for x in e.get("rect", "").split(",") if re.fullmatch(r"-?[\d.]+", x)]
            text = next(("".join(k.itertext()) for k in e if _SPACES.sub("", k.tag) == "contents"), None)
            yield int(page) + 1 if page.isdigit() else None, _SPACES.sub("", e.tag), e.get("name"), e.get("title"), e.get("inreplyto"), e.get("state"), text, [float(x) for x in rect] if len(rect) == 4 else None


def comments(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """The comments of XFDF files in binary rows, in the order of the file."""
    types = (pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 6, pa.list_(pa.float64()))
    names = ["path", "seq", "page", "subtype", "name", "author", "in_reply_to", "state", "contents", "rect"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, i, *r) for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if p is not None and data for i, r in enumerate(read_comments(data))]
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return files.select(F.col(path), F.col(content).cast("binary")).mapInArrow(run, _COMMENT)


_OUT = "path string, seq int, name string, value string"


def parse(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, seq, name, value`` of binary rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, i, n, v) for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if p is not None and data for i, (n, v) in enumerate(read_any(p, data))]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["path", "seq", "name", "value"])

    return files.select(F.col(path), F.col(content).cast("binary")).mapInArrow(run, _OUT)


def load(spark: SparkSession, folder: str, glob: str = "*.{fdf,xfdf,xml,csv,tsv,tab,txt}") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return parse(files)


def datasets(raw: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """``key, seq, name, value``: leaves of the data packet of form documents, named by the elements above them."""

    def leaves(text: str) -> list[tuple[str, str]]:
        try:
            root = ET.fromstring(text)
        except ET.ParseError:
            return []
        found = next((e for e in root.iter() if _SPACES.sub("", e.tag) == "data"), root)
        return list(read_xml(ET.tostring(found)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, i, n, v) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for i, (n, v) in enumerate(leaves(t))]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], names=[key, "seq", "name", "value"])

    return raw.select(F.col(key).cast("bigint").alias(key), xml).mapInArrow(run, f"`{key}` bigint, seq int, name string, value string")
