"""Problem 3: personal information in free text.

Method: generators with high recall propose overlapping spans of five kinds, names in any script; boosted trees score each
span by the format of the item and the words around it; thresholds on calibrated probabilities, for each kind the best one
on held-out rows, select the spans, and of overlapping ones the most certain stays. One model for each kind.

There are no labelled rows, so the trees learn from weak labels on a bounded sample (``SAMPLE`` spans of each kind, a
documented parameter): spans whose format is checkable, that an introducing word names, or that fill a form field whose
own name says what it holds are positive; spans after words of serial numbers, prices, versions and the like are
negative; all other spans are unlabelled and only scored. A few made-up sentences of each kind (``EXAMPLES``) are always
among the labelled rows, so every kind has a model, however small the table. Which words are names of persons is learnt
from name fields, over all data, by a join. Everything else covers every row.

Text is read across line ends within a page, with the last line of the page before and the first two of the page after,
so an item that runs on is seen whole; it counts in the line where it begins, and is redacted on both pages. Look-alike and ignorable characters are
read through, and positions lead back to the raw text.

Defined results: null and empty text has no items; a page or field that comes twice counts once; elements of one field
count together; ties between overlapping spans go to the longer one, then to the earlier kind in ``KINDS``.
"""

from __future__ import annotations

import bisect
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .boost import Boosted
from .lookalikes import _BLANK, _IGNORED, PLAIN, TO_LATIN, script_of

KINDS = ("email", "address", "id_number", "phone", "person_name")
SAMPLE = 6000
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}

# Words that introduce items, in the languages of the corpus.
_PHONE_CUES = "phone tel telephone call ring mobile fax llamar telefone telefono teléfono téléphone téléphoner телефон τηλέφωνο rückfragen unter telefon anruf kontakt fon cell".split()
_ID_CUES = "ssn dni nie nif passport licence license identity insurance steuer-id ausweis pasaporte reisepass passeport passaporte insee cpf tax nino паспорт".split()
_NOT_CUES = "serial reference order build version price section table row page chapter invoice isbn item model number room article step figure plot fläche höhe pieces".split()
_TITLES = "Ms Mr Mrs Miss Dr Prof Mme Mlle Frau Herr Sr Sra Señor Señora Srta Dra Dott Sir Pan Pani Fru г-н г-жа Г-н Г-жа господин госпожа Господин Госпожа Κύριος Κυρία κύριος κυρία Κος Κα".split()
_STREET = "street road avenue lane drive close terrace row way court crescent place square boulevard hill gardens grove st rd ave ln dr blvd".split()
_STREET_BEFORE = "calle rue avenida rua via avenue boulevard plaza praça travessa chemin allée place quai улица ул οδός camino paseo".split()
_CLOSED = frozenset(
    "the a an and or but in on at of to for from by with as is was were it we they you he she nobody every some both about between ask call checked see walk follow order serial build contact "
    "der die das ein eine einen dem den des und im am auf hinter vor für ohne trotz nach niemand jemand während später nächste "
    "le la les un une des du de et à au aux dans avant après pendant personne malgré près signé écrire livré "
    "el los las una unos y en al del por según más sin nadie detrás cerca entregar firmado llamar "
    "o os as um uma uns e no na nos nas ao ninguém depois perto antes lá entregar assinado telefone "
    "reply deliver please witnessed pièce documento vorgelegt lieferung unterschrieben bitte flat apt price téléphoner rückfragen escreva escriba".split()
)

EMAIL = re.compile(r"(?<!\w)@\w+|[\w.+-]*\w(?: ?@ ?| ?\(at\) ?| ?\[at\] ?)(?:[\w-]+)(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?)[\w-]+)+", re.I)
PHONE = re.compile(r"(?<![\w.,€$£¬-])(?:\+ ?\d{1,3}[ .-]?)?(?:\(\d{1,5}\)[ .-]?)?\d{1,6}(?:[ .\-/]{1,2}\d{1,6}){1,6}(?: ?(?:ext\.?|x|durchwahl|ramal|доб\.?) ?\d{1,5})?(?![\w]|[.,-]\d)", re.I)
ID = re.compile(
    r"(?<![\w.,-])(?:[A-Z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-Z]|[A-Z]{2}-\d{6}-\d|\d{8}-?[A-Z]|[XYZKLM]-?\d{7}-?[A-Z]?|[A-Z]{5}\d{6}[A-Z0-9]{0,5}|[A-Z]{1,2}\d{6,8}|\d{3}[ -]\d{2}[ -]\d{4,5}|\d{2} \d{3} \d{3} \d{3}|\d{4}-\d{2,3}-\d{3}|\d{9,12})(?![\w]|[.,-]\d)"
)
_CAP = r"[^\W\d_a-zà-öø-ÿ][\w'’-]*"
ADDRESS = re.compile(
    rf"(?:(?:Flat|Apt\.?|Unit|Suite) \d+\w?, )?(?:"
    rf"\d{{1,5}}\w? (?:{_CAP} ){{1,4}}?(?:{'|'.join(x.capitalize() for x in _STREET)})\b\.?"
    rf"|\d{{1,5}},? (?:{'|'.join(_STREET_BEFORE)}) (?:d[eu]s? |de la |del |do |da )?{_CAP}(?: {_CAP})?"
    rf"|(?:{'|'.join(x.capitalize() for x in _STREET_BEFORE)}) (?:d[eu]s? |de la |del |do |da )?{_CAP}(?: {_CAP})?,? \d{{1,5}}\w?"
    rf"|(?:{_CAP} ){{1,3}}?(?:{'|'.join(x.capitalize() for x in _STREET if len(x) > 3)})\b(?! \d)"
    rf"|{_CAP}(?:weg|straße|strasse|str\.|gasse|platz|allee|ring|damm|ufer) \d{{1,5}}\w?"
    rf")(?:, (?:Apt|Flat|Unit|Suite) \w+)?(?:, (?:\d{{4,6}} )?{_CAP}(?: {_CAP})?)?(?:(?:,? [A-Z]{{2}} \d{{4,6}})|(?: [A-Z]{{2}}\d[\dA-Z]? \d[A-Z]{{2}}))?"
)
_TITLE = rf"(?:(?:{'|'.join(_TITLES)})\.? )"


def letters(test: Callable[[str], bool]) -> str:
    """The letters of all scripts that pass a test, as ranges for a character class."""
    out, first, last = [], -1, -2
    for k in range(sys.maxunicode + 1):
        if test(chr(k)):
            if k != last + 1:
                if first >= 0:
                    out.append((first, last))
                first = k
            last = k
    return "".join(f"{chr(a)}-{chr(b)}" if a != b else chr(a) for a, b in [*out, (first, last)])


_UP, _LOW = letters(lambda c: c.isupper() or c.istitle()), letters(str.islower)
#: Letters of scripts without capitals, and the marks that belong to them.
_NO_CASE = letters(lambda c: (c.isalpha() and not (c.isupper() or c.istitle() or c.islower()) and not c.isascii()) or unicodedata.category(c) in ("Mn", "Mc"))
_NAME_WORD = rf"(?:[{_UP}][{_LOW}]+(?:['’-][{_UP}]?[{_LOW}]+)*|[{_UP}]{{2,}}(?:-[{_UP}]{{2,}})*)"
#: A word without capitals is a name where something says so: a title before it, or the name of its field.
_CASELESS = rf"[{_NO_CASE}]+(?:[·-][{_NO_CASE}]+)*"
_ANY_NAME = rf"(?:{_NAME_WORD}|{_CASELESS})"
_INITIAL = rf"[{_UP}]\."
NAMES = (
    re.compile(rf"(?<![\w@.-]){_TITLE}(?:{_INITIAL} ?)?{_ANY_NAME}(?: {_INITIAL})?(?: {_ANY_NAME})?(?![\w@])"),
    re.compile(rf"(?<![\w@.-]){_TITLE}(?:{_INITIAL} ?)?{_ANY_NAME}(?![\w@])"),
    re.compile(rf"(?<![\w@.-]){_NAME_WORD} (?:{_INITIAL} )?{_NAME_WORD}(?![\w@])"),
    re.compile(rf"(?<![\w@.-]){_INITIAL} ?(?:{_INITIAL} ?)?{_NAME_WORD}(?![\w@])"),
    re.compile(rf"(?<![\w@.-]){_NAME_WORD}, {_NAME_WORD}(?: {_INITIAL})?(?![\w@])"),
)
_CASELESS_NAME = re.compile(rf"\s*({_CASELESS}(?:[ ・·]{_CASELESS}){{0,3}})\s*")
_WORDS_OF_NAME = re.compile(_ANY_NAME)
_TITLED = re.compile(_TITLE)
_DIGITS = re.compile(r"\d+")
_CONTEXT = re.compile(r"[^\W\d_][\w'-]*|[^\w\s]")


def read_through(text: str) -> tuple[str, list[int]]:
    """The text with look-alikes and ignorables resolved, and for each of its characters the position in the raw text."""
    if text.isascii():
        return text, list(range(len(text)))
    out, at = [], []
    for i, c in enumerate(text):
        if c < "\x80":
            out.append(c)
            at.append(i)
        elif not _IGNORED.match(c):
            x = " " if _BLANK.match(c) else PLAIN[c]
            out += x
            at += [i] * len(x)
    s = "".join(out)
    if s.isascii():
        return s, at
    for m in re.finditer(r"\S+", s):
        w = m[0]
        if not w.isascii() and any(c in TO_LATIN for c in w):
            scripts = {script_of(c) for c in w} - {""}
            if len(scripts) > 1 or any(c.isdigit() or c == "@" for c in w) or any(script_of(c) == "LATIN" and c in TO_LATIN for c in w):
                for k in range(m.start(), m.end()):
                    out[k] = TO_LATIN.get(s[k], s[k])
    return "".join(out), at


def _groups(x: str) -> str:
    return "-".join(str(len(g)) for g in _DIGITS.findall(x))


_PHONE_SHAPES = ("3-3-4", "1-3-3-4", "5-3-3", "2-4-6", "2-2-2-2-2", "2-1-2-2-2-2", "2-2-5-3", "5-6", "3-4")
_ID_SHAPES = ("3-2-4", "2-3-3-3", "2-2-2", "8", "7", "6", "6-1", "3-2-5", "4-2-3", "9", "11")


def _context(text: str, a: int, b: int) -> tuple[list[str], list[str]]:
    left = [w.lower() for w in _CONTEXT.findall(text[max(0, a - 40) : a])][-4:]
    right = [w.lower() for w in _CONTEXT.findall(text[b : b + 24])][:2]
    return left, right


def _features(kind: str, item: str, left: list[str], right: list[str], whole: bool, cue_field: int) -> list[float]:
    shape = _groups(item)
    n_digits = sum(c.isdigit() for c in item)
    near = set(left)
    last = left[-1] if left else ""
    return [
        n_digits, len(item), shape.count("-"), float(whole), float(cue_field == KINDS.index(kind) + 1), float(cue_field > 0 and cue_field != KINDS.index(kind) + 1),
        float(any(w in near for w in _PHONE_CUES)), float(any(w in near for w in _ID_CUES)), float(any(w in near for w in _NOT_CUES)),
        float("+" in item), float("(" in item), float("." in item), float("-" in item), float(bool(re.search(r"ext|x|durch", item, re.I))),
        float(_PHONE_SHAPES.index(shape) + 1 if shape in _PHONE_SHAPES else 0), float(_ID_SHAPES.index(shape) + 1 if shape in _ID_SHAPES else 0),
        float(sum(c.isupper() for c in item)), float(item[:1].isupper()), float("@" in item), float("," in item), float(last in (":", ",", ".")), float(item.count(" ")),
        float(bool(right) and right[0][0].isalpha()), float(item.isupper()), float(bool(re.match(_TITLE, item))), float(bool(re.search(rf"(?<!\w){_INITIAL}", item))),
    ]


N_FEATURES = 26


def _label(kind: str, item: str, left: list[str], whole: bool, cue_field: int) -> int:
    """Weak label: 1, 0, or -1 for none."""
    near, digits = set(left), [c for c in item if c.isdigit()]
    own, shape = KINDS.index(kind) + 1, _groups(item)
    if cue_field and whole and kind != "person_name":
        return int(cue_field == own)
    if near & set(_NOT_CUES) and kind in ("phone", "id_number"):
        return 0
    if kind == "email":
        return int(not item.startswith("@"))
    if kind == "phone":
        if near & set(_ID_CUES) or len(digits) < 7 or len(digits) > 17:
            return 0
        if near & set(_PHONE_CUES) or item.startswith("+"):
            return 1
        return -1
    if kind == "id_number":
        if near & set(_ID_CUES):
            return 1
        if near & set(_PHONE_CUES) or shape in ("3-2-5", "4-2-3"):
            return 0
        return -1
    if kind == "address":
        return int(bool(digits))
    return -1


def propose(text: str, first: int, last: int, cue_field: int) -> Iterator[tuple[str, int, int, list[str], list[float], int]]:
    """(kind, start, end, words, features, weak label) of all spans that begin in text[first:last]."""
    for kind, pattern in (("email", EMAIL), ("phone", PHONE), ("id_number", ID), ("address", ADDRESS)):
        pos = 0
        while m := pattern.search(text, pos):
            pos = m.end()
            if not first <= m.start() < last or (kind == "phone" and not 7 <= sum(c.isdigit() for c in m[0]) <= 18):
                continue
            left, right = _context(text, m.start(), m.end())
            whole = m.end() - m.start() >= len(text.strip()) - 1
            yield kind, m.start(), m.end(), [], _features(kind, m[0], left, right, whole, cue_field), _label(kind, m[0], left, whole, cue_field)
    seen = set()
    for pattern in NAMES:
        pos = 0
        while m := pattern.search(text, pos):
            pos = m.start() + 1
            while pos < len(text) and text[pos].isalnum():
                pos += 1
            span = m.start(), m.end()
            if span in seen or not first <= m.start() < last:
                continue
            seen.add(span)
            titled = _TITLED.match(m[0])
            words = [w.lower() for w in _WORDS_OF_NAME.findall(m[0][titled.end() if titled else 0 :])]
            if not words or words[0] in _CLOSED or words[-1] in _CLOSED:
                continue
            left, right = _context(text, *span)
            whole = span[1] - span[0] >= len(text.strip()) - 1
            yield "person_name", *span, words, _features("person_name", m[0], left, right, whole, cue_field), _label("person_name", m[0], left, whole, cue_field)
    if cue_field == KINDS.index("person_name") + 1 and (m := _CASELESS_NAME.fullmatch(text, first, last)) and m.span(1) not in seen:
        words = _WORDS_OF_NAME.findall(m[1])
        yield "person_name", *m.span(1), words, _features("person_name", m[1], [], [], True, cue_field), 1


# Words of field names that say what a field holds, in the languages of forms; by index into KINDS plus 1.
FIELD_CUES = {
    1: "email mail kontakt courriel correo", 2: "street address addr adresse anschrift straße strasse rue dirección direccion endereço endereco indirizzo deliver delivery ship residence domicile",
    3: "document id ssn passport licence license identity ausweis tax insurance dni nie nif cpf", 4: "phone mobile tel telephone telefon telefono teléfono telefone fax cell handy portable",
    5: "name surname forename lastname firstname nom prénom nombre apellido apellidos nome sobrenome nachname vorname signed signatory signature applicant contact",
    9: "quantity amount item date code box price total number count sum",
}
_CUE_OF = {n: k for k, names in FIELD_CUES.items() for n in names.split()}
_NAME_PARTS = re.compile(r"[^\W\d_]+?(?=[A-Z_\W\d]|$)")


def field_cue(name: str) -> int:
    """What the last part of a field's name says it holds. Of its words the first that says something counts, an id before a number."""
    parts = [w.lower() for w in _NAME_PARTS.findall(re.sub(r"\[\d+\]$", "", name.rpartition(".")[2]))]
    return next((_CUE_OF[w] for w in parts if w in _CUE_OF), 0)


#: Made-up sentences, each with an item and whether it is one of the kind: what training always has, at every size of table.
EXAMPLES = {
    "email": [("Please write to jane.roe@mail.example today.", "jane.roe@mail.example", 1), ("Contact: tom (at) house.example for more.", "tom (at) house.example", 1), ("Thanks @riverside for the photo.", "@riverside", 0), ("Seen with @oldbridge and others.", "@oldbridge", 0)],
    "phone": [("Call +44 20 7946 0958 before noon.", "+44 20 7946 0958", 1), ("Phone: (212) 555-0142 or write.", "(212) 555-0142", 1), ("Tel. 030 23125 014 in Berlin.", "030 23125 014", 1), ("The serial 4471 220 998 was stamped.", "4471 220 998", 0), ("See build 2024.118.0093 of the tool.", "2024.118.0093", 0), ("Order 118-2207-4431 has shipped.", "118-2207-4431", 0)],
    "id_number": [("Her passport no. L8812047 was shown.", "L8812047", 1), ("SSN 987-65-4320 on file.", "987-65-4320", 1), ("Steuer-ID 12 345 678 903 liegt vor.", "12 345 678 903", 1), ("Invoice 123456789 is paid.", "123456789", 0), ("Item C4412077 of the list.", "C4412077", 0), ("Call 555-01-4233 for help.", "555-01-4233", 0)],
    "address": [("Deliver to 14 Orchard Lane, Westby.", "14 Orchard Lane, Westby", 1), ("Lieferung an Lindenweg 7, 12345 Altstadt.", "Lindenweg 7, 12345 Altstadt", 1), ("We met on Orchard Lane.", "Orchard Lane", 0), ("A walk down Mill Street was nice.", "Mill Street", 0)],
    "person_name": [("Signed by Dr. Anna Lindqvist.", "Dr. Anna Lindqvist", 1), ("Ask Mr Tobias Reed about it.", "Mr Tobias Reed", 1), ("The Northern Railway was closed.", "Northern Railway", 0), ("They visited Grand Harbour twice.", "Grand Harbour", 0)],
}


def examples() -> list[tuple[str, int, list[float]]]:
    """(kind, label, features) of the made-up sentences."""
    out = []
    for kind, rows in EXAMPLES.items():
        for text, item, label in rows:
            a = text.index(item)
            left, right = _context(text, a, a + len(item))
            known = [float(label) * 2, 0.0, 0.0, float(label) * 2] if kind == "person_name" else [0.0] * 4
            out.append((kind, label, _features(kind, item, left, right, False, 0) + known))
    return out


_SPANS = (
    "src string, doc_id bigint, page int, name string, kind string, first int, last int, words array<string>, features array<float>, label int, parts array<struct<page:int,line:int,a:int,b:int>>, text string"
)
_PART = pa.struct([("page", pa.int32()), ("line", pa.int32()), ("a", pa.int32()), ("b", pa.int32())])
_SPAN_TYPES = (
    pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.float32()), pa.int32(), pa.list_(_PART), pa.string(),
)
_SPAN_NAMES = ("src", "doc_id", "page", "name", "kind", "first", "last", "words", "features", "label", "parts", "text")


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[] for _ in _SPAN_NAMES]
        for src, doc, page, name, before, lines, after in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
            cue = field_cue(name) if src == "fields" else 0
            text, starts, nums, maps = "", [], [], []
            for step, group in ((-1, before or []), (0, lines or []), (1, after or [])):
                for x in group:
                    s, at = read_through(x["text"] or "")
                    starts.append(len(text))
                    nums.append((page + step, x["line"]))
                    maps.append(at)
                    # elements of a field stand apart, lines of a page run on
                    text += s + ("\n" if src == "fields" else " ")
            mine = [k for k, (p, _) in enumerate(nums) if p == page]
            if not mine:
                continue
            lo, hi = starts[mine[0]], starts[mine[-1] + 1] if mine[-1] + 1 < len(starts) else len(text)
            for kind, a, z, words, feats, label in propose(text, lo, hi, cue):
                parts = []
                k = bisect.bisect_right(starts, a) - 1
                while k < len(starts) and starts[k] < z:
                    at = maps[k]
                    i, j = max(a - starts[k], 0), min(z - starts[k], len(at))
                    if i < j:
                        parts.append({"page": nums[k][0], "line": nums[k][1], "a": at[i], "b": at[j - 1] + 1})
                    k += 1
                if not parts:
                    continue
                for col, x in zip(out, (src, doc, page, name, kind, a, z, words, feats, label, parts, text[a:z]), strict=True):
                    col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _SPAN_TYPES, strict=True)], names=list(_SPAN_NAMES))


def texts(line_units: DataFrame, field_units: DataFrame) -> DataFrame:
    """``(src, doc_id, page, name, before, lines, after)``: pages with the edges of their neighbours, and fields."""
    pages = line_units.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("lines"))
    edges = pages.select("doc_id", (F.col("page") + 1).alias("page"), F.slice("lines", -1, 1).alias("before"), F.lit(None).cast("array<struct<line:int,text:string>>").alias("after")).unionByName(
        pages.select("doc_id", (F.col("page") - 1).alias("page"), F.lit(None).cast("array<struct<line:int,text:string>>").alias("before"), F.slice("lines", 1, 2).alias("after"))
    )
    edges = edges.groupBy("doc_id", "page").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    whole = pages.join(edges, ["doc_id", "page"], "left").select(F.lit("glyphs").alias("src"), "doc_id", "page", F.lit("").alias("name"), "before", "lines", "after")
    none = F.lit(None).cast("array<struct<line:int,text:string>>")
    fields = field_units.groupBy("doc_id", "name").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("lines"))
    return whole.unionByName(fields.select(F.lit("fields").alias("src"), "doc_id", F.lit(-1).alias("page"), "name", none.alias("before"), "lines", none.alias("after")))


def spans(all_texts: DataFrame) -> DataFrame:
    return all_texts.mapInArrow(_propose, _SPANS)


def name_words(proposed: DataFrame) -> DataFrame:
    """``(word, n_first, n_last)``: how often a word begins or ends the value of a name field, over all data."""
    named = proposed.where((F.col("kind") == "person_name") & (F.col("features")[3] > 0) & (F.col("features")[4] > 0) & (F.size("words") > 1))
    comma = F.col("features")[19] > 0
    first, last = F.element_at("words", 1), F.element_at("words", -1)
    pairs = F.array(F.struct(F.when(comma, last).otherwise(first).alias("word"), F.lit(1).alias("f")), F.struct(F.when(comma, first).otherwise(last).alias("word"), F.lit(0).alias("f")))
    return named.select(F.inline(pairs)).groupBy("word").agg(F.sum("f").alias("n_first"), F.sum(1 - F.col("f")).alias("n_last"))


def with_names(proposed: DataFrame) -> DataFrame:
    """Spans with ``named``: name-field counts of their first and last word, joined in the JVM on the word."""
    stats = name_words(proposed)
    s = proposed.withColumn("w1", F.get("words", F.lit(0))).withColumn("w2", F.when(F.size("words") > 1, F.element_at("words", -1)))
    a = stats.select(F.col("word").alias("w1"), F.col("n_first").alias("f1"), F.col("n_last").alias("l1"))
    b = stats.select(F.col("word").alias("w2"), F.col("n_first").alias("f2"), F.col("n_last").alias("l2"))
    names, rest = s.where("kind = 'person_name'"), s.where("kind <> 'person_name'")
    named = F.array(*(F.least(F.coalesce(F.col(c), F.lit(0)), F.lit(5)).cast("float") for c in ("f1", "l1", "f2", "l2")))
    joined = names.join(a.hint("merge"), "w1", "left").join(b.hint("merge"), "w2", "left").withColumn("features", F.concat("features", named))
    f, comma, titled = F.col("features"), F.col("features")[19] > 0, F.col("features")[24] > 0
    known_first = F.when(comma, f[N_FEATURES + 2] > f[N_FEATURES + 3]).otherwise(f[N_FEATURES] > f[N_FEATURES + 1])
    initial = f[25] > 0
    label = (
        F.when(titled & (F.size("words") <= 2), 1)
        .when(known_first & (F.size("words") == 2), 1)
        .when(initial & (F.size("words") == 1) & (f[N_FEATURES] + f[N_FEATURES + 1] > 0), 1)
        .when(~titled & ~initial & (f[N_FEATURES] + f[N_FEATURES + 1] + f[N_FEATURES + 2] + f[N_FEATURES + 3] == 0), 0)
        .when(comma & ~known_first, 0)
        .when(~titled & (F.size("words") == 2) & (f[N_FEATURES] == 0), 0)
        .otherwise(-1)
    )
    joined = joined.withColumn("label", label.cast("int"))
    rest = rest.withColumn("features", F.concat("features", F.array(*[F.lit(0.0).cast("float")] * 4)))
    cols = [*_SPAN_NAMES]
    return joined.select(cols).unionByName(rest.select(cols))


def fit(proposed: DataFrame, sample: int = SAMPLE) -> dict[str, Boosted]:
    """One model for each kind, from at most about ``sample`` weakly labelled spans of each kind and label."""
    labelled = proposed.where("label >= 0").select("kind", "label", "features", F.pmod(F.xxhash64("text", "doc_id", "first"), F.lit(1_000_000)).alias("h"))
    sizes = {(r[0], r[1]): r[2] for r in labelled.groupBy("kind", "label").count().collect()}
    keep = F.lit(False)
    for (kind, label), n in sizes.items():
        keep = keep | ((F.col("kind") == kind) & (F.col("label") == label) & (F.col("h") < int(1_000_000 * min(1.0, sample / n))))
    rows = labelled.where(keep).orderBy("kind", "h", "label").collect() if sizes else []
    made = examples()
    models = {}
    for kind in KINDS:
        mine = [(r[1], r[2], r[3] % 10 < 3) for r in rows if r[0] == kind]
        # the made-up rows train and are held out
        mine += [(label, x, held) for k, label, x in made if k == kind for held in (False, True)]
        models[kind] = Boosted().fit(np.array([x for _, x, _ in mine], float), np.array([y for y, _, _ in mine], float), np.array([h for _, _, h in mine]))
    return models


def select(proposed: DataFrame, models: dict[str, Boosted]) -> DataFrame:
    """The spans above the threshold of their kind, of overlapping ones the most certain: ``src, doc_id, page, name, kind, parts``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = np.array(b.column("kind").to_pylist(), object)
            x = np.array(b.column("features").to_pylist(), float).reshape(len(kinds), -1)
            p, keep = np.zeros(len(kinds)), np.zeros(len(kinds), bool)
            for kind, model in models.items():
                if (rows := kinds == kind).any():
                    p[rows] = model.probability(x[rows])
                    keep[rows] = p[rows] >= model.threshold
            b, p = b.filter(pa.array(keep)), p[keep]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("src", "doc_id", "page", "name", "kind", "first", "last", "parts")), pa.array(p)], names=["src", "doc_id", "page", "name", "kind", "first", "last", "parts", "p"])

    ddl = "src string, doc_id bigint, page int, name string, kind string, first int, last int, parts array<struct<page:int,line:int,a:int,b:int>>, p double"
    scored = proposed.select("src", "doc_id", "page", "name", "kind", "first", "last", "parts", "features").mapInArrow(score, ddl)
    # the best span of a text stays, then the best that doesn't overlap it, and so on
    per = scored.groupBy("src", "doc_id", "page", "name").agg(F.collect_list(F.struct("kind", "first", "last", "parts", "p")).alias("s"))
    return per.mapInArrow(_resolve, "src string, doc_id bigint, page int, name string, kind string, parts array<struct<page:int,line:int,a:int,b:int>>")


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[] for _ in range(6)]
        for src, doc, page, name, found in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            taken: list[tuple[int, int]] = []
            for x in sorted(found, key=lambda x: (KINDS.index(x["kind"]) > 1, -round(x["p"], 2), x["first"] - x["last"], KINDS.index(x["kind"]), x["first"])):
                i = bisect.bisect_left(taken, (x["first"], x["last"]))
                if (i and taken[i - 1][1] > x["first"]) or (i < len(taken) and taken[i][0] < x["last"]):
                    continue
                taken.insert(i, (x["first"], x["last"]))
                for col, v in zip(out, (src, doc, page, name, x["kind"], x["parts"]), strict=True):
                    col.append(v)
        types = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(_PART))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["src", "doc_id", "page", "name", "kind", "parts"])


def detect(line_units: DataFrame, field_units: DataFrame) -> DataFrame:
    """All items: ``src, doc_id, page, name, kind, parts`` (parts: page, line and raw positions, the line of the first is where it begins)."""
    proposed = stored(with_names(stored(spans(texts(line_units, field_units)), "p3-spans")), "p3-named")
    return select(proposed, fit(proposed))


def redacted(units: DataFrame, items: DataFrame) -> DataFrame:
    """``src, doc_id, page, line, name, text, redacted``: every text with an item, each item replaced by its placeholder.

    An item that runs over a line or page end leaves its placeholder in its first line and nothing in the next.
    """
    p = items.select("src", "doc_id", "name", "kind", F.posexplode("parts").alias("k", "part")).select(
        "src", "doc_id", F.col("part.page").alias("page"), "name", F.col("part.line").alias("line"), F.struct(F.col("part.a").alias("a"), F.col("part.b").alias("b"), F.when(F.col("k") == 0, F.concat(F.lit("["), F.upper("kind"), F.lit("]"))).otherwise("").alias("by")).alias("cut")
    )
    cuts = p.groupBy("src", "doc_id", "page", "line", "name").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    done = F.aggregate(
        "cuts", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        # the end of an item of the page before may lie over one of this page
        lambda acc, c: F.struct(F.greatest(acc["at"], c["b"]).alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.greatest(c["a"] - acc["at"], F.lit(0))), c["by"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    return units.join(cuts, ["src", "doc_id", "page", "line", "name"]).select("src", "doc_id", "page", "line", "name", "text", done.alias("redacted"))
