"""Text of PDF pages with its place: fonts to characters and widths, content to glyphs, glyphs to lines and words.

Glyphs come out of the content with their boxes in view space (origin at the top left of the shown page). Runs of glyphs
on one baseline make segments, segments beside each other lines; lines go from top to bottom, and within columns where
segments are separated by a wide gap all the way. Text from right to left is turned round.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

# Names of signs in font encodings; letters and their accents are read off the name by rule.
_SIGNS = dict(
    zip(
        "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash zero one two three four five six seven eight nine colon semicolon less equal greater question at bracketleft backslash bracketright asciicircum underscore grave braceleft bar braceright asciitilde".split(),
        " !\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~",
        strict=True,
    )
) | dict(
    zip(
        "quoteleft quoteright quotedblleft quotedblright quotesinglbase quotedblbase endash emdash bullet ellipsis dagger daggerdbl perthousand guilsinglleft guilsinglright guillemotleft guillemotright Euro sterling yen cent currency section paragraph copyright registered trademark degree plusminus multiply divide periodcentered exclamdown questiondown fraction minus mu germandbls ae AE oe OE oslash Oslash lslash Lslash dotlessi eth Eth thorn Thorn onehalf onequarter threequarters ordfeminine ordmasculine nbspace sfthyphen fi fl ff ffi ffl".split(),
        ["‘", "’", "“", "”", "‚", "„", "–", "—", "•", "…", "†", "‡", "‰", "‹", "›", "«", "»", "€", "£", "¥", "¢", "¤", "§", "¶", "©", "®", "™", "°", "±", "×", "÷", "·", "¡", "¿", "⁄", "−", "µ", "ß", "æ", "Æ", "œ", "Œ", "ø", "Ø", "ł", "Ł", "ı", "ð", "Ð", "þ", "Þ", "½", "¼", "¾", "ª", "º", "\xa0", "\xad", "fi", "fl", "ff", "ffi", "ffl"],
        strict=True,
    )
)
_ACCENTS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "caron": "̌", "ring": "̊", "cedilla": "̧", "ogonek": "̨", "macron": "̄", "breve": "̆", "dotaccent": "̇", "hungarumlaut": "̋"}


def glyph_text(name: str) -> str:
    """What a glyph of that name shows, or nothing."""
    base = name.partition(".")[0]
    if base in _SIGNS:
        return _SIGNS[base]
    if len(base) == 1:
        return base
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", base):
        codes = [m[1][i : i + 4] for i in range(0, len(m[1]), 4)] if m[1] else [m[2]]
        return "".join(chr(int(c, 16)) for c in codes if int(c, 16) < 0x110000)
    if (m := re.fullmatch(r"([A-Za-z])(\w+)", base)) and m[2] in _ACCENTS:
        return unicodedata.normalize("NFC", m[1] + _ACCENTS[m[2]])
    for script in ("GREEK", "CYRILLIC"):
        try:
            return unicodedata.lookup(f"{script} {'SMALL' if base.islower() else 'CAPITAL'} LETTER {base.upper()}")
        except KeyError:
            continue
    return ""


_ENCODINGS = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman", "PDFDocEncoding": "latin-1", "StandardEncoding": "latin-1"}


@dataclass
class Font:
    two_bytes: bool
    chars: dict[int, str]
    widths: dict[int, float]
    default: float
    encoding: str
    ascent: float
    descent: float

    def codes(self, data: bytes) -> Iterator[int]:
        if self.two_bytes:
            yield from (int.from_bytes(data[i : i + 2], "big") for i in range(0, len(data) - 1, 2))
        else:
            yield from data

    def char(self, code: int) -> str:
        if code in self.chars:
            return self.chars[code]
        if self.two_bytes:
            return ""
        return bytes([code]).decode(self.encoding, "replace").replace("�", "")

    def width(self, code: int) -> float:
        return self.widths.get(code, self.default)


def _cmap(data: bytes) -> tuple[dict[int, str], int]:
    """Codes to text of a character map, and how many bytes its codes have."""
    out: dict[int, str] = {}
    size = 1
    show = lambda h: bytes.fromhex(h + "0" * (len(h) % 2)).decode("utf-16-be", "replace")
    t = data.decode("latin-1")
    for m in re.finditer(r"begincodespacerange(.*?)endcodespacerange", t, re.S):
        for h in re.findall(r"<([0-9A-Fa-f]+)>", m[1]):
            size = max(size, len(h) // 2)
    for m in re.finditer(r"beginbfchar(.*?)endbfchar", t, re.S):
        for a, b in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]*)>", m[1]):
            out[int(a, 16)] = show(b)
    for m in re.finditer(r"beginbfrange(.*?)endbfrange", t, re.S):
        for a, b, c, many in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]*)>|\[(.*?)\])", m[1], re.S):
            lo, hi = int(a, 16), min(int(b, 16), int(a, 16) + 0xFFFF)
            if many:
                for i, h in enumerate(re.findall(r"<([0-9A-Fa-f]*)>", many)[: hi - lo + 1]):
                    out[lo + i] = show(h)
            elif c:
                first = show(c)
                for i in range(hi - lo + 1):
                    last = ord(first[-1]) + i if first else 0
                    if first and last < 0x110000:
                        out[lo + i] = first[:-1] + chr(last)
    return out, size


def font(doc, ref) -> Font:
    d = doc.dict(ref)
    chars: dict[int, str] = {}
    size = 1
    if doc.get(d.get("ToUnicode")) is not None:
        chars, size = _cmap(doc.stream(d["ToUnicode"]))
    composite = d.get("Subtype") == "Type0"
    number = lambda v, other: v if isinstance(v := doc.get(v), (int, float)) else other
    widths: dict[int, float] = {}
    encoding = "cp1252"
    if composite:
        inner = doc.dict(doc.list(d.get("DescendantFonts"))[0]) if doc.list(d.get("DescendantFonts")) else {}
        desc, default = doc.dict(inner.get("FontDescriptor")), number(inner.get("DW"), 1000)
        w, i = [doc.get(x) for x in doc.list(inner.get("W"))], 0
        while i + 1 < len(w):
            if isinstance(w[i + 1], list):
                widths |= {w[i] + k: float(number(x, 0)) for k, x in enumerate(w[i + 1])} if isinstance(w[i], int) else {}
                i += 2
            elif i + 2 < len(w) and isinstance(w[i], int) and isinstance(w[i + 1], int):
                widths |= dict.fromkeys(range(w[i], min(w[i + 1], w[i] + 0xFFFF) + 1), float(number(w[i + 2], 0)))
                i += 3
            else:
                break
    else:
        desc = doc.dict(d.get("FontDescriptor"))
        default = number(desc.get("MissingWidth"), 0) or 500
        first = number(d.get("FirstChar"), 0)
        widths = {int(first) + k: float(number(x, 0)) for k, x in enumerate(doc.list(d.get("Widths")))}
        enc = doc.get(d.get("Encoding"))
        base = enc.get("BaseEncoding") if isinstance(enc, dict) else enc
        encoding = _ENCODINGS.get(str(base), "cp1252")
        at = 0
        for x in doc.list(enc.get("Differences")) if isinstance(enc, dict) else []:
            x = doc.get(x)
            if isinstance(x, int):
                at = x
            else:
                chars.setdefault(at, glyph_text(str(x)))
                at += 1
    up, down = number(desc.get("Ascent"), 0), number(desc.get("Descent"), 0)
    return Font(composite and (size == 2 or not chars), chars, widths, float(default), encoding, up / 1000 if up else 0.8, down / 1000 if down else -0.2)


def times(m, n):
    """Matrix of m first, then n."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def shown(doc, data: bytes, resources: dict, operators, matrix=UNIT, depth: int = 0) -> Iterator[tuple[str, tuple[float, ...], float]]:
    """(text, box in user space, size) of every glyph in the order of the content; forms are entered."""
    ctm, stack = matrix, []
    tm = line = UNIT
    state = {"font": None, "size": 0.0, "tc": 0.0, "tw": 0.0, "tz": 1.0, "tl": 0.0, "ts": 0.0}
    fonts: dict[str, Font] = {}
    num = lambda args, n: len(args) >= n and all(isinstance(x, (int, float)) for x in args[-n:])

    def show(data: bytes) -> Iterator[tuple[str, tuple[float, ...], float]]:
        nonlocal tm
        f, size = state["font"], state["size"]
        if f is None:
            return
        for code in f.codes(data):
            t, w = f.char(code), f.width(code) / 1000
            m = times((size * state["tz"], 0, 0, size, 0, state["ts"]), times(tm, ctm))
            corners = [(x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]) for x in (0, w) for y in (f.descent, f.ascent)]
            xs, ys = [p[0] for p in corners], [p[1] for p in corners]
            if t:
                yield t, (min(xs), min(ys), max(xs), max(ys)), (m[2] ** 2 + m[3] ** 2) ** 0.5
            step = (w * size + state["tc"] + (state["tw"] if code == 32 and not f.two_bytes else 0)) * state["tz"]
            tm = times((1, 0, 0, 1, step, 0), tm)

    for op, args in operators(data):
        if op == "q":
            stack.append((ctm, dict(state)))
        elif op == "Q" and stack:
            ctm, state = stack.pop()
        elif op == "cm" and num(args, 6):
            ctm = times(tuple(args[-6:]), ctm)
        elif op == "BT":
            tm = line = UNIT
        elif op == "Tf" and len(args) >= 2 and isinstance(args[-1], (int, float)):
            name = str(args[-2])
            if name not in fonts:
                ref = doc.dict(resources.get("Font")).get(name)
                fonts[name] = font(doc, ref)
            state["font"], state["size"] = fonts[name], float(args[-1])
        elif op in ("Tc", "Tw", "Tz", "TL", "Ts") and num(args, 1):
            state[op.lower()] = args[-1] / 100 if op == "Tz" else float(args[-1])
        elif op in ("Td", "TD") and num(args, 2):
            if op == "TD":
                state["tl"] = -float(args[-1])
            tm = line = times((1, 0, 0, 1, args[-2], args[-1]), line)
        elif op == "Tm" and num(args, 6):
            tm = line = tuple(map(float, args[-6:]))
        elif op in ("T*", "'", '"'):
            tm = line = times((1, 0, 0, 1, 0, -state["tl"]), line)
            if op == '"' and len(args) >= 3 and num(args[:2], 2):
                state["tw"], state["tc"] = float(args[0]), float(args[1])
            if op != "T*" and args and isinstance(args[-1], bytes):
                yield from show(args[-1])
        elif op == "Tj" and args and isinstance(args[-1], bytes):
            yield from show(args[-1])
        elif op == "TJ" and args and isinstance(args[-1], list):
            for x in args[-1]:
                if isinstance(x, bytes):
                    yield from show(x)
                elif isinstance(x, (int, float)):
                    tm = times((1, 0, 0, 1, -x / 1000 * state["size"] * state["tz"], 0), tm)
        elif op == "Do" and args and depth < 12:
            form = doc.dict(resources.get("XObject")).get(str(args[-1]))
            d = doc.dict(form)
            if d.get("Subtype") == "Form":
                own = [doc.get(x) for x in doc.list(d.get("Matrix"))]
                inner = times(tuple(own), ctm) if len(own) == 6 and num(own, 6) else ctm
                yield from shown(doc, doc.stream(form), doc.dict(d.get("Resources")) or resources, operators, inner, depth + 1)


def to_view(box: tuple[float, ...], crop: list[float], rotation: int) -> list[float]:
    x0, y0, x1, y1 = crop

    def point(x: float, y: float) -> tuple[float, float]:
        return {90: (y - y0, x - x0), 180: (x1 - x, y - y0), 270: (y1 - y, x1 - x)}.get(rotation, (x - x0, y1 - y))

    a, b = point(box[0], box[1]), point(box[2], box[3])
    return [min(a[0], b[0]), min(a[1], b[1]), max(a[0], b[0]), max(a[1], b[1])]


def layout(glyphs: list[tuple[str, list[float], float]]) -> list[tuple[str, list[float], int, bool]]:
    """(text, rect, line, space_before) in reading order, of glyphs (text, rect in view space, size)."""
    segments: list[list[tuple[str, list[float], float]]] = []
    for g in glyphs:
        _, r, size = g
        last = segments[-1][-1] if segments else None
        same = last is not None and abs((last[1][1] + last[1][3]) - (r[1] + r[3])) < max(size, last[2]) and -0.5 * size < r[0] - last[1][2] < 1.5 * size
        if same:
            segments[-1].append(g)
        else:
            segments.append([g])
    boxes = [(min(g[1][0] for g in s), min(g[1][1] for g in s), max(g[1][2] for g in s), max(g[1][3] for g in s)) for s in segments]

    def order(ids: list[int]) -> list[list[int]]:
        """Lines of segments: columns where a gap runs through all of them, else by height."""
        if len(ids) > 3:
            edges = sorted((boxes[i][0], boxes[i][2]) for i in ids)
            reach = edges[0][1]
            size = sorted(boxes[i][3] - boxes[i][1] for i in ids)[len(ids) // 2]
            for a, b in edges[1:]:
                if a - reach > 1.5 * size:
                    left = [i for i in ids if boxes[i][2] <= reach]
                    right = [i for i in ids if boxes[i][2] > reach]
                    if len(left) > 1 and len(right) > 1:
                        return order(left) + order(right)
                reach = max(reach, b)
        lines: list[list[int]] = []
        for i in sorted(ids, key=lambda i: (boxes[i][1] + boxes[i][3], boxes[i][0])):
            mid = (boxes[i][1] + boxes[i][3]) / 2
            if lines and boxes[lines[-1][0]][1] < mid < boxes[lines[-1][0]][3]:
                lines[-1].append(i)
            else:
                lines.append([i])
        return [sorted(x, key=lambda i: boxes[i][0]) for x in lines]

    out = []
    for n, ids in enumerate(order(list(range(len(segments))))):
        row = sorted((g for i in ids for g in segments[i]), key=lambda g: g[1][0])
        letters = "".join(g[0] for g in row)
        backwards = sum(unicodedata.bidirectional(c) in ("R", "AL") for c in letters)
        if backwards * 2 > sum(c.isalpha() for c in letters) and backwards:
            row.reverse()
        before, pending = None, False
        for t, r, size in row:
            if not t.strip():
                pending = before is not None
                continue
            gap = 0.0 if before is None else max(r[0] - before[2], before[0] - r[2])
            out.append((t, r, n, before is not None and (pending or gap > 0.2 * size)))
            before, pending = r, False
    return out


def page_glyphs(doc, page: dict, data: bytes, operators) -> list[tuple[str, list[float], int, bool]]:
    numbers = lambda v: [float(x) for x in v if isinstance(x, (int, float))]
    media = numbers([doc.get(x) for x in doc.list(page.get("MediaBox"))])
    crop = numbers([doc.get(x) for x in doc.list(page.get("CropBox"))])
    box = crop if len(crop) == 4 else media if len(media) == 4 else [0.0, 0.0, 612.0, 792.0]
    box = [min(box[0], box[2]), min(box[1], box[3]), max(box[0], box[2]), max(box[1], box[3])]
    turn = doc.get(page.get("Rotate"))
    rotation = int(turn) % 360 if isinstance(turn, (int, float)) else 0
    return layout([(t, to_view(b, box, rotation), size) for t, b, size in shown(doc, data, doc.dict(page.get("Resources")), operators)])
