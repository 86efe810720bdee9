"""Formats, checks and calculations of form fields as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_GROUP = {0: (",", "."), 1: ("", "."), 2: (".", ","), 3: ("", ","), 4: ("'", ".")}


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it: long formulas would else repeat it each time."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def make_number(text: Column) -> Column:
    """Number of typed text: signs of money and groups are ignored, (x) is negative, a comma that comes last is decimal."""

    def number(raw: Column) -> Column:
        t = F.regexp_replace(raw, r"^\(+|\)+$", "")
        comma, dot = F.length(t) - F.instr(F.reverse(t), ",") + 1, F.length(t) - F.instr(F.reverse(t), ".") + 1
        has_comma, has_dot = F.instr(t, ",") > 0, F.instr(t, ".") > 0
        plain = (
            F.when(has_comma & has_dot & (comma > dot), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .when(has_comma & ~has_dot & (F.length(t) - comma != 3), F.replace(t, F.lit(","), F.lit(".")))
            .otherwise(F.replace(t, F.lit(","), F.lit("")))
        )
        v = let(plain, lambda p: F.when(p.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), p.try_cast("double")))
        return v * F.when(raw.rlike(r"^\(.*\)$"), -1.0).otherwise(1.0)

    return let(F.regexp_replace(text, r"[\s$€£¥'%]", ""), number)


def js_number(v: Column) -> Column:
    """A number as scripts print it: no fraction where there is none, exponents from 1e21 up and below 1e-6."""
    size = F.abs(v)
    plain = F.when((v == F.floor(v)) & (size < 1e15), v.cast("bigint").cast("string"))
    digits = F.regexp_replace(F.regexp_replace(v.cast("decimal(38,17)").cast("string"), r"0+$", ""), r"\.$", "")
    power = F.regexp_replace(F.regexp_replace(v.cast("string"), r"\.0E", "E"), r"E(?=\d)", "e+")
    power = F.replace(power, F.lit("E-"), F.lit("e-"))
    return F.when(F.isnan(v), "NaN").when(v == float("inf"), "Infinity").when(v == float("-inf"), "-Infinity").when(plain.isNotNull(), plain).when((size >= 1e21) | (size < 1e-6), power).when(size >= 1e15, v.cast("decimal(38,0)").cast("string")).when(v.cast("string").contains("E"), digits).otherwise(v.cast("string"))


def number_text(v: Column, decimals: int = 2, style: int = 0) -> Column:
    """Absolute value with a separator style: 0 1,234.56; 1 1234.56; 2 1.234,56; 3 1234,56; 4 1'234.56. Halves go away from zero."""
    group, point = _GROUP.get(style, _GROUP[0])
    scale = 10**decimals
    rounded = F.floor(F.abs(v) * scale + 0.5) / scale
    whole = F.floor(rounded).cast("bigint")
    digits = whole.cast("string")
    if group:
        digits = F.regexp_replace(digits, r"(?<=\d)(?=(\d{3})+$)", group)
    if not decimals:
        return digits
    part = F.lpad(F.floor((rounded - whole) * scale + 0.5).cast("bigint").cast("string"), decimals, "0")
    return F.concat(digits, F.lit(point), part)


def number_format(v: Column, decimals: int = 2, style: int = 0, negative: int = 0, currency: str = "", prepend: bool = True) -> Column:
    """Display text of a number. negative: 0 minus, 1 red only, 2 in brackets, 3 red in brackets."""

    def show(v: Column) -> Column:
        body = number_text(v, decimals, style)
        body = F.concat(F.lit(currency), body) if prepend else F.concat(body, F.lit(currency))
        before, after = ("(", ")") if negative >= 2 else ("-", "") if negative == 0 else ("", "")
        return F.concat(F.when(v < 0, before).otherwise(""), body, F.when(v < 0, after).otherwise(""))

    return let(v.cast("double"), show)


def percent_format(v: Column, decimals: int = 2, style: int = 0) -> Column:
    return F.concat(number_format(v * 100, decimals, style), F.lit("%"))


_DATE_PARTS = (("yyyy", "yyyy"), ("yy", "yy"), ("mmmm", "MMMM"), ("mmm", "MMM"), ("mm", "MM"), ("m", "M"), ("dddd", "EEEE"), ("ddd", "EEE"), ("dd", "dd"), ("d", "d"), ("HH", "HH"), ("H", "H"), ("hh", "hh"), ("h", "h"), ("MM", "mm"), ("ss", "ss"), ("s", "s"), ("tt", "a"), ("t", "a"))


def date_pattern(picture: str) -> str:
    """A form date picture as a Java one."""
    names = "|".join(a for a, _ in _DATE_PARTS)
    to = dict(_DATE_PARTS)
    return "".join(to.get(t, t if not t.isalpha() else f"'{t}'") for t in re.findall(f"{names}|.", picture))


def date_format(ts: Column, picture: str) -> Column:
    out = F.date_format(ts, date_pattern(picture))
    return F.replace(F.replace(out, F.lit("AM"), F.lit("am")), F.lit("PM"), F.lit("pm")) if "tt" in picture else out


_ABBREVIATED = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def parse_date(text: Column, order: str = "mdy") -> Column:
    """A date from text with any separators, month names or numbers, two- or four-digit years; null where there is none."""
    numbers = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+)"), 1)
    name = F.lower(F.regexp_extract(text, r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)", 1))
    named = F.when(name != "", F.array_position(F.array(*map(F.lit, _ABBREVIATED)), name).cast("int"))

    def at(i: int) -> Column:
        return F.get(numbers, F.lit(i)).try_cast("int")

    iso = F.length(F.get(numbers, F.lit(0))) == 4
    k = {c: i for i, c in enumerate(order)}
    year = F.when(iso, at(0)).when(named.isNotNull(), at(1)).otherwise(at(k["y"]))
    month = F.when(iso & named.isNull(), at(1)).when(named.isNotNull(), named).otherwise(at(k["m"]))
    day = F.when(iso & named.isNull(), at(2)).when(iso, at(1)).when(named.isNotNull(), at(0)).otherwise(at(k["d"]))
    year = F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year)
    ok = month.between(1, 12) & day.between(1, 31) & year.between(1, 9999)
    made = F.when(ok, F.make_date(F.when(ok, year), F.when(ok, month), F.lit(1)))
    return F.when(day <= F.dayofmonth(F.last_day(made)), F.date_add(made, day - 1))


def mask(text: Column, pattern: str) -> Column:
    """Text through a mask: 9 a digit, A a letter, O a letter or digit, X anything, others stand for themselves. Null if it doesn't fit."""
    plain = re.sub(r"[9AOX]", "", pattern)
    raw = text
    for c in sorted(set(plain)):
        raw = F.replace(raw, F.lit(c), F.lit(""))
    classes = {"9": r"\d", "A": r"[A-Za-z]", "O": r"[A-Za-z\d]", "X": "."}
    n, want, out = 0, "", []
    for c in pattern:
        if c in classes:
            n += 1
            want += f"({classes[c]})"
            out.append(F.substring(raw, n, 1))
        else:
            out.append(F.lit(c))
    return F.when(raw.rlike(f"^{want}$"), F.concat(*out))


def special(text: Column, kind: int) -> Column:
    """0 zip, 1 zip+4, 2 phone, 3 social security number."""
    digits = F.regexp_replace(text, r"\D", "")
    if kind == 2:
        return F.when(F.length(digits) == 10, mask(digits, "(999) 999-9999")).when(F.length(digits) == 7, mask(digits, "999-9999"))
    return mask(digits, {0: "99999", 1: "99999-9999", 3: "999-99-9999"}[kind])


def printx(text: Column, picture: str) -> Column:
    """Acrobat-like text picture: ? any, X letter or digit, A letter, 9 digit, > upper, < lower, = as it is."""
    out, case, letters = [], "=", 0
    kept = {"X": r"[^A-Za-z\d]", "A": r"[^A-Za-z]", "9": r"[^\d]", "?": None}
    used = [c for c in picture if c in kept]
    source = F.regexp_replace(text, kept[used[0]], "") if used and len(set(used)) == 1 and kept[used[0]] else text
    for c in picture:
        if c in "<>=":
            case = c
        elif c in kept:
            letters += 1
            x = F.substring(source, letters, 1)
            out.append(F.upper(x) if case == ">" else F.lower(x) if case == "<" else x)
        elif c == "*":
            x = F.substring(source, letters + 1, 2147483647)
            out.append(F.upper(x) if case == ">" else F.lower(x) if case == "<" else x)
        else:
            out.append(F.lit(c))
    return F.concat(*out) if out else F.lit("")


def printf(template: str, *args: Column) -> Column:
    """C-like formatting; %,N with N from 0 to 4 chooses a separator style."""
    parts, at, k = [], 0, 0
    for m in re.finditer(r"%(?:,([0-4]))?([-+ 0#]*)(\d*)(?:\.(\d+))?([dfsx%])", template):
        parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m[5] == "%":
            parts.append(F.lit("%"))
            continue
        x = args[k]
        k += 1
        if m[1] and m[5] in "df":
            parts.append(number_format(x.cast("double"), int(m[4] or (0 if m[5] == "d" else 6)), int(m[1])))
        elif m[5] == "s":
            parts.append(F.coalesce(x.cast("string"), F.lit("")))
        else:
            parts.append(F.format_string(f"%{m[2]}{m[3]}{'.' + m[4] if m[4] and m[5] == 'f' else ''}{m[5]}", x.cast("double" if m[5] == "f" else "bigint")))
    parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def range_valid(text: Column, low: float | None = None, high: float | None = None) -> Column:
    """Whether a value lies in a range; what is no number passes."""
    v = make_number(text)
    ok = F.lit(True)
    if low is not None:
        ok = ok & (v >= low)
    if high is not None:
        ok = ok & (v <= high)
    return F.coalesce(v.isNull() | ok, F.lit(True))


def keystroke(text: Column, kind: str, **options) -> Column:
    """struct(ok, value, error): whether a committed value fits the format, and its normal form."""
    if kind in ("number", "percent"):
        v = make_number(text)
        shown, message = v.cast("string"), "no number"
        ok = v.isNotNull()
    elif kind in ("date", "time"):
        v = parse_date(text, options.get("order", "mdy"))
        ok, shown, message = v.isNotNull(), v.cast("string"), "no date"
    else:
        v = special(text, options["special"]) if kind == "special" else mask(text, options["mask"])
        ok, shown, message = v.isNotNull(), v, "doesn't fit the mask"
    empty = F.coalesce(F.trim(text) == "", F.lit(True))
    return F.struct((ok | empty).alias("ok"), F.when(~empty, shown).alias("value"), F.when(~(ok | empty), message).alias("error"))


def calculate(op: str, values: Sequence[Column]) -> Column:
    """SUM, PRD, AVG, MIN or MAX over field texts: what is no number counts 0; nothing gives 0."""
    numbers = F.array(*(F.coalesce(make_number(v), F.lit(0.0)) for v in values)) if values else F.array().cast("array<double>")
    if not values:
        return F.lit(0.0)
    total = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)
    return {
        "SUM": total, "AVG": total / len(values), "MIN": F.array_min(numbers), "MAX": F.array_max(numbers),
        "PRD": F.aggregate(numbers, F.lit(1.0), lambda a, x: a * x),
    }[op.upper()]


_NOTATION = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|((?:[A-Za-z_]|\\.)(?:[\w.]|\\.)*)|([-+*/()]))")


def notation(expr: str, fields: Mapping[str, Column]) -> Column:
    """Simplified field notation (+ - * / and brackets over field names). Null where the text is no such expression."""
    tokens, at = [], 0
    text = expr.strip()
    while at < len(text):
        m = _NOTATION.match(text, at)
        if not m:
            return F.lit(None).cast("double")
        tokens.append((m.lastindex, m[m.lastindex].replace("\\", "")))
        at = m.end()
    pos = 0

    def peek() -> str | None:
        return tokens[pos][1] if pos < len(tokens) else None

    def factor() -> Column:
        nonlocal pos
        if pos >= len(tokens):
            raise ValueError
        kind, t = tokens[pos]
        pos += 1
        if kind == 1:
            return F.lit(float(t))
        if kind == 2:
            return F.coalesce(make_number(fields[t]), F.lit(0.0)) if t in fields else F.lit(0.0)
        if t == "-":
            return -factor()
        if t == "(":
            v = total()
            if peek() != ")":
                raise ValueError
            pos += 1
            return v
        raise ValueError

    def term() -> Column:
        nonlocal pos
        v = factor()
        while peek() in ("*", "/"):
            op = tokens[pos][1]
            pos += 1
            w = factor()
            v = v * w if op == "*" else F.try_divide(v, w)
        return v

    def total() -> Column:
        nonlocal pos
        v = term()
        while peek() in ("+", "-"):
            op = tokens[pos][1]
            pos += 1
            w = term()
            v = v + w if op == "+" else v - w
        return v

    try:
        v = total()
        return v if pos == len(tokens) else F.lit(None).cast("double")
    except ValueError:
        return F.lit(None).cast("double")


_CALL = re.compile(r"\s*(AF\w+)\s*\((.*)\)\s*;?\s*$", re.S)


def recognise(script: str) -> dict | None:
    """The format or calculation that a well-known script call stands for."""
    m = _CALL.match(script or "")
    if not m:
        return None
    args = [a.strip() for a in re.findall(r"\s*(\"(?:[^\"\\]|\\.)*\"|new Array\s*\([^)]*\)|[^,\s][^,]*)", m[2])]
    plain = [re.sub(r"\\(.)", r"\1", a[1:-1]) if a[:1] == '"' else a for a in args]
    name = m[1]
    if name.startswith(("AFNumber", "AFPercent")) and len(plain) >= 2:
        out = {"kind": "number" if "Number" in name else "percent", "decimals": int(plain[0]), "style": int(plain[1])}
        if len(plain) >= 6:
            out |= {"negative": int(plain[2]), "currency": plain[4], "prepend": plain[5] == "true"}
        return out
    if name.startswith("AFDate"):
        return {"kind": "date", "picture": plain[0]}
    if name.startswith("AFTime"):
        return {"kind": "time", "picture": plain[0]}
    if name.startswith("AFSpecial"):
        return {"kind": "special", "special": int(plain[0])} if plain[0].isdigit() else {"kind": "mask", "mask": plain[0]}
    if name == "AFSimple_Calculate":
        return {"kind": "calculate", "op": plain[0], "fields": re.findall(r'"((?:[^"\\]|\\.)*)"', args[1])}
    if name == "AFRange_Validate" and len(plain) == 4:
        return {"kind": "range", "low": float(plain[1]) if plain[0] == "true" else None, "high": float(plain[3]) if plain[2] == "true" else None}
    return None


def to_script(spec: dict) -> str:
    """The call that ``recognise`` reads as this format, calculation or range."""
    q = lambda t: '"' + str(t).replace("\\", "\\\\").replace('"', '\\"') + '"'
    b = lambda x: "true" if x else "false"
    kind = spec["kind"]
    if kind in ("number", "percent"):
        name = "AFNumber_Format" if kind == "number" else "AFPercent_Format"
        more = f", {spec['negative']}, 0, {q(spec['currency'])}, {b(spec['prepend'])}" if "currency" in spec else ""
        return f"{name}({spec['decimals']}, {spec['style']}{more});"
    if kind in ("date", "time"):
        return f"AF{kind.capitalize()}_FormatEx({q(spec['picture'])});"
    if kind == "special":
        return f"AFSpecial_Format({spec['special']});"
    if kind == "mask":
        return f"AFSpecial_KeystrokeEx({q(spec['mask'])});"
    if kind == "calculate":
        return f"AFSimple_Calculate({q(spec['op'])}, new Array({', '.join(map(q, spec['fields']))}));"
    if kind == "range":
        return "AFRange_Validate(" + ", ".join(f"{b(spec[k] is not None)}, {spec[k] if spec[k] is not None else 0}" for k in ("low", "high")) + ");"
    raise ValueError(f"no such format: {kind}")


def display(value: Column, spec: dict) -> Column:
    """A field's text as its format shows it; what doesn't fit stays as it is, blank stays blank."""
    kind = spec["kind"]
    if kind == "number":
        shown = number_format(make_number(value), spec["decimals"], spec["style"], spec.get("negative", 0), spec.get("currency", ""), spec.get("prepend", True))
    elif kind == "percent":
        shown = percent_format(make_number(value), spec["decimals"], spec["style"])
    elif kind in ("date", "time"):
        moment = value.try_cast("timestamp") if kind == "time" else F.coalesce(value.try_cast("timestamp"), parse_date(value, spec.get("order", "mdy")).cast("timestamp"))
        shown = date_format(moment, spec["picture"])
    elif kind == "special":
        shown = special(value, spec["special"])
    elif kind == "mask":
        shown = mask(value, spec["mask"])
    else:
        raise ValueError(f"no such format: {kind}")
    return F.when(F.trim(F.coalesce(value, F.lit(""))) == "", "").otherwise(F.coalesce(shown, value))


def recalculate(fields: Mapping[str, Column], calculations: Mapping[str, tuple[str, list[str]]]) -> dict[str, Column]:
    """All calculated fields, those they need first; a circle of fields is an error."""
    done, busy = dict(fields), set()

    def value(name: str) -> Column:
        if name in calculations and name not in ready:
            if name in busy:
                raise ValueError(f"{name} is calculated from itself")
            busy.add(name)
            op, names = calculations[name]
            done[name] = calculate(op, [value(n).cast("string") for n in names])
            ready.add(name)
        return done.get(name, F.lit(None).cast("string"))

    ready: set[str] = set()
    for name in calculations:
        value(name)
    return done
