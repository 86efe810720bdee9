"""The form calculation language as Column expressions: coercion, operators, all built-ins, and a compiler.

Arithmetic is null only if both sides are; otherwise null counts as 0 and text as its leading number (0 without one).
Comparisons are numeric where both sides are numbers, textual otherwise. Division by zero raises, as the language says.
Aggregates drop nulls first; the sum of nothing is 0, other aggregates of nothing are null.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .af import let

_LEADING = r"^\s*([+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?))"
_NUMERIC = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def fc_num(x) -> Column:
    """Number of a value: null is 0, text its leading number, 0 without one."""
    s = col(x).cast("string")
    return F.coalesce(F.regexp_extract(s, _LEADING, 1).try_cast("double"), F.lit(0.0))


def fc_str(x, number: bool = False) -> Column:
    """Text of a value; null is empty. Numbers print without a fraction where they have none, else with 12 places, trimmed."""
    if not number:
        return F.coalesce(col(x).cast("string"), F.lit(""))
    n = col(x).cast("double")
    fixed = F.regexp_replace(F.regexp_replace(F.format_string("%.12f", n), r"0+$", ""), r"\.$", "")
    whole = (n == F.floor(n)) & (F.abs(n) < 1e15)
    return F.coalesce(F.when(F.isnan(n), "NaN").when(n == float("inf"), "Infinity").when(n == float("-inf"), "-Infinity").when(whole, n.cast("bigint").cast("string")).when(fixed.isin("-0", ""), "0").otherwise(fixed), F.lit(""))


def fc_is_numeric(x) -> Column:
    return F.coalesce(col(x).cast("string").rlike(_NUMERIC), F.lit(False))


def fc_truthy(x) -> Column:
    n = fc_num(x)
    return (n != 0) & ~F.isnan(n)


def _arith(a, b, f: Callable[[Column, Column], Column]) -> Column:
    a, b = col(a), col(b)
    return F.when(a.isNull() & b.isNull(), F.lit(None).cast("double")).otherwise(f(fc_num(a), fc_num(b)))


def fc_add(a, b) -> Column:
    return _arith(a, b, lambda x, y: x + y)


def fc_sub(a, b) -> Column:
    return _arith(a, b, lambda x, y: x - y)


def fc_mul(a, b) -> Column:
    return _arith(a, b, lambda x, y: x * y)


def fc_div(a, b) -> Column:
    return _arith(a, b, lambda x, y: F.when(y == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(x / y))


def fc_cmp(op: str, a, b) -> Column:
    """1 or 0. Two nulls are equal; a null and a value are unequal and not ordered."""
    a, b = col(a), col(b)
    x, y = fc_num(a), fc_num(b)
    s, t = a.cast("string"), b.cast("string")
    both = fc_is_numeric(a) & fc_is_numeric(b)
    pick = {"==": lambda p, q: p == q, "<>": lambda p, q: p != q, "<": lambda p, q: p < q, "<=": lambda p, q: p <= q, ">": lambda p, q: p > q, ">=": lambda p, q: p >= q}[op]
    nulls = F.lit(op in ("==", "<=", ">="))
    r = F.when(a.isNull() & b.isNull(), nulls).when(a.isNull() | b.isNull(), F.lit(op == "<>")).when(both, pick(x, y)).otherwise(pick(s, t))
    return r.cast("double")


# arithmetic


def fc_abs(n) -> Column:
    return F.abs(fc_num(n))


def fc_ceil(n) -> Column:
    return F.ceil(fc_num(n)).cast("double")


def fc_floor(n) -> Column:
    return F.floor(fc_num(n)).cast("double")


def fc_mod(a, b) -> Column:
    x, y = fc_num(a), fc_num(b)
    return F.when(y == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(x % y)


def fc_round(n, places=0) -> Column:
    p = F.greatest(F.lit(0), F.least(F.lit(12), fc_num(places).cast("int")))
    x, scale = fc_num(n), F.pow(F.lit(10.0), p)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


class Many:
    """All values of a repeated field, as an argument of an aggregate."""

    def __init__(self, values: Column) -> None:
        self.values = values


def _present(args) -> Column:
    texts = "array<string>"
    parts = [a.values.cast(texts) if isinstance(a, Many) else F.array(col(a).cast("string")) for a in args]
    return F.filter(F.concat(*(F.coalesce(p, F.array().cast(texts)) for p in parts)), lambda v: v.isNotNull())


def fc_count(*args) -> Column:
    return F.size(F.filter(_present(args), lambda v: v != "")).cast("double")


def fc_sum(*args) -> Column:
    return F.aggregate(_present(args), F.lit(0.0), lambda acc, v: acc + fc_num(v))


def fc_avg(*args) -> Column:
    return F.when(F.size(_present(args)) > 0, fc_sum(*args) / F.size(_present(args)))


def fc_max(*args) -> Column:
    return F.array_max(F.transform(_present(args), fc_num))


def fc_min(*args) -> Column:
    return F.array_min(F.transform(_present(args), fc_num))


# logic


def fc_choose(i, *values) -> Column:
    k = fc_num(i).cast("int")
    return F.when((k >= 1) & (k <= len(values)), F.try_element_at(F.array(*(col(v).cast("string") for v in values)), F.greatest(k, F.lit(1))))


def fc_hasvalue(v) -> Column:
    return F.when(col(v).isNull() | (F.regexp_replace(fc_str(v), r"^\s+|\s+$", "") == ""), 0.0).otherwise(1.0)


def fc_oneof(v, *others) -> Column:
    return F.greatest(F.lit(0.0), *(fc_cmp("==", v, o) for o in others))


def fc_within(v, lo, hi) -> Column:
    return fc_cmp(">=", v, lo) * fc_cmp("<=", v, hi)


# text


def fc_at(s, sub) -> Column:
    return F.when(fc_str(sub) == "", 0.0).otherwise(F.position(fc_str(sub), fc_str(s)).cast("double"))


def fc_concat(*args) -> Column:
    return F.concat(*(fc_str(a) for a in args))


def fc_left(s, k) -> Column:
    return F.left(fc_str(s), F.greatest(F.lit(0), fc_num(k).cast("int")))


def fc_right(s, k) -> Column:
    return F.right(fc_str(s), F.greatest(F.lit(0), fc_num(k).cast("int")))


def fc_len(s) -> Column:
    return F.char_length(fc_str(s)).cast("double")


def fc_lower(s) -> Column:
    return F.lower(fc_str(s))


def fc_upper(s) -> Column:
    return F.upper(fc_str(s))


def fc_ltrim(s) -> Column:
    return F.regexp_replace(fc_str(s), r"^[\s  - 　]+", "")


def fc_rtrim(s) -> Column:
    return F.regexp_replace(fc_str(s), r"[\s  - 　]+$", "")


def fc_space(k) -> Column:
    return F.repeat(F.lit(" "), F.greatest(F.lit(0), fc_num(k).cast("int")))


def fc_strn(n, width=10, places=0) -> Column:
    """Right-aligned number; stars where it is too wide."""
    w, p = int(width), max(0, int(places))
    t = F.format_string(f"%.{p}f", fc_round(n, p))
    return F.when(F.char_length(t) > w, F.lit("*" * w)).otherwise(F.lpad(t, w, " "))


def fc_substr(s, start, length) -> Column:
    a = F.greatest(F.lit(1), fc_num(start).cast("int"))
    return F.substring(fc_str(s), a, F.greatest(F.lit(0), fc_num(length).cast("int")))


def fc_stuff(s, start, drop, insert="") -> Column:
    t, a = fc_str(s), F.greatest(F.lit(1), fc_num(start).cast("int"))
    a = F.least(a, F.char_length(t) + 1)
    return F.concat(F.substring(t, F.lit(1), a - 1), fc_str(insert), F.substring(t, a + F.greatest(F.lit(0), fc_num(drop).cast("int")), F.char_length(t)))


def fc_replace(s, old, new="") -> Column:
    return F.when(fc_str(old) == "", fc_str(s)).otherwise(F.replace(fc_str(s), fc_str(old), fc_str(new)))


_ONES = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
_TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
_GROUPS = ("", "thousand", "million", "billion", "trillion")


def _below_thousand(n: Column) -> Column:
    ones, tens = F.array(*map(F.lit, _ONES)), F.array(*map(F.lit, _TENS))
    rest = n % 100
    low = F.when(rest == 0, F.lit(None).cast("string")).when(rest < 20, F.element_at(ones, rest + 1)).otherwise(F.concat(F.element_at(tens, (rest / 10).cast("int") + 1), F.when(rest % 10 != 0, F.concat(F.lit("-"), F.element_at(ones, rest % 10 + 1))).otherwise("")))
    high = F.when(n >= 100, F.concat(F.element_at(ones, (n / 100).cast("int") + 1), F.lit(" hundred")))
    return F.concat_ws(" ", high, low)


def fc_wordnum(n, kind: int = 0) -> Column:
    """English words of a number; kind 2 adds dollars and cents."""
    x = F.abs(fc_num(n))
    whole = F.floor(x).cast("bigint")
    parts = []
    for k in range(len(_GROUPS) - 1, -1, -1):
        g = ((whole / F.lit(1000**k)).cast("bigint") % 1000).cast("int")
        parts.append(F.when(g > 0, F.concat_ws(" ", _below_thousand(g), F.lit(_GROUPS[k]) if _GROUPS[k] else F.lit(None).cast("string"))))
    words = F.when(whole == 0, "zero").otherwise(F.trim(F.concat_ws(" ", *parts)))
    text = F.concat(F.when(fc_num(n) < 0, "minus ").otherwise(""), words)
    if kind == 0:
        return text
    cents = F.round((x - whole) * 100).cast("int")
    return F.concat(text, F.lit(" dollars")) if kind == 1 else F.concat(text, F.lit(" dollars and "), F.when(cents == 0, "zero").otherwise(_below_thousand(cents)), F.lit(" cents"))


def fc_encode(s, how: str = "url") -> Column:
    t = fc_str(s)
    if how == "url":
        return F.replace(F.replace(F.replace(F.url_encode(t), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;" if how == "html" else "&apos;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def fc_decode(s, how: str = "url") -> Column:
    t = fc_str(s)
    if how == "url":
        return F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


# dates and times: day 1 is 1900-01-01, times are milliseconds of the day


def civil_day(y: Column, m: Column, d: Column) -> Column:
    """Day number of a calendar date by arithmetic; days past the month's end run on, as the language accepts 1..31."""
    return (F.datediff(F.make_date(y, m, F.lit(1)), F.lit("1899-12-31").cast("date")) + d - 1).cast("double")


_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def fc_date2num(s, picture: str = "MMM D, YYYY") -> Column:
    """Day number of a date text after a picture (YYYY YY MMMM MMM MM M DD D); 0 where it doesn't fit."""
    pattern, order = "", []
    for token in re.findall(r"YYYY|YY|MMMM|MMM|MM|M|DD|D|.", picture):
        if token[0] in "YMD":
            order.append(token)
            pattern += {"YYYY": r"(\d{4})", "YY": r"(\d{2})", "MMMM": r"([A-Za-z]+)", "MMM": r"([A-Za-z]{3})"}.get(token, r"(\d{1,2})")
        else:
            pattern += re.escape(token)
    t, got = fc_str(s), {}
    for i, token in enumerate(order):
        part = F.regexp_extract(t, f"^\\s*{pattern}\\s*$", i + 1)
        if token.startswith("MMM"):
            value = reduce(lambda acc, k: F.when(F.lower(F.left(part, F.lit(3))) == _MONTHS[k][:3].lower(), k + 1).otherwise(acc), range(12), F.lit(None).cast("int"))  # noqa: B023
        else:
            value = part.try_cast("int")
            if token == "YY":
                value = F.when(value < 30, value + 2000).otherwise(value + 1900)
        got[token[0]] = value
    y, m, d = got.get("Y", F.lit(1900)), got.get("M", F.lit(1)), got.get("D", F.lit(1))
    ok = m.between(1, 12) & d.between(1, 31) & (y >= 1900)
    return F.coalesce(F.when(ok, civil_day(F.when(ok, y), F.when(ok, m), d)), F.lit(0.0))


def fc_isodate2num(s) -> Column:
    t = F.regexp_replace(fc_str(s), "T.*$", "")
    return F.greatest(fc_date2num(t, "YYYY-MM-DD"), fc_date2num(t, "YYYYMMDD"))


def fc_num2date(n, picture: str = "MMM D, YYYY") -> Column:
    p = "".join({"YYYY": "yyyy", "YY": "yy", "DD": "dd", "D": "d"}.get(t, t) for t in re.findall(r"YYYY|YY|DD|D|[^YD]+", picture))
    day = fc_num(n).cast("int")
    return F.when(day >= 1, F.date_format(F.date_add(F.lit("1899-12-31").cast("date"), day), p)).otherwise("")


def _shown_date(day: Column, picture: str) -> Column:
    p = "".join({"YYYY": "yyyy", "YY": "yy", "DD": "dd", "D": "d"}.get(t, t) for t in re.findall(r"YYYY|YY|DD|D|[^YD]+", picture.upper() if picture.islower() else picture))
    return F.date_format(F.date_add(F.lit("1899-12-31").cast("date"), day.cast("int")), p)


def fc_format(picture: str, v) -> Column:
    """A number or date shown by a picture: 9 and z are digits, a comma groups, a point begins the decimals, $ is put before; YY or DD make it a date.

    A date is a day number or an ISO date; other text stays as it is.
    """
    upper = picture.upper()
    if "YY" in upper or "DD" in upper:
        iso = fc_isodate2num(v)
        number = fc_is_numeric(v) & (F.abs(fc_num(v)) < 3_000_000)
        return F.when(number, _shown_date(fc_num(v), picture)).when(iso > 0, _shown_date(iso, picture)).otherwise(fc_str(v))
    places = min(20, sum(c in "9zZ" for c in picture.partition(".")[2]))
    size = F.format_string(f"%,.{places}f" if "," in picture else f"%.{places}f", F.abs(fc_num(v)))
    return F.concat(F.when(fc_num(v) < 0, "-").otherwise(""), F.lit("$" if "$" in picture else ""), size)


def fc_parse(picture: str, s) -> Column:
    """The inverse: a date after the picture as ISO text, otherwise the number that the figures, points and signs make; null where there is none."""
    if "YY" in picture.upper():
        day = fc_date2num(s, picture)
        return F.when(day > 0, F.date_format(F.date_add(F.lit("1899-12-31").cast("date"), day.cast("int")), "yyyy-MM-dd"))
    return F.regexp_replace(fc_str(s), r"[^0-9.\-]", "").try_cast("double")


def fc_datefmt(style=0) -> Column:
    k = fc_num(style).cast("int")
    return F.when(k == 1, "M/D/YY").when(k == 3, "MMMM D, YYYY").when(k == 4, "EEEE, MMMM D, YYYY").otherwise("MMM D, YYYY")


def fc_timefmt(style=0) -> Column:
    return F.lit("HH:MM:SS")


def fc_num2time(ms) -> Column:
    s = F.floor(F.pmod(fc_num(ms), F.lit(86_400_000.0)) / 1000).cast("int")
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("int"), (s / 60).cast("int") % 60, s % 60)


def fc_time2num(s) -> Column:
    t = fc_str(s)
    h, m, x = (F.coalesce(F.regexp_extract(t, r"^\s*(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?\s*$", k).try_cast("int"), F.lit(0)) for k in (1, 2, 3))
    return F.when((h < 24) & (m < 60) & (x < 60), (h * 3600 + m * 60 + x) * 1000.0).otherwise(0.0)


def fc_date() -> Column:
    return F.datediff(F.current_date(), F.lit("1899-12-31").cast("date")).cast("double")


def fc_time() -> Column:
    return (F.unix_millis(F.current_timestamp()) % 86_400_000).cast("double")


# finance


def fc_fv(pmt, rate, n) -> Column:
    p, r, k = fc_num(pmt), fc_num(rate), fc_num(n)
    return F.when(r == 0, p * k).otherwise(p * (F.pow(1 + r, k) - 1) / F.when(r != 0, r))


def fc_pv(pmt, rate, n) -> Column:
    p, r, k = fc_num(pmt), fc_num(rate), fc_num(n)
    return F.when(r == 0, p * k).otherwise(p * (1 - F.pow(1 + r, -k)) / F.when(r != 0, r))


def fc_pmt(pv, rate, n) -> Column:
    p, r, k = fc_num(pv), fc_num(rate), fc_num(n)
    return F.when(k <= 0, F.raise_error(F.lit("the number of periods must be positive")).cast("double")).when(r == 0, p / k).otherwise(p * r / F.when(r != 0, 1 - F.pow(1 + r, -k)))


def fc_term(pmt, rate, fv) -> Column:
    p, r, f = fc_num(pmt), fc_num(rate), fc_num(fv)
    return F.when(r == 0, F.try_divide(f, p)).otherwise(F.log(1 + F.try_divide(f * r, p)) / F.when(r != 0, F.log(1 + r)))


def fc_cterm(rate, fv, pv) -> Column:
    r, f, p = fc_num(rate), fc_num(fv), fc_num(pv)
    return F.log(F.try_divide(f, p)) / F.log(1 + r)


def fc_rate(fv, pv, n) -> Column:
    f, p, k = fc_num(fv), fc_num(pv), fc_num(n)
    return F.pow(F.try_divide(f, p), F.try_divide(F.lit(1.0), k)) - 1


def fc_npv(rate, *flows) -> Column:
    r = fc_num(rate)
    kept = _present(flows)
    total = F.aggregate(kept, F.struct(F.lit(0.0).alias("t"), F.lit(1.0).alias("f")), lambda acc, v: F.struct((acc["t"] + fc_num(v) / (acc["f"] * (1 + r))).alias("t"), (acc["f"] * (1 + r)).alias("f")))
    return total["t"]


def _paid(pv, rate, pmt, first, count, principal: bool) -> Column:
    lo = F.greatest(F.lit(1), fc_num(first).cast("int"))
    hi = F.least(F.lit(10_000), lo + F.greatest(F.lit(0), fc_num(count).cast("int")) - 1)

    def paid(v: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            interest = acc["b"] * v["r"]
            part = F.least(v["a"] - interest, acc["b"]) if principal else interest
            return F.struct((acc["b"] - (v["a"] - interest)).alias("b"), (acc["s"] + F.when((k >= v["lo"]) & (acc["b"] > 0), part).otherwise(0.0)).alias("s"))

        start = F.struct(v["p"].alias("b"), F.lit(0.0).alias("s"))
        return F.when(v["hi"] >= v["lo"], F.aggregate(F.sequence(F.lit(1), F.greatest(v["hi"], F.lit(1))), start, step)["s"]).otherwise(0.0)

    return let(F.struct(fc_num(pv).alias("p"), (fc_num(rate) / 12).alias("r"), fc_num(pmt).alias("a"), lo.alias("lo"), hi.alias("hi")), paid)


def fc_ipmt(pv, rate, pmt, first, count) -> Column:
    return _paid(pv, rate, pmt, first, count, False)


def fc_ppmt(pv, rate, pmt, first, count) -> Column:
    return _paid(pv, rate, pmt, first, count, True)


def fc_apr(principal, pmt, months) -> Column:
    """Yearly rate of a loan. The payment grows with the monthly rate along a convex curve, so Newton's method from above settles in a few steps; what has no rate in reach, or hasn't settled, is bisected."""

    def bisected(v: Column) -> Column:
        def step(acc: Column, _k: Column) -> Column:
            mid = (acc["lo"] + acc["hi"]) / 2
            due = v["p"] * mid / (1 - F.pow(1 + mid, -v["n"]))
            return F.when(due > v["a"], F.struct(acc["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct(mid.alias("lo"), acc["hi"].alias("hi")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.struct(F.lit(1e-12).alias("lo"), F.lit(1.0).alias("hi")), step)["lo"]

    def settled(v: Column, x: Column, steps: int) -> Column:
        def closer(e: Column) -> Column:  # e = (1 + x) ** -n - 1
            return x - F.try_divide(e * (x + v["c"] * e) * (1 + x), e * (1 + x) + x * v["n"] * (1 + e))

        def then(y: Column) -> Column:
            return F.when((F.abs(y - x) <= 1e-15 + 1e-13 * x) & y.between(1e-12, 1.0), y).otherwise(settled(v, y, steps - 1) if steps > 1 else bisected(v))

        return let(let(F.expm1(v["n"] * -F.log1p(x)), closer), then)

    def monthly(v: Column) -> Column:
        above = F.least(v["c"], (v["c"] * v["n"] - 1) * 2 / (v["n"] + 1), F.lit(1.0))
        return let(F.when((v["p"] > 0) & (v["a"] > 0) & (v["n"] >= 1), above), lambda x: settled(v, x, 6))

    def shared(v: Column) -> Column:
        return F.struct(v["p"], v["a"], v["n"], F.try_divide(v["a"], v["p"]).alias("c"))

    given = F.struct(fc_num(principal).alias("p"), fc_num(pmt).alias("a"), fc_num(months).alias("n"))
    return let(let(given, shared), monthly) * 12


# units

_POINTS = {"in": 72.0, "mm": 72 / 25.4, "cm": 72 / 2.54, "pt": 1.0, "pc": 12.0}
_UNIT = r"(?i)^\s*[+-]?[\d.]+\s*(in|mm|cm|pt|pc)[a-z]*\s*$"


def fc_unittype(s) -> Column:
    u = F.lower(F.regexp_extract(fc_str(s), _UNIT, 1))
    return F.when(u == "", "in").otherwise(u)


def fc_unitvalue(s, unit: str | None = None) -> Column:
    of = F.create_map(*(F.lit(x) for kv in _POINTS.items() for x in kv))
    here = fc_num(s) * of[fc_unittype(s)]
    return F.round(here / (F.lit(_POINTS[unit]) if unit else of[fc_unittype(s)]), 10)


BUILTINS: Mapping[str, Callable[..., Column]] = {
    k[3:]: f for k, f in list(globals().items()) if k.startswith("fc_") and k not in ("fc_num", "fc_str", "fc_cmp", "fc_add", "fc_sub", "fc_mul", "fc_div", "fc_is_numeric", "fc_truthy", "fc_strn")
} | {"str": fc_strn, "localdatefmt": fc_datefmt, "localtimefmt": fc_timefmt, "num2gmtime": fc_num2time, "isotime2num": fc_time2num}


# compiler: expressions, assignments and if

_TOKEN = re.compile(r"\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<str>\"(?:[^\"]|\"\")*\")|(?P<id>[A-Za-z_$][\w.$]*)|(?P<op><=|>=|<>|==|[-+*/()<>=,;&|\[\]]))")
_LITERAL = {"null", "true", "false"}
_WORDS = set("if then elseif else endif for foreach while do endfor endwhile upto downto step in var func endfunc and or not eq ne lt le gt ge".split())
_DEPTH = 64


class FormCalcError(ValueError):
    pass


#: Turns of a loop that is written out, and calls of user functions inside each other.
MOST_TURNS, MOST_CALLS = 1000, 32


class Compiler:
    """Script text to a Column over the columns named in ``fields``; ``lists`` are array columns, for ``name[*]`` and ``name[n]``.

    Loops with fixed bounds are written out and user functions put in where they are called; ``while`` and leaving a loop
    early depend on values and are refused.
    """

    def __init__(self, fields: Mapping[str, Column], lists: Mapping[str, Column] | None = None) -> None:
        self.env = {k.lower(): v for k, v in fields.items()}
        self.lists = {k.lower(): v for k, v in (lists or {}).items()}
        self.funcs: dict[str, tuple[list[str], list]] = {}
        self.calls = self.ids = 0

    def compile(self, script: str) -> Column:
        text = re.sub(r"(?m)(//|;;).*$", "", script)
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise FormCalcError(f"unexpected text at {text[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
            while at < len(text) and text[at].isspace():
                at += 1
        self.at, self.depth = 0, 0
        value = F.lit(None).cast("string")
        while self.at < len(self.tokens):
            value = self.statement()
            while self.peek() == ";":
                self.at += 1
        return value

    def peek(self) -> str | None:
        return self.tokens[self.at][1].lower() if self.at < len(self.tokens) else None

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise FormCalcError("unexpected end")
        t = self.tokens[self.at]
        if want and t[1].lower() != want:
            raise FormCalcError(f"{want!r} expected, not {t[1]!r}")
        self.at += 1
        return t

    def statement(self) -> Column:
        word = self.peek()
        if word in ("while", "break", "continue", "return", "exit", "throw"):
            raise FormCalcError(f"{word} can't be a Column")
        if word in ("for", "foreach"):
            return self.loop()
        if word == "func":
            return self.function()
        if word == "if":
            return self.branch()
        if word == "var":
            self.take()
            name = self.take()[1]
            value = F.lit(None).cast("string")
            if self.peek() == "=":
                self.take()
                value = self.expression()
            self.env[name.lower()] = value
            return value
        if self.tokens[self.at][0] == "id" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "=":
            name = self.take()[1]
            self.take("=")
            self.env[name.lower()] = value = self.expression()
            return value
        return self.expression()

    def block(self, *ends: str) -> Column:
        value = F.lit(None).cast("string")
        while self.peek() not in ends:
            value = self.statement()
            while self.peek() == ";":
                self.take()
        return value

    def number(self) -> float:
        sign = 1.0
        while self.peek() in ("-", "+"):
            sign *= -1.0 if self.take()[1] == "-" else 1.0
        kind, text = self.take()
        if kind != "num":
            raise FormCalcError("a loop needs fixed bounds")
        return sign * float(text)

    def loop(self) -> Column:
        """``for i = a upto|downto b step c do ... endfor`` and ``foreach x in (a, b) do ... endfor``, turn by turn."""
        word = self.take()[1].lower()
        name = self.take()[1].lower()
        if word == "foreach":
            self.take("in")
            self.take("(")
            turns = []
            while self.peek() != ")":
                turns.append(self.expression())
                if self.peek() == ",":
                    self.take()
            self.take(")")
        else:
            self.take("=")
            at = self.number()
            down = self.take()[1].lower() == "downto"
            end, step = self.number(), 1.0
            if self.peek() == "step":
                self.take()
                step = abs(self.number())
            if step == 0 or abs(end - at) / step > MOST_TURNS:
                raise FormCalcError("too many turns")
            turns = []
            while (at >= end) if down else (at <= end):
                turns.append(F.lit(at))
                at += -step if down else step
        self.take("do")
        start, value, env = self.at, F.lit(None).cast("string"), dict(self.env)
        if not turns:
            self.block("endfor")
            self.env = env
        for x in turns:
            self.at = start
            self.env[name] = x
            value = self.block("endfor")
        self.take("endfor")
        return value

    def function(self) -> Column:
        self.take()
        name = self.take()[1].lower()
        self.take("(")
        params = []
        while self.peek() != ")":
            params.append(self.take()[1].lower())
            if self.peek() == ",":
                self.take()
        self.take(")")
        self.take("do")
        start, depth = self.at, 1
        while depth:
            word = self.take()[1].lower()
            depth += (word == "func") - (word == "endfunc")
        self.funcs[name] = params, self.tokens[start : self.at - 1]
        return F.lit(None).cast("string")

    def call(self, name: str, args: list) -> Column:
        params, body = self.funcs[name]
        self.calls += 1
        if self.calls > MOST_CALLS:
            raise FormCalcError("functions call each other too deeply")
        outer = self.tokens, self.at, self.env
        self.tokens, self.at = body, 0
        self.env = dict(self.env) | {p: a for p, a in zip(params, [*args, *[F.lit(None).cast("string")] * len(params)], strict=False)}
        value = F.lit(None).cast("string")
        while self.at < len(self.tokens):
            value = self.statement()
            while self.peek() == ";":
                self.at += 1
        self.tokens, self.at, self.env = outer
        self.calls -= 1
        return value

    def branch(self) -> Column:
        self.take()
        self.take("(")
        test = fc_truthy(self.expression())
        self.take(")")
        self.take("then")
        before = dict(self.env)
        yes = self.block("elseif", "else", "endif")
        env_yes, self.env = self.env, dict(before)
        if self.peek() == "elseif":
            no = self.branch()
        else:
            no = F.lit(None).cast("string")
            if self.peek() == "else":
                self.take()
                no = self.block("endif")
            self.take("endif")
        for k in set(env_yes) | set(self.env):
            a, b = env_yes.get(k), self.env.get(k)
            if a is not b:
                none = F.lit(None).cast("string")
                self.env[k] = F.when(test, (a if a is not None else none).cast("string")).otherwise((b if b is not None else none).cast("string"))
        return F.when(test, yes.cast("string")).otherwise(no.cast("string"))

    def expression(self, level: int = 0) -> Column:
        self.depth += 1
        if self.depth > _DEPTH * 8:
            raise FormCalcError("nested too deeply")
        levels = (("or", "|"), ("and", "&"), ("==", "<>", "=", "eq", "ne"), ("<", "<=", ">", ">=", "lt", "le", "gt", "ge"), ("+", "-"), ("*", "/"))
        if level == len(levels):
            value = self.unary()
        else:
            value = self.expression(level + 1)
            while self.peek() in levels[level]:
                op = self.take()[1].lower()
                value = self.apply(op, value, self.expression(level + 1))
        self.depth -= 1
        return value

    @staticmethod
    def apply(op: str, a: Column, b: Column) -> Column:
        op = {"eq": "==", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "=": "=="}.get(op, op)
        if op in ("or", "|"):
            return (fc_truthy(a) | fc_truthy(b)).cast("double")
        if op in ("and", "&"):
            return (fc_truthy(a) & fc_truthy(b)).cast("double")
        if op in ("+", "-", "*", "/"):
            return {"+": fc_add, "-": fc_sub, "*": fc_mul, "/": fc_div}[op](a, b)
        return fc_cmp(op, a, b)

    def unary(self) -> Column:
        word = self.peek()
        if word == "-":
            self.take()
            x = self.unary()
            return F.when(x.isNotNull(), -fc_num(x))
        if word == "+":
            self.take()
            return self.unary()
        if word == "not":
            self.take()
            return (~fc_truthy(self.unary())).cast("double")
        return self.primary()

    def primary(self) -> Column:
        kind, text = self.take()
        if kind == "num":
            return F.lit(float(text))
        if kind == "str":
            return F.lit(text[1:-1].replace('""', '"'))
        if text == "(":
            value = self.expression()
            self.take(")")
            return value
        if kind == "id":
            low = text.lower()
            if low in _LITERAL:
                return F.lit({"true": 1.0, "false": 0.0}.get(low)).cast("double")
            if self.peek() == "(":
                self.take()
                args, raw = [], []
                while self.peek() != ")":
                    raw.append(self.tokens[self.at])
                    if low == "exists" and self.tokens[self.at][0] == "id":
                        self.take()
                        args.append(None)
                        continue
                    args.append(self.expression())
                    if self.peek() == ",":
                        self.take()
                self.take(")")
                if low == "exists":
                    return F.lit(float(bool(raw) and raw[0][0] == "id" and (raw[0][1].lower() in self.env or raw[0][1].lower() in self.lists)))
                if low in self.funcs:
                    return self.call(low, args)
                if low == "uuid":
                    # told by its place in the script, so a script gives the same ids each time
                    self.ids += 1
                    h = hashlib.md5(str(self.ids).encode()).hexdigest()
                    return F.lit("-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:])) if raw and raw[0][1] == "1" else h)
                if low in ("get", "post", "put"):
                    raise FormCalcError(f"{text} is refused: no network")
                f = BUILTINS.get(low)
                if f is None:
                    raise FormCalcError(f"no function {text}")
                if low in ("format", "parse"):
                    if raw[0][0] != "str":
                        raise FormCalcError("a picture must be a text")
                    return f(raw[0][1].strip('"'), *args[1:])
                if low in ("num2date", "date2num", "encode", "decode", "unitvalue", "str", "wordnum"):
                    args = [a if i == 0 else (t[1].strip('"') if t[0] == "str" else float(t[1])) for i, (a, t) in enumerate(zip(args, raw, strict=True))]
                return f(*args)
            if self.peek() == "[" and low in self.lists:
                self.take()
                if self.peek() == "*":
                    self.take()
                    self.take("]")
                    return Many(self.lists[low])
                at = fc_num(self.expression()).cast("int")
                self.take("]")
                return F.get(self.lists[low], at)
            if low in self.lists:
                return F.get(self.lists[low], F.lit(0))
            if low in self.env:
                return self.env[low]
            raise FormCalcError(f"no field {text}")
        raise FormCalcError(f"unexpected {text!r}")


def formcalc(script: str, fields: Mapping[str, Column], lists: Mapping[str, Column] | None = None) -> Column:
    """A script over columns, compiled once on the driver."""
    return Compiler(fields, lists).compile(script)


def names(script: str) -> list[str]:
    """The names in a script that are neither functions nor words of the language nor its own variables."""
    text = re.sub(r"(?m)(//|;;).*$", "", script)
    tokens = [(m.lastgroup, m[m.lastgroup]) for m in _TOKEN.finditer(text)]
    own = {b[1].lower() for a, b in zip(tokens, tokens[1:], strict=False) if a[1].lower() == "var"}
    out = []
    for (kind, word), after in zip(tokens, [*tokens[1:], ("", "")], strict=True):
        if kind == "id" and after[1] != "(" and word.lower() not in own | _LITERAL | _WORDS and word not in out:
            out.append(word)
    return out
