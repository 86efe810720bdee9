"""Text search, patterns, labels and small text functions as Column expressions.

Null text has no matches and no value. Java regular expressions are used throughout; where an oracle engine has none of
their look-around, its query pads the text instead.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# patterns

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9-])"
PHONE = r"(?<![\w+])(?:\+(?=\d)|(?=[(\d]))\(?\d[\d .()\-]{8,18}\d(?!\d)"
CARD = r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"
SSN = r"(?<![\w-])(?!000|666|9)\d{3}(?:-(?!00)\d{2}-|\x20(?!00)\d{2}\x20)(?!0000)\d{4}(?![\w-])"
_MONTH = r"(?:Jan(?:uary|\.)?|Feb(?:ruary|\.)?|Mar(?:ch|\.)?|Apr(?:il|\.)?|May|Jun(?:e|\.)?|Jul(?:y|\.)?|Aug(?:ust|\.)?|Sep(?:t\.?|tember|\.)?|Oct(?:ober|\.)?|Nov(?:ember|\.)?|Dec(?:ember|\.)?)"
DATE = (
    r"(?<![\w/.-])(?:\d{1,2}/\d{1,2}/(?:\d{4}|\d{2})|\d{1,2}\.\d{1,2}\.(?:\d{4}|\d{2})|\d{4}-\d{1,2}-\d{1,2}"
    rf"|{_MONTH} \d{{1,2}},? \d{{4}}|\d{{1,2}} {_MONTH},? \d{{4}})(?![\w/-])"
)
URL = r"(?i)(?:https?://|www\.)[^\s<>\"'()\[\]{}]+"


def _all(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), F.array().cast("array<string>"))


def emails(text: Column) -> Column:
    return _all(text, EMAIL)


def phones(text: Column) -> Column:
    """10 digits, 11 with a country code, grouped by at least one separator, 20 characters at most."""

    def ok(m: Column) -> Column:
        digits = F.length(F.regexp_replace(m, r"\D", ""))
        return digits.between(10, 11) & F.regexp_replace(m, r"^\+", "").rlike(r"\D") & (F.length(m) <= 20)

    return F.filter(_all(text, PHONE), ok)


def cards(text: Column) -> Column:
    """Card numbers with a valid check digit."""
    return F.filter(_all(text, CARD), lambda m: luhn(m))


def luhn(m: Column) -> Column:
    d = F.reverse(F.split(F.regexp_replace(m, r"\D", ""), ""))
    total = F.aggregate(
        F.transform(d, lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + x
    )
    return total % 10 == 0


def ssns(text: Column) -> Column:
    return _all(text, SSN)


def dates(text: Column) -> Column:
    return _all(text, DATE)


PATTERNS = {"email": emails, "phone": phones, "credit_card": cards, "ssn": ssns, "date": dates}


def urls(text: Column) -> Column:
    """Web addresses, trailing punctuation cut off; www. gets a scheme."""
    cut = F.transform(_all(text, URL), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))
    return F.transform(cut, lambda u: F.when(F.lower(F.left(u, F.lit(4))) == "www.", F.concat(F.lit("http://"), u)).otherwise(u))


def url_policy(url: Column) -> Column:
    """struct(allowed, host, reason): web and mail links are allowed, everything else is blocked with the reason."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    ok = scheme.isin("http", "https") & (host != "") | (scheme == "mailto")
    reason = F.when(ok, "").when(scheme == "", "no scheme").when(scheme.isin("http", "https"), "no host").otherwise(F.concat(F.lit("scheme "), scheme))
    return F.struct(ok.alias("allowed"), host.alias("host"), reason.alias("reason"))


# search


def phrase_pattern(phrase: str, case_sensitive: bool = False, whole_words: bool = False) -> str:
    """Java pattern of a phrase: any white space matches any, letters without case unless asked for."""
    words = [re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", w) for w in phrase.split()]
    body = r"\s+".join(words)
    if whole_words:
        body = rf"(?<![\p{{L}}\p{{N}}]){body}(?![\p{{L}}\p{{N}}])"
    return body if case_sensitive else f"(?iu){body}"


def find(text: Column, phrase: str, case_sensitive: bool = False, whole_words: bool = False) -> Column:
    """Start positions (from 0) of a phrase, left to right, not overlapping. An empty phrase is nowhere."""
    none = F.array().cast("array<int>")
    if not phrase.split():
        return none
    pattern = phrase_pattern(phrase, case_sensitive, whole_words)
    # the lengths of the pieces between matches and of the matches give the positions
    hits = F.coalesce(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), F.array().cast("array<string>"))
    gaps = F.split(text, pattern, -1)
    walked = F.aggregate(
        F.sequence(F.lit(0), F.size(hits) - 1),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, i: F.struct((acc["at"] + F.length(gaps[i]) + F.length(hits[i])).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.length(gaps[i]))).alias("out")),
        lambda acc: acc["out"],
    )
    return F.when(F.size(hits) > 0, walked).otherwise(none)


def context(text: Column, start: Column, length: int, around: int = 36) -> Column:
    a = F.greatest(start - around, F.lit(0))
    return F.substring(text, a + 1, start - a + length + around)


def word_count(text: Column) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


# labels and numbers


def roman(n: Column) -> Column:
    """Lower-case Roman numeral of 1 to 3999, empty outside."""
    out, rest = F.lit(""), n.cast("int")
    for v, s in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        k = F.floor(rest / v).cast("int")
        out, rest = F.concat(out, F.repeat(F.lit(s), k)), rest % v
    return F.when(n.between(1, 3999), out).otherwise("")


def letters(n: Column) -> Column:
    """a to z, then aa, bb and so on (27 is aa)."""
    k = (n - 1).cast("int")
    return F.when(n >= 1, F.repeat(F.char(F.lit(97) + k % 26), F.floor(k / 26).cast("int") + 1)).otherwise("")


def page_label(style: Column, prefix: Column, number: Column) -> Column:
    """Label of a page: styles D, R, r, A, a; another or null style shows the prefix only."""
    shown = (
        F.when(style == "D", number.cast("string")).when(style == "R", F.upper(roman(number))).when(style == "r", roman(number))
        .when(style == "A", F.upper(letters(number))).when(style == "a", letters(number)).otherwise("")
    )
    return F.concat(F.coalesce(prefix, F.lit("")), shown)


def natural_key(text: Column) -> Column:
    """Sort key: without case, runs of digits by value."""
    parts = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, r"^0+(?=\d)", ""), 20, "0")).otherwise(p)), "")


def header_tokens(template: str, page: Column, pages: Column, bates: Column | None = None) -> Column:
    """Header and footer tokens: <<1>>, <<n>>, <<1 of n>>, <<Page 1 of n>>, <<#digits#start#prefix#suffix>>."""
    out = F.lit(template)
    for token, value in (
        ("<<Page 1 of n>>", F.concat(F.lit("Page "), page.cast("string"), F.lit(" of "), pages.cast("string"))),
        ("<<1 of n>>", F.concat(page.cast("string"), F.lit(" of "), pages.cast("string"))),
        ("<<1>>", page.cast("string")),
        ("<<n>>", pages.cast("string")),
    ):
        out = F.replace(out, F.lit(token), value)
    if m := re.search(r"<<#(\d+)#(\d+)(?:#([^#>]*))?(?:#([^#>]*))?>>", template):
        seq = (bates if bates is not None else page) + int(m[2]) - 1
        out = F.replace(out, F.lit(m[0]), F.concat(F.lit(m[3] or ""), F.lpad(seq.cast("string"), F.greatest(F.lit(int(m[1])), F.length(seq.cast("string"))), F.lit("0")), F.lit(m[4] or "")))
    return out


def pretty_date(text: Column) -> Column:
    """D:YYYYMMDDHHmmSS as ``YYYY-MM-DD HH:mm``; missing parts are the first of their kind, other text stays."""
    d = F.regexp_extract(text, r"^(?:D:)?(\d{4,14})", 1)
    full = F.rpad(d, 14, "x")

    def part(at: int, n: int, fallback: str) -> Column:
        p = F.substring(full, at, n)
        return F.when(p.rlike("^\\d+$"), p).otherwise(fallback)

    shown = F.concat(part(1, 4, "0000"), F.lit("-"), part(5, 2, "01"), F.lit("-"), part(7, 2, "01"), F.lit(" "), part(9, 2, "00"), F.lit(":"), part(11, 2, "00"))
    return F.when(d == "", text).otherwise(shown)


def pdf_date(ts: Column) -> Column:
    return F.concat(F.lit("D:"), F.date_format(ts, "yyyyMMddHHmmss"), F.lit("Z"))


def csv_cell(text: Column) -> Column:
    """Always quoted; what a spreadsheet would run as a formula gets an apostrophe."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    safe = F.when(t.rlike(r"^\s*[=+@-]|^[\t\r]"), F.concat(F.lit("'"), t)).otherwise(t)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def decode_text(data: Column) -> Column:
    """Text strings of documents: UTF-16 or UTF-8 after their mark, else Latin."""
    h = F.hex(F.substring(data, 1, 3))
    return F.when(h.startswith("FEFF"), F.decode(F.substring(data, 3, 2147483647), "UTF-16BE")).when(h == "EFBBBF", F.decode(F.substring(data, 4, 2147483647), "UTF-8")).otherwise(F.decode(data, "ISO-8859-1"))
