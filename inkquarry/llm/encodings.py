"""Problem 4: text decoded with a wrong encoding.

Method: every distinct clean word of the corpus is put through all encoding chains (written in one encoding, read in
another, also twice); the garbled forms make a table that the tokens of the text are hash-joined with. A hit is verified
(the original must be better attested than the garbled form, or the form must be too regular for chance) and the original
is put in its place.

Every chain leaves ASCII as it is, so a garbled word is garbled only in its maximal non-ASCII stretches. Chains through
UTF-8 are therefore joined by stretch, which also finds words whose clean spelling occurs nowhere; chains between
one-byte encodings, where a stretch alone proves nothing, and chains that lose characters are joined by whole word.

Verified are originals whose stretches, or which as whole words, clean words of the corpus have. Forms of single letters of
the alphabets are in the table as well, so that a garbled word is found even if no clean word has its letters; it is then
given back as it is. Nothing is collected or broadcast: words, forms and hits stay tables that meet by sorted shuffles, all
counts are over all text.

Defined results: null and empty text has no tokens and is never found; extra columns are ignored; repeated rows count
once; text in which the lost characters cannot be told is found but given back as it is.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .units import UNIT

# Encodings that text is commonly written in or mistaken for, and signs that typographic text uses.
WESTERN = ("cp1252", "latin_1", "cp1250", "cp437", "cp850", "mac_roman", "iso8859_15", "cp1254")
CYRILLIC = ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic")
GREEK = ("cp1253", "iso8859_7", "mac_greek", "cp737")
OTHERS = ("cp1257", "cp775", "mac_latin2", "cp852", "koi8_u")
SIGNS = "‘’‚“”„–—…€£«»²³½¼¾°§©®·•¡¿№™‹›"

_ONE_BYTE = WESTERN + CYRILLIC + GREEK + OTHERS
#: Encodings a word is first written in, by script.
_WRITTEN = {"LATIN": WESTERN, "CYRILLIC": CYRILLIC + ("koi8_u",), "GREEK": GREEK}
_MISREAD = ("cp1252", "latin_1", "cp1250", "cp1251", "cp1253", "cp437", "cp850", "cp866", "mac_roman", "koi8_r", "cp1254", "iso8859_7", "mac_cyrillic", "iso8859_5", "cp1257", "cp852", "mac_greek", "iso8859_15", "cp737")
_PAIRS = ("“”", "‘’", "„“", "«»", "»«", "‚‘", "‹›")
_MONEY = ("€", "£", "¥")
_DASHES = ("–", "—", "…", "•")
#: Letters that are words, or look like ASCII letters that are: alone they prove nothing.
_LONE = frozenset("àáâãéèêíóòôúÀÁÉÈÊÓÒÚ" + "ивскуояаэёИВСКУОЯАЭ" + "ηοωΗΟΩ")
LOOK_ALIKE = frozenset("АВЕЅЗІЈКМНОРСТУХавеѕіјкмнорстухΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναιρυγ")
_QUOTED = re.compile(r"^[(\[]?([^\x00-\x7f])(?=[A-Za-z0-9])[\x21-\x7e]*?([^\x00-\x7f])[.,;:!?)\]]*$")
_PRICED = re.compile(r"^[(]?([^\x00-\x7f])[0-9][0-9.,]*\)?$")
_NON_ASCII = re.compile(r"[^\x00-\x7f]+")
#: How often a word counts in one file at most, when forms and originals are weighed.
VOTES = 20
#: ASCII marks around a word are not part of it.
_EDGE = "\"'()[]{}<>.,;:!"
_EDGE_CLASS = r"\"'()\[\]{}<>.,;:!"


def core(token: str) -> str:
    return token.strip(_EDGE)


def _script(c: str) -> str:
    return unicodedata.name(c, "").partition(" ")[0]


def clean_word(word: str) -> str | None:
    """The script of a word that reads as ordinary text, or None."""
    inner = word.strip("«»“”„‘’‚!?¡¿")
    scripts, letters = set(), []
    for c in inner:
        if c.isalpha():
            scripts.add("LATIN" if c < "\x80" else _script(c))
            letters.append(c)
        elif c not in "-'’·.²³":
            return None
    if len(scripts) != 1 or not letters or unicodedata.normalize("NFKC", x := re.sub("[²³]", "", inner)) != x:
        return None
    if not (inner.islower() or inner.isupper() or (inner[0].isupper() and inner[1:].islower()) or all(x.islower() or x.isupper() or x.istitle() for x in re.split("[-'’.]", inner) if x)):
        return None
    script = scripts.pop()
    if script not in _WRITTEN:
        return None
    if script == "LATIN" and len(letters) > 2 and sum(c >= "\x80" for c in letters) > 0.6 * len(letters):
        return None
    return script


def _read(data: bytes, enc: str) -> list[str]:
    """How the bytes read: bytes without a character become the replacement sign, or the control of that number."""
    try:
        return [data.decode(enc)]
    except UnicodeDecodeError:
        as_control = "".join(_char(b, enc) for b in data)
        return [as_control, data.decode(enc, "replace")]


def _char(b: int, enc: str) -> str:
    try:
        return bytes([b]).decode(enc)
    except UnicodeDecodeError:
        return chr(b)


def _write(text: str, enc: str) -> bytes | None:
    out = bytearray()
    for c in text:
        try:
            out += c.encode(enc)
        except UnicodeEncodeError:
            if "\x80" <= c <= "\x9f" and enc != "utf_8":
                out.append(ord(c))
            else:
                return None
    return bytes(out)


def through_utf8(stretch: str, depth: int = 2) -> dict[str, str]:
    """Garbled forms of a non-ASCII stretch that was written in UTF-8 and read in a one-byte encoding, once or twice."""
    found: dict[str, str] = {}
    for enc in _MISREAD:
        for once in _read(stretch.encode(), enc):
            if once != stretch:
                found.setdefault(once, f"utf_8>{enc}")
            if depth > 1 and "�" not in once:
                for again in (enc, "cp1252", "latin_1"):
                    for twice in _read(once.encode(), again):
                        found.setdefault(twice, f"utf_8>{enc}>utf_8>{again}")
    # the other way round: bytes of a one-byte encoding read as UTF-8 lose the characters
    found.setdefault("�" * len(stretch), "one-byte>utf_8")
    return found


def one_byte(word: str, script: str) -> dict[str, str]:
    """Garbled forms of a word between two one-byte encodings, and with its characters lost."""
    found: dict[str, str] = {}
    for a in _WRITTEN[script]:
        data = _write(word, a)
        if data is None:
            continue
        for b in _ONE_BYTE:
            if a != b:
                for form in _read(data, b):
                    if form != word:
                        found.setdefault(form, f"{a}>{b}")
    found.setdefault(re.sub(r"[^\x00-\x7f]", "?", word), "lost")
    return found


def stretches(token: str) -> list[str]:
    return _NON_ASCII.findall(token)


def suspicious(text):
    """Whether a text has a token that any chain could have made."""
    return text.rlike(r"[^\x00-\x7F]|\?[^\s?]|\?\?|\w\?")


def tokens(units: DataFrame) -> DataFrame:
    """``UNIT``, ``home`` and ``token``: the blank-separated tokens that hold more than ASCII, or a question mark, with the script of their text."""
    split = units.where(suspicious(F.col("text"))).select(*UNIT, F.split("text", r"[ \t\r\n\f]+").alias("all"), home_script(F.col("text")).alias("home"))
    some = F.filter("all", lambda t: t.rlike(r"[^\x00-\x7F]|\?"))
    return split.select(*UNIT, "home", F.explode(some).alias("token"))


def home_script(text):
    """The script of most letters of a text: C for Cyrillic, G for Greek, L for all others, nothing without letters."""
    n = {s: F.length(F.regexp_replace(text, f"[^{of}]+", "")) for s, of in (("C", r"\p{IsCyrillic}"), ("G", r"\p{IsGreek}"), ("L", r"\p{L}"))}
    latin = n["L"] - n["C"] - n["G"]
    other = F.when(n["L"] == 0, "").when(n["C"] > F.greatest(n["G"], latin), "C").when(n["G"] > F.greatest(n["C"], latin), "G").otherwise("L")
    # most texts have letters of neither script: told without counting
    return F.when(text.rlike(r"[\p{IsCyrillic}\p{IsGreek}]"), other).when(text.rlike(r"\p{L}"), "L").otherwise("")


_FORM = "form string, by string, original string, chain string, n bigint"
_FORM_TYPES = (pa.string(),) * 4 + (pa.int64(),)
_LOOKUP = "token string, n bigint, form string, by string"


def _batch(rows: list[tuple], types, names) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=list(names))


def _sign_forms(sign: str) -> Iterator[tuple[str, str, str]]:
    """(form, by, chain) of typographic signs between one-byte encodings: quotes around a word, money before digits, dashes alone."""
    by = "pair" if sign in _PAIRS else "price" if sign in _MONEY else "dash"
    for a in WESTERN + ("cp1251",):
        data = _write(sign, a)
        if data is None:
            continue
        for b in _MISREAD:
            form = _char(data[0], b) + ("\0" + _char(data[1], b) if by == "pair" else "")
            # a sign in common use says nothing
            if form[0] == sign[0] or form.isascii() or form in SIGNS:
                continue
            if by == "pair" or (form not in _LONE and form not in LOOK_ALIKE) or (by == "price" and form == "Ј"):
                yield form, by, f"{a}>{b}"


def _part_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) to forms of stretches through UTF-8, and of typographic signs."""
    for b in batches:
        seen: dict[tuple[str, str, str], tuple[str, int]] = {}
        for token, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            word = core(token)
            if word in _PAIRS or word in _MONEY or word in _DASHES:
                for form, by, chain in _sign_forms(word):
                    seen.setdefault((form, by, word), (chain, n))
            parts = stretches(word) if clean_word(word) else [x for x in stretches(word) if all(c in SIGNS for c in x)]
            for p in parts:
                for form, chain in through_utf8(p).items():
                    seen.setdefault((form, "part", p), (chain, n))
        yield _batch([(*k, *v) for k, v in seen.items()], _FORM_TYPES, ("form", "by", "original", "chain", "n"))


def _word_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) to forms of whole clean words between one-byte encodings."""
    for b in batches:
        seen: dict[tuple[str, str], tuple[str, int]] = {}
        for token, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            word = core(token)
            if script := clean_word(word):
                for form, chain in one_byte(word, script).items():
                    seen.setdefault((form, word), (chain, n))
        yield _batch([(f, "word", w, *v) for (f, w), v in seen.items()], _FORM_TYPES, ("form", "by", "original", "chain", "n"))


def _best(forms: DataFrame) -> DataFrame:
    """The best attested original of each form."""
    best = F.max_by(F.struct("original", "chain"), F.struct("n", "original", "chain"))
    return forms.groupBy("form", "by").agg(best.alias("o"), F.max("n").alias("n_original")).select("form", "by", "o.original", "o.chain", "n_original")


def part_forms(words: DataFrame) -> DataFrame:
    """Garbled forms of the stretches of all clean words in ``words(token, n)``, and of typographic signs and letters."""
    letters = "".join(chr(c) for r in ((0xC0, 0x180), (0x384, 0x3CF), (0x400, 0x460)) for c in range(*r) if chr(c).isalpha())
    alone = [*SIGNS, *letters, *_PAIRS]
    seeds = words.sparkSession.createDataFrame([(c, 0) for c in alone], "token string, n bigint").coalesce(1)
    return _best(words.unionByName(seeds).mapInArrow(_part_forms, _FORM))


def word_forms(words: DataFrame) -> DataFrame:
    """Garbled forms of all clean words in ``words(token, n)``, whole."""
    return _best(words.mapInArrow(_word_forms, _FORM))


def _part_lookups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for token, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for x in set(stretches(token)):
                rows.append((token, n, x, "part"))
            word = core(token)
            if (m := _QUOTED.match(token)) is not None:
                rows.append((token, n, f"{m[1]}\0{m[2]}", "pair"))
            if (m := _PRICED.match(token)) is not None:
                rows.append((token, n, m[1], "price"))
            if len(word) == 1:
                rows.append((token, n, word, "dash"))
        yield _batch(rows, (pa.string(), pa.int64(), pa.string(), pa.string()), ("token", "n", "form", "by"))


def _restore_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens with the hits of their stretches to (token, n, restored, chain), where the stretches prove a wrong decoding."""
    for b in batches:
        rows = []
        for token, n, hits in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            signs = [h for h in hits if h["by"] != "part"]
            known = {h["form"]: h for h in hits if h["by"] == "part" and len(h["form"]) > len(h["original"]) and "�" not in h["form"] and not LOOK_ALIKE.issuperset(h["form"])}
            # a form is longer than its original: too regular for chance, unless the token reads as an ordinary word
            if known and (len(known) == len(set(stretches(token))) or clean_word(core(token)) is None):
                back = _NON_ASCII.sub(lambda m: known[m[0]]["original"] if m[0] in known else m[0], token)  # noqa: B023
                verified = all(h["n_original"] > 0 or all(c in SIGNS for c in h["original"]) for h in known.values())
                rows.append((token, n, back if verified else None, next(iter(known.values()))["chain"]))
            elif signs and clean_word(core(token)) is None or any(h["by"] != "pair" for h in signs):
                s = signs[0]
                if s["by"] == "pair":
                    x, y = s["form"].split("\0")
                    i, j = token.index(x), token.rindex(y)
                    back = token[:i] + s["original"][0] + token[i + 1 : j] + s["original"][1] + token[j + 1 :]
                else:
                    back = token.replace(s["form"], s["original"], 1)
                rows.append((token, n, back, s["chain"]))
        yield _batch(rows, (pa.string(), pa.int64(), pa.string(), pa.string()), ("token", "n", "restored", "chain"))


def garbled_tokens(words: DataFrame) -> DataFrame:
    """``(token, restored, chain, weak)`` for every distinct token of ``words(token, n)`` that is a garbled form.

    ``restored`` is null where characters are lost for good. ``weak`` marks forms of one or two characters, which prove
    nothing by themselves.
    """
    hits = words.mapInArrow(_part_lookups, _LOOKUP).join(part_forms(words).hint("merge"), ["form", "by"])
    by_part = (
        hits.groupBy("token")
        .agg(F.max("n").alias("n"), F.collect_list(F.struct("form", "by", "original", "chain", "n_original")).alias("hits"))
        .mapInArrow(_restore_parts, "token string, n bigint, restored string, chain string")
    )
    # what was restored so far is attested as well: it may be garbled by other chains elsewhere
    by_part = stored(by_part, "encodings-parts")
    left = words.join(by_part.hint("merge"), "token", "left_anti")
    attested = left.unionByName(by_part.where("restored is not null").select(F.col("restored").alias("token"), "n"))
    core_of = F.regexp_replace("token", "^[" + _EDGE_CLASS + "]+|[" + _EDGE_CLASS + "]+$", "")
    looked = left.withColumn("form", core_of)
    counts = looked.groupBy("form").agg(F.sum("n").alias("n_form"))
    known = word_forms(attested.groupBy(core_of.alias("token")).agg(F.sum("n").alias("n"))).drop("by")
    by_word = looked.join(counts.hint("merge"), "form").join(known.hint("merge"), "form").mapInArrow(_restore_words, "token string, restored string, chain string, weak boolean")
    lost = left.where(F.col("token").rlike("�|\\w\\?\\?|\\?\\?\\w|\\?\\?\\?")).select("token", F.lit(None).cast("string").alias("restored"), F.lit("lost").alias("chain"), F.lit(False).alias("weak"))
    every = by_part.select("token", "restored", "chain", F.lit(False).alias("weak")).unionByName(by_word).unionByName(lost)
    best = F.max_by(F.struct("restored", "chain", "weak"), F.struct(F.col("restored").isNotNull(), ~F.col("weak")))
    return every.groupBy("token").agg(best.alias("b")).select("token", "b.*")


def _restore_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d, rows = b.to_pydict(), []
        for token, form, n, original, chain, attested in zip(d["token"], d["form"], d["n_form"], d["original"], d["chain"], d["n_original"], strict=True):
            # an ordinary-looking word must be far rarer than what it would be a form of
            if ("�" in form and len(form) > 2) or attested > (3 * n if clean_word(form) else n) or (clean_word(form) is None and attested > 1):
                if any(c.isalpha() or c > "\x7f" for c in form):
                    rows.append((token, token.replace(form, original), chain, len(form) < 3 and "�" not in form))
        yield _batch(rows, (pa.string(), pa.string(), pa.string(), pa.bool_()), ("token", "restored", "chain", "weak"))


def garbled(units: DataFrame) -> DataFrame:
    """``UNIT, token, restored, chain``: every occurrence of a garbled token.

    Weak tokens count where the same chain garbled something else in the same text, and where the original is in the
    script of the text's other letters but the form isn't.
    """
    # each step reads a written table: without that the plan repeats itself at every join
    toks = stored(tokens(units), "encodings-tokens")
    # a file has at most VOTES votes for a word: one garbled file, however large, doesn't make its forms usual
    by_file = toks.groupBy("token", "src", "doc_id").agg(F.least(F.count("*"), F.lit(VOTES)).alias("n"))
    words = stored(by_file.groupBy("token").agg(F.sum("n").alias("n")), "encodings-words")
    hits = toks.join(garbled_tokens(words).hint("merge"), "token")
    of_chain = F.collect_set(F.struct("chain", "token"))
    at_home = F.col("weak") & F.col("restored").isNotNull() & (home_script(F.col("restored")) == F.col("home")) & (home_script(F.col("token")) != F.col("home"))
    # signs in common use, and letters that look like those of the text's script, stand anywhere
    at_home &= ~F.col("token").rlike("[" + re.escape(SIGNS) + "".join(sorted(LOOK_ALIKE)) + "]")
    hits = hits.withColumn("weak", F.col("weak") & ~at_home)
    strong = F.max(~F.col("weak"))
    per = hits.groupBy(*UNIT).agg(strong.alias("any_strong"), F.size(of_chain).alias("n_hits"), F.size(F.collect_set("chain")).alias("n_chains"), F.collect_list(F.struct("token", "restored", "chain", "weak")).alias("t"))
    sure = per.where(F.col("any_strong") | (F.col("n_hits") > F.col("n_chains")))
    return sure.select(*UNIT, F.inline("t")).drop("weak")


def found(units: DataFrame) -> DataFrame:
    """Keys of the units with garbled text."""
    return garbled(units).select(*UNIT).distinct()


def restored(units: DataFrame) -> DataFrame:
    """``UNIT, text, restored``: the affected texts with every verified original in place of its garbled token."""
    g = garbled(units).where(F.col("restored").isNotNull()).select(*UNIT, "token", "restored").distinct()
    swaps = g.groupBy(*UNIT).agg(F.map_from_entries(F.collect_list(F.struct("token", "restored"))).alias("swap"))
    words = F.split("text", r"(?<=[ \t\r\n\f])|(?=[ \t\r\n\f])")
    back = F.array_join(F.transform(words, lambda w: F.coalesce(F.col("swap")[w], w)), "")
    return units.join(swaps.hint("merge"), list(UNIT)).select(*UNIT, "text", back.alias("restored"))
