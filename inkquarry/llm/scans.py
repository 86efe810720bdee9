"""Problem 5: recognised pages into continuous paragraphs.

Method: noisy channel. A seen word is a clean word sent through a channel that confuses characters; the probabilities of
the confusions are estimated from the corpus (rare forms beside frequent words they are one confusion away from), those
of the clean words from corpus unigrams and bigrams, and Viterbi picks the most likely words of each line among the
candidates; letters for figures are such confusions too. Words joined to their neighbour, torn apart, or broken at a line
end are told by the same n-gram counts. All limits are ratios of counts, so they mean the same at every size of the corpus.

Steps: page frames (headers, footers, page numbers) by geometry and number sequence; counts over all body words;
candidates for distinct forms by hash joins on generated spellings; Viterbi for the lines that have candidates; joining
of the pieces. Nothing is collected; the largest group is one page.

Defined results: null words are left out, empty words stay and are never flagged; a page that comes twice counts once;
a page of only frame lines has no paragraphs; ties in Viterbi keep the word as seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

# Confusions of printed characters, as clean text and what is seen for it.
CONFUSIONS = (
    ("i", "l"), ("i", "1"), ("i", "!"), ("i", "I"), ("l", "I"), ("l", "1"), ("l", "i"), ("l", "!"), ("I", "l"), ("I", "1"), ("t", "l"), ("o", "0"), ("O", "0"), ("o", "c"), ("a", "o"), ("o", "a"),
    ("e", "c"), ("c", "e"), ("m", "rn"), ("rn", "m"), ("n", "ri"), ("n", "ii"), ("h", "li"), ("li", "h"), ("h", "b"), ("b", "h"), ("d", "cl"), ("cl", "d"), ("u", "ii"), ("u", "n"), ("n", "u"),
    ("w", "vv"), ("vv", "w"), ("s", "5"), ("S", "5"), ("B", "8"), ("b", "6"), ("G", "6"), ("g", "9"), ("q", "g"), ("f", "ſ"), ("f", "t"), ("t", "f"), ("v", "y"), ("y", "v"), ("ß", "B"), ("é", "6"), ("z", "2"), ("Z", "2"),
    ("ü", "ii"), ("ö", "o"), ("r", "i"), ("in", "m"), ("m", "in"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("E", "F"), ("F", "E"), ("C", "G"), ("D", "O"), ("Q", "O"), ("T", "I"), ("T", "7"), ("s", "ſ"),
)
#: After a mark at a line end a word that is at least this share of all words is taken for a word of its own, after a dash and
#: after a hyphen, where nothing else is known.
DASHED, HYPHENED = 2e-5, 1e-4
#: A form with fewer occurrences than this share of a candidate's is taken for the work of the channel.
SHADOW = 0.05
BREAKS = "-=‐­–¬—"
_EDGES = "\"'()[]{}«»“”„‘’.,;:!?*"
_NUMBER = r"[0-9OoIlSsBZz|!]{1,5}"
_ROMAN = r"[ivxlcdmIVXLCDM1]{1,9}"
_STRONG = tuple(
    re.compile(p) for p in (rf"(?:Page|Seite|Página|Pagina|Pag[eg]?\.?) ({_NUMBER}) (?:of|von|de|di|sur|/|ot) {_NUMBER}", rf"[-–—] ({_NUMBER}|{_ROMAN}) [-–—]", rf"\[({_NUMBER}|{_ROMAN})\]", rf"({_NUMBER})/{_NUMBER}")
)
_WHOLE = re.compile(rf"({_NUMBER}|{_ROMAN})")
_DIGIT_OF = {ord(a): b for a, b in zip("OoIlSsBZz|!", ("0", "0", "1", "1", "5", "5", "8", "2", "2", "1", "1"), strict=True)}
_PAGE = "doc_id bigint, page int, words array<struct<ord:int,text:string,line:int,x0:double,y0:double,x1:double>>"


def roman_value(s: str) -> int | None:
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    n, last = 0, 0
    for c in reversed(s.lower().replace("1", "i")):
        if c not in values:
            return None
        n += values[c] if values[c] >= last else -values[c]
        last = max(last, values[c])
    return n


def roman(n: int) -> str:
    out = ""
    for v, s in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= v:
            out, n = out + s, n - v
    return out


def value(s: str) -> int | None:
    t = s.translate(_DIGIT_OF)
    if t.isdigit() and any(c.isdigit() for c in s):
        return int(t)
    return roman_value(s) if re.fullmatch(_ROMAN, s) else None


def lines_of(words: list[dict]) -> list[list[dict]]:
    out: list[list[dict]] = []
    for w in sorted(words, key=lambda w: w["ord"]):
        if out and out[-1][-1]["line"] == w["line"]:
            out[-1].append(w)
        else:
            out.append([w])
    return out


def frame(lines: list[list[dict]], wide: float = 1.5) -> tuple[int, int]:
    """How many lines at the top and at the bottom stand apart from the body."""
    ys = [x[0]["y0"] for x in lines]
    if len(ys) < 2 or any(y is None for y in ys):
        return 0, 0
    gaps = [b - a for a, b in zip(ys, ys[1:], strict=False)]
    usual = Counter(round(g, 1) for g in gaps if g > 0)
    step = max(usual, key=lambda g: (usual[g], -g)) if usual and max(usual.values()) > 1 else median(gaps)
    if step <= 0:
        return 0, 0
    top = next((i + 1 for i in range(min(2, len(gaps)) - 1, -1, -1) if gaps[i] > wide * step and i + 1 < len(lines)), 0)
    apart = [i for i in range(max(0, len(gaps) - 3), len(gaps)) if gaps[i] > 4 * step and i >= top]
    return top, len(lines) - 1 - apart[0] if apart else 0


def number_spans(text: list[str]) -> Iterator[tuple[int, int, str, bool]]:
    """(first, end, number, sure) of the word groups of a frame line that may be its page number."""
    n = len(text)
    for a, b in [(0, n)] + [(0, k) for k in (4, 3, 1) if k < n] + [(n - k, n) for k in (4, 3, 1) if k < n]:
        s = " ".join(text[a:b])
        for p in _STRONG:
            if m := p.fullmatch(s):
                yield a, b, m[1], True
                break
        else:
            # the number of a volume is no page number
            if b - a == 1 and (m := _WHOLE.fullmatch(s)) and not (a and re.fullmatch(r"[^\W\d]{1,4}\.", text[a - 1])):
                yield a, b, m[1], n == 1


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages to (doc_id, offset): number minus page, for every group that may be a page number; sure ones count thrice."""
    for b in batches:
        docs, offsets, weights = [], [], []
        for doc, page, words in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            ls = lines_of(words)
            top, bottom = frame(ls)
            for x in ls[:top] + ls[len(ls) - bottom :]:
                for _, _, s, sure in number_spans([w["text"] for w in x]):
                    if (v := value(s)) is not None:
                        docs.append(doc)
                        offsets.append(v - page)
                        weights.append(3 if sure else 1)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(offsets, pa.int32()), pa.array(weights, pa.int32())], names=["doc_id", "offset", "weight"])


def looks_like(seen: str, n: int) -> bool:
    """Whether the seen text can be that number, in figures or Roman, with one character misread."""
    for want in (str(n), roman(n) if 0 < n < 4000 else "", roman(n).upper() if 0 < n < 4000 else ""):
        if want and len(want) == len(seen):
            wrong = [(a, b) for a, b in zip(want, seen, strict=True) if a != b]
            if not wrong or (len(wrong) == 1 and len(want) > 1 and not wrong[0][1].isdigit()) or all((a, b) in _LIKE or value(b) == value(a) for a, b in wrong):
                return True
    return False


_LIKE = {(a, b) for a, b in CONFUSIONS} | {("1", "l"), ("1", "I"), ("0", "O"), ("0", "o"), ("5", "S"), ("8", "B"), ("2", "Z"), ("6", "b"), ("1", "!")}


def frame_kinds(line: list[str], page: int, offset: int | None) -> list[str]:
    """``running`` or ``page_number`` for every word of a frame line."""
    kinds = ["running"] * len(line)
    best = None
    for a, b, s, sure in number_spans(line):
        fits = offset is not None and looks_like(s, page + offset)
        if fits or (sure and (b - a > 1 or len(line) == 1 or re.search(r"[\[/]", "".join(line[a:b])))):
            rank = (fits, sure, b - a)
            if best is None or rank > best[0]:
                best = rank, a, b
    if best:
        kinds[best[1] : best[2]] = ["page_number"] * (best[2] - best[1])
    return kinds


def pages(words: DataFrame) -> DataFrame:
    """``(doc_id, page, words)``, every key once."""
    w = words.where(F.col("doc_id").isNotNull() & F.col("page").isNotNull() & F.col("ord").isNotNull() & F.col("text").isNotNull())
    one = F.struct(F.col("ord").cast("int").alias("ord"), "text", F.coalesce("line", F.lit(0)).cast("int").alias("line"), *(F.get("rect", F.lit(i)).cast("double").alias(n) for i, n in ((0, "x0"), (1, "y0"), (2, "x1"))))
    got = w.groupBy(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("page").cast("int").alias("page")).agg(F.array_sort(F.collect_list(one)).alias("w"))
    first = F.filter("w", lambda x, i: (i == 0) | (x["ord"] != F.col("w")[F.greatest(i - 1, F.lit(0))]["ord"]))
    return got.select("doc_id", "page", first.alias("words"))


def core(text: str) -> str:
    return text.strip(_EDGES)


_TOKEN = "doc_id bigint, page int, ord int, line int, at int, text string, kind string, word string, mark string, x1 double, ends boolean"
_TOKEN_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_())
_TOKEN_NAMES = ("doc_id", "page", "ord", "line", "at", "text", "kind", "word", "mark", "x1", "ends")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with the offset of their file to words: frame words with their kind, body words with core and break mark."""
    for b in batches:
        rows = []
        for doc, page, words, offset in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            ls = lines_of(words)
            top, bottom = frame(ls)
            at = 0
            for i, x in enumerate(ls):
                if i < top or i >= len(ls) - bottom:
                    for w, kind in zip(x, frame_kinds([w["text"] for w in x], page, offset), strict=True):
                        rows.append((doc, page, w["ord"], w["line"], -1, w["text"], kind, None, None, w["x1"], False))
                    continue
                for j, w in enumerate(x):
                    last = j == len(x) - 1
                    mark = w["text"][-1:] if last and w["text"][-1:] in BREAKS and len(w["text"]) > 1 else ""
                    rows.append((doc, page, w["ord"], w["line"], at, w["text"], None, core(w["text"].rstrip(BREAKS) if mark else w["text"]), mark, w["x1"], last))
                    at += 1
        cols = list(zip(*rows, strict=True)) or [[] for _ in _TOKEN_NAMES]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TOKEN_TYPES, strict=True)], names=list(_TOKEN_NAMES))


def tokens(words: DataFrame) -> DataFrame:
    """All words: ``doc_id, page, ord, line, at, text, kind, word, mark, x1, ends`` (kind is null in the body)."""
    p = stored(pages(words), "scans-pages")
    offsets = p.mapInArrow(_frames, "doc_id bigint, offset int, weight int").groupBy("doc_id", "offset").agg(F.sum("weight").alias("n"))
    usual = offsets.groupBy("doc_id").agg(F.max_by("offset", F.struct("n", -F.col("offset"))).alias("offset"))
    return p.join(usual, "doc_id", "left").select("doc_id", "page", "words", "offset").mapInArrow(_tokens, _TOKEN)


# counts


def follow(body: DataFrame) -> DataFrame:
    """Body words with the next body word of the page (or of the next page) and the one before.

    The window is the page; only the first word of each page travels to the page before.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "page").orderBy("at")
    seq = body.withColumn("next", F.lead(F.struct("word", "text", "ord")).over(w)).withColumn("before", F.lag(F.struct("word", "text", "ends", "mark")).over(w))
    heads = body.where("at = 0").select("doc_id", (F.col("page") - 1).alias("page"), F.struct("word", "text", "ord").alias("head"))
    tails = body.where("ends").groupBy("doc_id", (F.col("page") + 1).alias("page")).agg(F.max_by(F.struct("word", "text", "ends", "mark"), "at").alias("tail"))
    both = seq.join(heads, ["doc_id", "page"], "left").join(tails, ["doc_id", "page"], "left")
    return both.withColumn("over", F.col("next").isNull()).withColumn("next", F.coalesce("next", "head")).withColumn("before", F.coalesce("before", "tail")).drop("head", "tail")


def unigrams(seq: DataFrame) -> DataFrame:
    """``(form, n)`` of whole words, lower case: not the parts of words broken with a mark."""
    whole = (F.col("mark") == "") & (F.coalesce(F.col("before.mark"), F.lit("")) == "") & (F.length("word") > 0)
    return seq.where(whole).groupBy(F.lower("word").alias("form")).agg(F.count("*").alias("n"))


def bigrams(seq: DataFrame) -> DataFrame:
    """``(a, b, n)`` of neighbours with nothing but a blank or a line end between them."""
    plain = (F.col("mark") == "") & (F.coalesce(F.col("before.mark"), F.lit("")) == "") & F.col("next").isNotNull() & F.expr("text rlike '[\\\\w]$'")
    return seq.where(plain).groupBy(F.lower("word").alias("a"), F.lower("next.word").alias("b")).agg(F.count("*").alias("n"))


# candidates


#: From this length on two confusions are found from both ends: one undone in the form, one made in the word.
LONG = 24


def _swapped(s: str, pairs) -> Iterator[tuple[str, tuple[str, str]]]:
    """All strings in which one of the pairs (from, to) is exchanged once."""
    for old, new in pairs:
        k = s.find(old)
        while k >= 0:
            yield s[:k] + new + s[k + len(old) :], (old, new)
            k = s.find(old, k + 1)


_UNDO = tuple((seen, clean) for clean, seen in CONFUSIONS)


def undo(form: str, most: int = 2) -> dict[str, tuple[str, ...]]:
    """Spellings that the form may be a misreading of, with the confusions that lead there."""
    found: dict[str, tuple[str, ...]] = {form: ()}
    layer = {form: ()}
    for _ in range(most):
        new: dict[str, tuple[str, ...]] = {}
        for s, ops in layer.items():
            for t, (seen, clean) in _swapped(s, _UNDO):
                if t not in found and t not in new:
                    new[t] = (*ops, f"{clean}>{seen}")
        found |= new
        layer = new
    del found[form]
    return found


def _generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[], [], [], []]
        for form, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            seen: dict[str, tuple[str, ...]] = {}
            for c, ops in undo(form, 2 if len(form) < LONG else 1).items():
                if c.lower() != form.lower():
                    seen.setdefault(c.lower(), ops)
            for c, ops in seen.items():
                for col, x in zip(cols, (form, n, c, list(ops)), strict=True):
                    col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.string()))], names=["form", "n", "candidate", "ops"])


def _misread_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long words to what one confusion makes of them: (candidate, n_candidate, between, op)."""
    for b in batches:
        cols: list[list] = [[], [], [], []]
        for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for t, (clean, seen) in _swapped(word, CONFUSIONS):
                for col, x in zip(cols, (word, n, t, f"{clean}>{seen}"), strict=True):
                    col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["candidate", "n_candidate", "between", "op"])


def _wild(col: str):
    """One row for each letter of a word, the letter left open: words that differ in one letter share a row."""
    return F.posexplode(F.transform(F.sequence(F.lit(1), F.length(col)), lambda i: F.concat(F.substring(F.col(col), F.lit(1), i - 1), F.lit("\u0001"), F.substring(F.col(col), i + 1, F.length(col)))))


#: Words longer than this share a half instead of all letters but one: the rows for a word stay two, however long it is.
_HALVES = 40


def _one_letter(forms: DataFrame, uni: DataFrame, rarer: float) -> DataFrame:
    """``form, n, candidate, n_candidate, ops``: words of at least four letters that differ in one, of which one is far rarer.

    Words of one length meet on what they share: all letters but one, or for very long ones the first or the second half.
    """
    # a form counts in all its cases: a capital at the beginning of a sentence makes no rare word
    lows = uni.select(F.col("form").alias("low"), F.col("n").alias("n_low"))
    odd = forms.where(F.length("form") > 3).withColumn("low", F.lower("form")).join(lows, "low", "left").select("form", F.greatest("n", F.coalesce("n_low", F.lit(0))).alias("n"), "low")
    words = uni.where(F.length("form") > 3).select(F.col("form").alias("candidate"), F.col("n").alias("n_candidate"))
    # a form that is no rarer than all that share its letters has no candidate: found before any pair is made
    short = F.length("low") < _HALVES
    left = odd.where(short).select("form", "n", "low", _wild("low").alias("at", "open"))
    right = words.where(F.length("candidate") < _HALVES).select("candidate", "n_candidate", _wild("candidate").alias("at_c", "open"))
    top = right.groupBy("open").agg(F.max("n_candidate").alias("most"))
    left = left.join(top, "open").where(F.col("n") * rarer < F.col("most")).drop("most")
    some = left.join(right.where(F.col("n_candidate") > rarer), "open").where((F.col("n") * rarer < F.col("n_candidate")) & (F.col("low") != F.col("candidate")))
    op = lambda at: F.array(F.concat(F.substring("candidate", at + 1, F.lit(1)), F.lit(">"), F.substring("low", at + 1, F.lit(1))))
    near = some.select("form", "n", "candidate", "n_candidate", op(F.col("at")).alias("ops"))

    def halves(col: str):
        k = F.floor(F.length(col) / 2).cast("int")
        return F.posexplode(F.array(F.substring(F.col(col), F.lit(1), k), F.substring(F.col(col), k + 1, F.length(col))))

    far = odd.where(~short).select("form", "n", "low", F.length("low").alias("length"), halves("low").alias("side", "half"))
    far = far.join(words.where(F.length("candidate") >= _HALVES).select("candidate", "n_candidate", F.length("candidate").alias("length"), halves("candidate").alias("side", "half")), ["length", "side", "half"])
    far = far.where((F.col("n") * rarer < F.col("n_candidate")) & (F.col("low") != F.col("candidate")))
    wrong = F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda i: F.substring("low", i + 1, F.lit(1)) != F.substring("candidate", i + 1, F.lit(1)))
    far = far.withColumn("wrong", wrong).where(F.size("wrong") == 1)
    return near.unionByName(far.select("form", "n", "candidate", "n_candidate", op(F.col("wrong")[0]).alias("ops")))


def _figures(forms: DataFrame, uni: DataFrame) -> DataFrame:
    """``form, n, candidate, n_candidate, ops``: numbers, and codes of a letter and figures, read with letters in place of figures.

    A number needn't be attested itself: what counts is how many words are numbers, or such codes.
    """
    classes = uni.groupBy(F.when(F.col("form").rlike("^[0-9]+$"), "number").when(F.col("form").rlike("^[a-z][0-9]+$"), "code").alias("class")).agg(F.sum("n").alias("n_candidate"))
    f = forms.where(_misread_figures("form"))
    number = F.col("form").rlike("^[0-9OolI]+$") & F.col("form").rlike("^[0-9]")
    tail = F.translate(F.when(number, F.col("form")).otherwise(F.expr("substring(form, 2)")), "OolI", "0011")
    clean = F.when(number, tail).otherwise(F.concat(F.lower(F.substring("form", 1, 1)), tail))
    wrong = F.filter(F.split("form", ""), lambda x: x.isin("O", "o", "l", "I"))
    first = F.col("form").substr(1, 1)
    wrong = F.when(~number & first.isin("O", "I"), F.slice(wrong, 2, F.greatest(F.size(wrong) - 1, F.lit(0)))).otherwise(wrong)
    ops = F.transform(wrong, lambda x: F.concat(F.translate(x, "OolI", "0011"), F.lit(">"), x))
    return f.select("form", "n", clean.alias("candidate"), ops.alias("ops"), F.when(number, "number").otherwise("code").alias("class")).join(classes, "class").select("form", "n", "candidate", "n_candidate", "ops")


def candidates(seq: DataFrame, uni: DataFrame, rarer: float = 10.0) -> DataFrame:
    """``(form, n, candidate, n_candidate, ops)``: clean words that distinct forms may be misreadings of.

    Known confusions up to twice, or any single letter for another, or letters for figures. A candidate must be ``rarer``
    times as frequent as the form, at every size of the corpus.
    """
    forms = seq.where((F.length("word") > 1) & ~F.col("word").rlike("^[IVXLCDM]+$")).groupBy(F.col("word").alias("form")).agg(F.count("*").alias("n"))
    undone = stored(forms.mapInArrow(_generate, "form string, n bigint, candidate string, ops array<string>"), "scans-undone")
    words = uni.select(F.col("form").alias("candidate"), F.col("n").alias("n_candidate"))
    known = undone.join(words, "candidate").select("form", "n", "candidate", "n_candidate", "ops")
    # two confusions in a long form: one undone meets one made
    made = words.where(F.length("candidate") >= LONG - 4).mapInArrow(_misread_once, "candidate string, n_candidate bigint, between string, op string")
    met = undone.where(F.length("form") >= LONG).withColumnRenamed("candidate", "between").join(made, "between")
    twice = met.where(F.lower("form") != F.col("candidate")).select("form", "n", "candidate", "n_candidate", F.concat("ops", F.array("op")).alias("ops"))
    # a listed confusion explains a form before any other letter does
    every = known.unionByName(twice).unionByName(_figures(forms, uni)).withColumn("way", F.lit(0)).unionByName(_one_letter(forms, uni, rarer).withColumn("way", F.lit(1)))
    return every.where(F.col("n") * rarer < F.col("n_candidate")).groupBy("form", "candidate").agg(F.max("n").alias("n"), F.max("n_candidate").alias("n_candidate"), F.min_by("ops", F.struct(F.size("ops"), "way", "ops")).alias("ops"))


def channel(cands: DataFrame, uni: DataFrame) -> DataFrame:
    """``(op, p)``: how likely each confusion is, from the corpus: misread occurrences by occurrences of what is confused."""
    single = cands.where(F.size("ops") == 1).select(F.col("ops")[0].alias("op"), "n", "form", "n_candidate")
    best = single.groupBy("form").agg(F.max_by(F.struct("op", "n"), "n_candidate").alias("b")).select("b.op", "b.n")
    hits = best.groupBy("op").agg(F.sum("n").alias("n"))
    letters = uni.select(F.explode(F.split("form", "")).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("of"))
    return hits.withColumn("c", F.lower(F.substring_index("op", ">", 1).substr(1, 1))).join(letters, "c", "left").select("op", F.least(F.greatest(F.col("n") / F.coalesce("of", F.lit(1e6)), F.lit(1e-6)), F.lit(0.05)).alias("p"))


def scored(cands: DataFrame, ops: DataFrame) -> DataFrame:
    """Candidates with ``lp``, the log probability of the confusions they take."""
    each = cands.select("form", "candidate", F.explode("ops").alias("op")).join(ops, "op", "left")
    lp = each.groupBy("form", "candidate").agg(F.sum(F.log(F.coalesce("p", F.lit(1e-6)))).alias("lp"))
    return cands.join(lp, ["form", "candidate"]).select("form", "n", "candidate", "n_candidate", "lp")


# decisions


def breaks(seq: DataFrame, uni: DataFrame) -> DataFrame:
    """Words before a break, at a line end or inside a line: ``doc_id, page, ord, kind, joined``."""
    joins = seq.where(F.col("next").isNotNull() & (F.length("word") > 0) & ((F.col("mark") != "") | F.expr("text rlike '[\\\\w]$'")))
    a, b = F.lower("word"), F.lower("next.word")
    joins = joins.select("doc_id", "page", "ord", "text", "word", "mark", "ends", "next", a.alias("a"), b.alias("b"), F.concat(a, b).alias("ab"), F.concat(a, F.lit("-"), b).alias("a_b"))

    def count(df: DataFrame, key: str) -> DataFrame:
        return df.join(uni.select(F.col("form").alias(key), F.col("n").alias(f"n_{key}")), key, "left").fillna(0, [f"n_{key}"])

    pairs = joins.groupBy("a", "b", "ab", "a_b").agg(F.count("*").alias("n_all"), F.sum((F.col("mark") == "").cast("int")).alias("n_pair"))
    for key in ("a", "b", "ab", "a_b"):
        pairs = count(pairs, key)
    # a mark at a line end is a break, unless what follows is a usual word and neither spelling of the whole is attested
    usual = F.when(F.col("mark").isin("–", "—"), DASHED).otherwise(HYPHENED)
    marked = (F.col("mark") != "") & ((F.col("n_ab") > 1) | (F.col("n_a_b") > 1) | (F.col("n_b") < 2) | (F.col("n_b") <= F.col("n_all")) | (F.col("n_b") < usual * F.col("total")))
    torn = (F.col("mark") == "") & ~F.col("next.text").rlike("[" + re.escape(BREAKS) + "]$") & (F.least("n_a", "n_b") * 20 < F.col("n_ab")) & (F.col("n_pair") * 3 < F.col("n_ab") + 3)
    kind = F.when(marked, "hyphen").when(torn & F.col("ends"), "hyphen").when(torn, "misread")
    pairs = pairs.crossJoin(F.broadcast(uni.agg(F.sum("n").alias("total"))))
    got = joins.join(pairs, ["a", "b", "ab", "a_b"]).withColumn("kind", kind).where("kind is not null")
    compound = (F.col("mark") != "") & (F.col("n_ab") < 2) & (F.col("n_a_b") > 1)
    return got.select("doc_id", "page", "ord", "kind", F.when(compound, F.concat("word", F.lit("-"), "next.text")).otherwise(F.concat("word", "next.text")).alias("joined"), F.col("next.ord").alias("next_ord"))


#: From this length on the parts of a form are looked up by this many letters at its ends, instead of cutting it everywhere.
_LONG_FORM = 60


def run_together(seq: DataFrame, uni: DataFrame, bi: DataFrame) -> DataFrame:
    """``(form, parts)``: forms that are two words written as one, told by the bigram they would make.

    The bigram is attested and more frequent than the form; or it is hardly attested, and then both words must be long and
    the form no more frequent than chance makes of such a bigram. Both words are far more frequent than the form.
    """
    forms = seq.where(F.length("word") > 3).groupBy(F.lower("word").alias("form")).agg(F.count("*").alias("n"))
    cut = forms.where(F.length("form") < _LONG_FORM).select("form", "n", F.explode(F.sequence(F.lit(1), F.length("form") - 1)).alias("k"))
    # of a very long form one part has half its letters: such words meet it by its first or last letters
    half = _LONG_FORM // 2
    long_forms, long_words = forms.where(F.length("form") >= _LONG_FORM), uni.where(F.length("form") >= half).select(F.col("form").alias("word"))
    head = long_forms.withColumn("end", F.substring("form", 1, half)).join(long_words.withColumn("end", F.substring("word", 1, half)), "end").where(F.startswith("form", "word") & (F.length("word") < F.length("form"))).select("form", "n", F.length("word").alias("k"))
    tail = long_forms.withColumn("end", F.expr(f"right(form, {half})")).join(long_words.withColumn("end", F.expr(f"right(word, {half})")), "end").where(F.endswith("form", "word") & (F.length("word") < F.length("form"))).select("form", "n", (F.length("form") - F.length("word")).alias("k"))
    cut = cut.unionByName(head).unionByName(tail).distinct().select("form", "n", F.expr("substring(form, 1, k)").alias("a"), F.expr("substring(form, k + 1)").alias("b"))
    solid = cut.join(uni.select(F.col("form").alias("a"), F.col("n").alias("n_a")), "a").join(uni.select(F.col("form").alias("b"), F.col("n").alias("n_b")), "b")
    solid = solid.where(F.least("n_a", "n_b") > 10 * F.col("n")).join(bi.withColumnRenamed("n", "n_bi"), ["a", "b"], "left").fillna(0, ["n_bi"])
    attested = (F.col("n_bi") > 1) & (F.col("n_bi") > 2 * F.col("n"))
    long = (F.length("a") > 3) & (F.length("b") > 3) & (F.col("n") < F.col("n_bi") + 3)
    solid = solid.where(attested | (long & (F.least("n_a", "n_b") > F.when(F.col("n_bi") > 1, 10 * F.col("n")).otherwise(30 * F.col("n")))))
    return solid.groupBy("form").agg(F.max_by(F.concat_ws(" ", "a", "b"), F.struct("n_bi", "a")).alias("parts"))


def _misread_figures(word):
    """Numbers and codes with letters in place of figures."""
    w = F.col(word)
    return (w.rlike(r"^[0-9][0-9OolI]*[OolI][0-9OolI]*$") & w.rlike("[0-9]") & ~w.rlike(r"^[0-9]+[oO]$")) | w.rlike(r"^[A-Z](?=[0-9]*[OolI])[0-9OolI]*[0-9][0-9OolI]*$") | w.rlike(r"^[A-Z][OolI]*[0-9]+[OolI]+$")


def decode(seq: DataFrame, uni: DataFrame, bi: DataFrame, cands: DataFrame) -> DataFrame:
    """``doc_id, page, ord, corrected``: words that Viterbi reads otherwise than they are seen.

    Only lines with a candidate are decoded. The bigrams a line can need are joined to it, so no table is broadcast.
    """
    total = uni.agg(F.sum("n").alias("total"))
    # what the channel makes of more frequent words is no evidence for a form
    expected = cands.groupBy("form").agg(F.sum(F.col("n_candidate") * F.exp("lp")).alias("expected"), F.max("n").alias("n_form"))
    listed = cands.groupBy("form").agg(F.array_sort(F.collect_list(F.struct((-F.log("n_candidate") - F.col("lp")).alias("cost"), "candidate", "n_candidate", "lp"))).alias("c")).join(expected, "form")
    ws = seq.where(F.length("word") > 0).select("doc_id", "page", "line", "at", "ord", "word", F.lower("word").alias("low"), F.lower("before.word").alias("prev"), F.lower("next.word").alias("nxt"))
    ws = ws.join(listed, ws["word"] == listed["form"], "left").drop("form")
    line = ws.groupBy("doc_id", "page", "line").agg(F.array_sort(F.collect_list(F.struct("at", "ord", "word", "low", "c", "expected", "n_form"))).alias("w"), F.max(F.col("c").isNotNull()).alias("any"), F.min_by("prev", "at").alias("prev"), F.max_by("nxt", "at").alias("nxt"))
    todo = stored(line.where("any").drop("any"), "scans-lines")
    needed = todo.mapInArrow(_needed, "doc_id bigint, page int, line int, a string, b string")
    near = needed.join(bi, ["a", "b"]).groupBy("doc_id", "page", "line").agg(F.collect_list(F.struct("a", "b", "n")).alias("bi"))
    lows = todo.select("doc_id", "page", "line", F.explode("w.low").alias("form")).distinct().join(uni, "form").groupBy("doc_id", "page", "line").agg(F.collect_list(F.struct("form", "n")).alias("uni"))
    every = todo.join(near, ["doc_id", "page", "line"], "left").join(lows, ["doc_id", "page", "line"], "left").crossJoin(F.broadcast(total))
    return every.select("doc_id", "page", "w", "prev", "nxt", "bi", "uni", "total").mapInArrow(_viterbi, "doc_id bigint, page int, ord int, corrected string")


def _options(w: dict) -> list[str]:
    return [w["low"], *(c["candidate"] for c in w["c"] or [])]


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[] for _ in range(5)]
        for doc, page, line, words, prev, nxt in zip(*(b.column(k).to_pylist() for k in ("doc_id", "page", "line", "w", "prev", "nxt")), strict=True):
            states = [[prev], *(_options(w) for w in words), [nxt]]
            for left, right in zip(states, states[1:], strict=False):
                if len(left) > 1 or len(right) > 1:
                    for x in left:
                        for y in right:
                            if x and y:
                                for col, v in zip(cols, (doc, page, line, x, y), strict=True):
                                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["doc_id", "page", "line", "a", "b"])


def _viterbi(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, page, words, prev, nxt, bi, uni, total in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
            pair = {(x["a"], x["b"]): x["n"] for x in bi or []}
            count = {x["form"]: float(x["n"]) for x in uni or []}
            shadow = set()
            for w in words:
                if w["c"]:
                    for c in w["c"]:
                        count[c["candidate"]] = float(c["n_candidate"])
            for w in words:
                # far rarer than a word the channel turns into it: its count is the channel's work, not a word's
                if w["c"] and w["n_form"] <= max(4 * w["expected"] + 1, SHADOW * max(c["n_candidate"] for c in w["c"])):
                    count[w["low"]] = min(count.get(w["low"], 0.0), 0.02)
                    shadow.add(w["low"])

            def likely(a: str | None, x: str) -> float:
                alone = (count.get(x, 0.0) + 0.01) / total  # noqa: B023
                if not a or a not in count or a in shadow:  # noqa: B023
                    return math.log(alone)
                seen = 0 if x in shadow else pair.get((a, x), 0)  # noqa: B023
                return math.log(0.3 * alone + 0.7 * seen / (count[a] + 1))  # noqa: B023

            states: list[dict[str, tuple[float, str | None]]] = [{prev or "": (0.0, None)}]
            for w in words:
                cost = {w["low"]: 0.0} | {c["candidate"]: c["lp"] for c in w["c"] or []}
                now = {}
                for x, lp in cost.items():
                    best, back = max(((s + likely(a, x), a) for a, (s, _) in states[-1].items()), key=lambda t: t[0])
                    now[x] = (best + lp, back)
                states.append(now)
            ends = {x: s + (likely(x, nxt) if nxt and (nxt in count or (x, nxt) in pair) else 0.0) for x, (s, _) in states[-1].items()}
            at = max(ends, key=lambda x: ends[x])
            for k in range(len(words), 0, -1):
                if at != words[k - 1]["low"]:
                    rows.append((doc, page, words[k - 1]["ord"], at))
                at = states[k][at][1]
        cols = list(zip(*rows, strict=True)) or [[] for _ in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["doc_id", "page", "ord", "corrected"])


def analyse(words: DataFrame) -> dict[str, DataFrame]:
    """The written tables of all decisions: tokens, breaks, corrected words and words run together."""
    t = stored(tokens(words), "scans-tokens")
    body = t.where("kind is null").drop("kind")
    seq = stored(follow(body), "scans-sequence")
    uni = stored(unigrams(seq), "scans-unigrams")
    bi = stored(bigrams(seq), "scans-bigrams")
    broken = stored(breaks(seq, uni), "scans-breaks")
    parts = broken.select("doc_id", "page", "ord").unionByName(broken.select("doc_id", "page", F.col("next_ord").alias("ord")))
    alone = seq.where(F.coalesce(F.col("before.mark"), F.lit("")) == "").where("mark = ''").join(parts, ["doc_id", "page", "ord"], "left_anti")
    cands = stored(candidates(alone, uni), "scans-candidates")
    good = stored(scored(cands, channel(cands, uni)), "scans-scored")
    fixed = stored(decode(alone, uni, bi, good), "scans-decoded")
    together = run_together(alone, uni, bi)
    return {"tokens": t, "seq": seq, "alone": alone, "breaks": broken, "fixed": fixed, "together": stored(together, "scans-together")}


def found(words: DataFrame) -> DataFrame:
    """``doc_id, page, ord, kind`` of every word that is not plain body text as it should read."""
    a = analyse(words)
    joined = a["alone"].join(a["together"], F.lower("word") == F.col("form"), "left_semi").select("doc_id", "page", "ord", F.lit("misread").alias("kind"))
    parts = [
        a["tokens"].where("kind is not null").select("doc_id", "page", "ord", "kind"),
        a["breaks"].select("doc_id", "page", "ord", "kind"),
        a["fixed"].select("doc_id", "page", "ord", F.lit("misread").alias("kind")),
        joined,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _last_before(pages_at: DataFrame) -> DataFrame:
    """``doc_id, page, before``: the last paragraph begun on an earlier page, for ``doc_id, page, at``.

    Joins with the page before, and where that has none with the page it points on to; the pointers double their reach
    each round, so no task sees all pages of a file.
    """
    now = stored(pages_at.select("doc_id", "page", "at", F.lit(1).alias("hop")), "scans-begun")
    for _ in range(20):
        if now.where("at is null").isEmpty():
            break
        there = now.select(F.col("doc_id").alias("d"), F.col("page").alias("q"), F.col("at").alias("at2"), F.col("hop").alias("hop2"))
        step = now.join(there, (F.col("doc_id") == F.col("d")) & (F.col("page") - F.col("hop") == F.col("q")) & F.col("at").isNull(), "left").select("doc_id", "page", F.coalesce("at", "at2").alias("at"), F.when(F.col("at").isNull() & F.col("hop2").isNotNull(), F.col("hop") + F.col("hop2")).otherwise(F.col("hop")).alias("hop"), (F.col("at").isNull() & F.col("q").isNotNull()).alias("moved"))
        step = stored(step, "scans-begun")
        if step.where("moved").isEmpty():
            break
        now = step.drop("moved")
    return now.select("doc_id", (F.col("page") + 1).alias("page"), F.col("at").alias("before")).where("before is not null")


def paragraphs(words: DataFrame) -> DataFrame:
    """``doc_id, page, line, text``: continuous paragraphs, each with the place where it begins.

    A paragraph begins after a line that ends early with a full stop. Pages are put together first; what a page continues
    goes to the last paragraph begun before it, found by following pages backwards.
    """
    from pyspark.sql import Window

    a = analyse(words)
    key = ["doc_id", "page", "ord"]
    fixed = a["fixed"].select(*key, "corrected")
    seq = a["seq"].join(fixed, key, "left").join(a["together"].withColumnRenamed("form", "low"), F.lower("word") == F.col("low"), "left").join(a["breaks"].select(*key, "joined", "kind"), key, "left")
    skipped = a["breaks"].select("doc_id", F.when(F.col("next_ord") < F.col("ord"), F.col("page") + 1).otherwise(F.col("page")).alias("page"), F.col("next_ord").alias("ord")).withColumn("skip", F.lit(True))
    seq = seq.join(skipped, key, "left")
    right = F.coalesce("corrected", "parts")
    # a capital stays where it is the same letter: a misread one says nothing about case
    capital = (F.lower(F.substring("word", 1, 1)) == F.substring(right, 1, 1)) & (F.lower(F.substring("word", 1, 1)) != F.substring("word", 1, 1))
    as_seen = F.when((F.length("word") > 1) & (F.upper("word") == F.col("word")) & F.col("word").rlike(r"\p{Lu}{2}"), F.upper(right)).when(capital, F.concat(F.upper(F.substring(right, 1, 1)), F.expr("substring(coalesce(corrected, parts), 2)"))).otherwise(right)
    shown = F.when(F.col("skip"), F.lit(None).cast("string")).when(F.col("joined").isNotNull(), F.col("joined")).when(right.isNotNull(), F.replace(F.col("text"), F.col("word"), as_seen)).otherwise(F.col("text"))
    edge = seq.groupBy("doc_id", "page").agg(F.max("x1").alias("edge"))
    seq = seq.join(edge, ["doc_id", "page"]).withColumn("shown", shown).withColumn("closes", F.col("ends") & F.col("text").rlike("[.!?:]$") & (F.col("x1") < 0.85 * F.col("edge")))
    w = Window.partitionBy("doc_id", "page").orderBy("at")
    seq = seq.withColumn("new", F.lag("closes", 1, False).over(w) | ((F.col("at") == 0) & F.coalesce(F.col("before.text").rlike("[.!?:]$"), F.lit(True)))).withColumn("part", F.sum(F.col("new").cast("int")).over(w))
    pieces = seq.groupBy("doc_id", "page", "part").agg(F.min("line").alias("line"), F.array_join(F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("at", "shown"))), lambda x: x["shown"])), " ").alias("t"), F.max("new").alias("starts"))
    pieces = stored(pieces, "scans-pieces")
    last = pieces.groupBy("doc_id", "page").agg(F.max(F.when(F.col("starts"), F.struct("page", "line"))).alias("at"))
    before = _last_before(last)
    inside = Window.partitionBy("doc_id", "page").orderBy("part")
    begun = pieces.withColumn("at", F.last(F.when(F.col("starts"), F.struct("page", "line")), ignorenulls=True).over(inside))
    begun = begun.join(before, ["doc_id", "page"], "left").withColumn("at", F.coalesce("at", "before", F.struct("page", "line")))
    return begun.groupBy("doc_id", F.col("at.page").alias("page"), F.col("at.line").alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("page").alias("p"), F.col("part").alias("q"), "t"))), lambda x: x["t"]), " ").alias("text"))
