"""Problem 2: text that looks the same but differs in its characters.

Method: the vocabulary of the corpus (usual spellings with their counts) is put into tries, and every unusual token is
run through them by a weighted edit automaton in which look-alikes, composition and ignorable characters cost nothing,
letters that nearly look alike (``NEAR``) cost less than the limit and everything else more. Of the spellings that are
reached the cheapest, and of these the best attested one in the script of the line, is canonical. Tokens that reach none,
and what stands between words, are normalised by table.

The tries are sharded by a hash of the whole look-alike skeleton, which affordable edits never change, so vocabulary and
tokens meet in the same task, no prefix is a hot group, and no vocabulary is broadcast or collected. Only distinct tokens
are compared.

Defined results: null and empty text is its own consistent form; control characters are kept; repeated rows count once;
an empty table gives no rows. Marks that change what is seen (raised digits, fractions, typographic quotes and dashes)
are left alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .units import UNIT

# Letters of other scripts that look like ASCII letters.
_LIKE = {
    "a": "аαɑ", "b": "ЬƄ", "c": "сϲᴄ", "d": "ԁ", "e": "еҽ", "g": "ɡց", "h": "һ", "i": "іɩι", "j": "јϳ", "k": "κ", "l": "ӏⅼ", "n": "ո",
    "o": "оοօσ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝωᴡ", "x": "хχ", "y": "уγ", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "D": "Ꭰ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "L": "Ꮮ", "M": "МΜ",
    "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "УΥҮ", "Z": "Ζ",
}
#: Not exchanged for each other: they differ to the eye, though an old table may pair them.
_NOT_LIKE = frozenset("гσωЬ")
TO_LATIN = {c: k for k, v in _LIKE.items() for c in v if c not in _NOT_LIKE}
TO_CYRILLIC = {k: c for k, v in _LIKE.items() for c in v if "а" <= c <= "я" or "А" <= c <= "Я" if c not in _NOT_LIKE}
TO_GREEK = {k: c for k, v in _LIKE.items() for c in v if "α" <= c <= "ω" or "Α" <= c <= "Ω" if c not in _NOT_LIKE}

IGNORABLE = "­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿"
BLANKS = "   -   　"
_IGNORED = re.compile(f"[{IGNORABLE}]")
_BLANK = re.compile(f"[{BLANKS}]")
#: Where joiners and selectors do show something: between letters of joining scripts, and after signs.
_JOINED = re.compile("[؀-ࣿऀ-෿က-႟ក-៿᠀-᢯←-⯿\U0001f000-\U0001faff][‌‍︎️]")
#: Signs drawn like plain letters: wide and narrow forms, mathematical alphabets, ligatures, numeral letters.
_PLAIN_TAGS = ("<font>", "<wide>", "<narrow>", "<noBreak>")
_LIGATURES = frozenset(map(chr, (*range(0xFB00, 0xFB07), *range(0x2160, 0x2180), 0x132, 0x133, 0x1C4, 0x1C5, 0x1C6, 0x1C7, 0x1C8, 0x1C9, 0x1CA, 0x1CB, 0x1CC, 0x1F1, 0x1F2, 0x1F3)))
_EAST_ASIAN = re.compile("[぀-ヿ㐀-鿿가-힯]")
#: Distinct tokens in one shard of tries, about.
SHARD_TOKENS = 2000
#: Letters that nearly look alike, by one of them; an edit between them costs ``NEAR_COST``, and ``LIMIT`` is what a token can pay.
NEAR = {"O": "o", "I": "l", "ı": "i"}
NEAR_COST, OTHER_COST, LIMIT = 0.4, 1.0, 0.5
_MARKS = "\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff"


class Memo(dict):
    """A function of one character, remembered. (Plain dict: the cache of functools can't be sent to workers.)"""

    def __init__(self, f) -> None:
        super().__init__()
        self.f = f

    def __missing__(self, c: str):
        self[c] = x = self.f(c)
        return x

    def __reduce__(self):
        return Memo, (self.f,)


def _plain(c: str) -> str:
    d = unicodedata.decomposition(c)
    return unicodedata.normalize("NFKC", c) if d.startswith(_PLAIN_TAGS) or c in _LIGATURES else c


#: What a sign drawn like plain letters stands for, else the sign.
PLAIN = Memo(_plain)
_SCRIPT = Memo(lambda c: "" if not c.isalpha() else "LATIN" if c < "\x80" else unicodedata.name(c, "").partition(" ")[0])


def script_of(c: str) -> str:
    return _SCRIPT[c]


def by_table(token: str) -> str:
    """Blanks, ignorables, drawn-alike signs and composition; letters of another script stay."""
    wide = bool(_EAST_ASIAN.search(token))
    t = token if _JOINED.search(token) else _IGNORED.sub("", token)
    t = _BLANK.sub(" ", t)
    if not t.isascii():
        t = "".join(c if wide and "＀" <= c <= "￯" else PLAIN[c] for c in t)
        t = unicodedata.normalize("NFC", t)
    return t


def main_script(scripts: dict[str, int]) -> str:
    return max(scripts, key=lambda s: (scripts[s], s)) if scripts else ""


def drawn(word: str) -> str:
    """The letters and marks that a word is drawn with, one for one: signs drawn like letters as these, accents apart, ignorables out."""
    return unicodedata.normalize("NFD", "".join(PLAIN[c] for c in word if not _IGNORED.match(c)))


def shape(word: str) -> str:
    """What all spellings that an affordable edit can lead to have in common."""
    return "".join(NEAR.get(x := TO_LATIN.get(c, c), x) for c in drawn(word))


class Trie:
    """Usual spellings, with an automaton that follows a token at a given cost for each kind of edit."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, n: int) -> None:
        node = self.root
        for c in drawn(word):
            node = node.setdefault(c, {})
        here = node.setdefault("", {})
        here[word] = here.get(word, 0) + n

    def reach(self, token: str, limit: float = LIMIT, other: float = OTHER_COST) -> list[tuple[float, str, int]]:
        """(cost, spelling, count) of all spellings within the limit, the cheapest way to each."""
        token = unicodedata.normalize("NFD", "".join(PLAIN[c] for c in token))
        best: dict[tuple[int, int], float] = {}
        found: dict[str, tuple[float, str, int]] = {}
        todo = [(0, 0.0, self.root)]
        while todo:
            i, cost, node = todo.pop()
            if best.get((i, id(node)), 9e9) <= cost:
                continue
            best[i, id(node)] = cost
            if i == len(token):
                for spelling, n in node.get("", {}).items():
                    if spelling not in found or found[spelling][0] > cost:
                        found[spelling] = cost, spelling, n
            for c, below in node.items():
                if c:
                    if i < len(token) and (k := cost + swap_cost(token[i], c, other)) <= limit:
                        todo.append((i + 1, k, below))
                    if cost + other <= limit:
                        todo.append((i, cost + other, below))
            if i < len(token):
                k = cost + (0.0 if _IGNORED.match(token[i]) else other)
                if k <= limit:
                    todo.append((i + 1, k, node))
        return sorted(found.values())


def swap_cost(a: str, b: str, other: float = OTHER_COST) -> float:
    """What it costs to read one drawn letter as another."""
    a, b = TO_LATIN.get(a, a), TO_LATIN.get(b, b)
    return 0.0 if a == b else NEAR_COST if NEAR.get(a, a) == NEAR.get(b, b) else other


_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
#: A word as it stands in the text: with what shows nothing, and with accents apart.
_LETTER = rf"[^\W\d_][{_MARKS}{IGNORABLE}]*"
_RAW_WORD = re.compile(rf"(?:{_LETTER})+(?:[-'’](?:{_LETTER})+)*")


def unusual(text):
    """Whether a text needs a look at all: ASCII text is its own consistent form."""
    return text.rlike(r"[^\x00-\x7F]")


def pieces(token: str) -> list[tuple[int, int, str]]:
    """Words in a token, by position."""
    return [(m.start(), m.end(), m[0]) for m in _WORD.finditer(token)]


_ASCII_WORDS = r"(?i)[a-z]{1,}(?:['-][a-z]+)*"


def vocabulary(units: DataFrame) -> DataFrame:
    """``(word, n)``: words of one script in the usual characters, over all text."""
    ascii_words = units.select(F.explode(F.regexp_extract_all(F.regexp_replace("text", r"[^\x00-\x7F]+", "¦"), F.lit(r"(?<![¦A-Za-z'-])([A-Za-z]+(?:['-][A-Za-z]+)*)(?![¦A-Za-z'-])"), 1)).alias("word"))
    counted = ascii_words.groupBy("word").agg(F.count("*").alias("n"))
    others = units.where(unusual(F.col("text"))).select("text").mapInArrow(_usual_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.unionByName(others)


def _usual_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n: dict[str, int] = {}
        for text in b.column(0).to_pylist():
            for _, _, w in pieces(text):
                if not w.isascii() and by_table(w) == w and len({script_of(c) for c in w} - {""}) == 1:
                    n[w] = n.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])


def _sure_script(word: str) -> str:
    """The script of a word with a letter that looks like none of another script, else nothing."""
    scripts = {script_of(c) for c in word} - {""}
    return scripts.pop() if len(scripts) == 1 and any(c not in TO_LATIN and not (c.isascii() and (c in TO_CYRILLIC or c in TO_GREEK)) for c in word) else ""


def _line_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unusual lines to (UNIT, text, suspects): the words that are spelt with anything unusual, or that look-alikes may be in."""
    word = pa.struct([("word", pa.string()), ("script", pa.string()), ("shape", pa.string())])
    for b in batches:
        suspects = []
        for t in b.column(len(UNIT)).to_pylist():
            raw = [m[0] for m in _RAW_WORD.finditer(t)]
            words = [by_table(w) for w in raw]
            scripts: dict[str, int] = {}
            for w in words:
                for c in w:
                    if s := script_of(c):
                        scripts[s] = scripts.get(s, 0) + 1
            line = main_script(scripts)
            foreign = len(scripts) > 1 or any(c in TO_LATIN and script_of(c) == "LATIN" for w in words for c in w)
            home = [_sure_script(w) for w in words] if foreign else []
            own = {}
            for k, (r, w) in enumerate(zip(raw, words, strict=True)):
                if r in own:
                    continue
                take = r != w
                if foreign and not take and any(c in TO_LATIN or c.isascii() for c in w):
                    mine = {script_of(c) for c in w} - {""}
                    odd = any(c in TO_LATIN and script_of(c) == "LATIN" for c in w)
                    # a word of one script is at home beside an unmistakable word of its script, whatever most of the line is
                    beside = len(mine) == 1 and (home[max(0, k - 1)] in mine or home[min(k + 1, len(words) - 1)] in mine)
                    # one letter at the end of a line begins a sentence that goes on in the next: nothing tells its script
                    beside |= len(w) == 1 and k == len(words) - 1
                    take = odd or len(mine) > 1 or (line not in mine and not beside)
                if take:
                    own[r] = {"word": r, "script": line, "shape": shape(r)}
            suspects.append(list(own.values()))
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(UNIT) + 1)), pa.array(suspects, pa.list_(word))], names=[*UNIT, "text", "suspects"])


_TO = {"LATIN": lambda w: "".join(TO_LATIN.get(c, c) for c in w), "CYRILLIC": lambda w: "".join(TO_CYRILLIC.get(TO_LATIN.get(c, c), c) for c in w), "GREEK": lambda w: "".join(TO_GREEK.get(TO_LATIN.get(c, c), c) for c in w)}


def choose(raw: str, script: str, reached: list[tuple[float, str, int]]) -> str:
    """The canonical spelling of a word in a line of that script, given the usual spellings (cost, spelling, count) that it reaches."""
    word = by_table(raw)
    mine = {script_of(c) for c in word} - {""}
    usual = {w: n for cost, w, n in reached if cost == 0}
    if word != raw and word in usual and len(mine) == 1:
        return word
    other = {w: n for w, n in usual.items() if w != word}
    if len(mine) == 1 and "ɡ" not in word and "ɑ" not in word:
        # a word of one script in a line of another: at home unless its look-alike is usual in the line's script
        there = {w: n for w, n in other.items() if {script_of(c) for c in w} - {""} == {script}}
        if script not in mine and there:
            best = max(there, key=lambda w: (there[w], w))
            if len(word) == 1 or there[best] > usual.get(word, 0):
                return best
        return word
    if other:
        return max(other, key=lambda w: (other[w], w))
    # letters of two scripts, and no spelling for nothing: the cheapest that it can pay
    paid = [(cost, -n, w) for cost, w, n in reached if cost > 0]
    if paid:
        return min(paid)[2]
    # reached no spelling: the script that most of its unmistakable letters have
    sure: dict[str, int] = {}
    for c in word:
        if (s := script_of(c)) and not (c in TO_LATIN or (s == "LATIN" and (c in TO_CYRILLIC or c in TO_GREEK))):
            sure[s] = sure.get(s, 0) + 1
    target = main_script(sure) or script
    return unicodedata.normalize("NFC", _TO.get(target, _TO["LATIN"])(unicodedata.normalize("NFD", word)))


def _shard_match(key: tuple, suspects: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    if suspects.empty:
        return pd.DataFrame({"word": [], "script": [], "canonical": []})
    trie = Trie()
    for w, n in zip(words["word"], words["n"], strict=True):
        trie.add(w, int(n))
    out = [choose(w, s, trie.reach(w)) for w, s in zip(suspects["word"], suspects["script"], strict=True)]
    return pd.DataFrame({"word": suspects["word"], "script": suspects["script"], "canonical": out})


def _canonical(prepared: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(word, script, canonical)`` for every distinct suspect."""
    suspects = stored(prepared.select(F.inline("suspects")).distinct(), "lookalikes-suspects")
    shards = max(1, -(-suspects.count() // SHARD_TOKENS))
    shard = F.pmod(F.xxhash64("shape"), F.lit(shards)).alias("shard")
    # only words that some suspect could reach go into the tries
    shape_of = F.pandas_udf(lambda w: w.map(shape), T.StringType())
    near = "".join(c for c in NEAR if c.isascii())
    words = vocab.withColumn("shape", F.when(F.col("word").rlike(r"[^\x00-\x7F]"), shape_of("word")).otherwise(F.translate("word", near, "".join(NEAR[c] for c in near))))
    words = words.join(suspects.select("shape").distinct().hint("merge"), "shape", "left_semi").select("word", "n", shard)
    suspects = suspects.select("word", "script", shard)
    return suspects.groupBy("shard").cogroup(words.groupBy("shard")).applyInPandas(_shard_match, "word string, script string, canonical string")


def consistent(units: DataFrame) -> DataFrame:
    """``UNIT, text, consistent`` for every text whose consistent form differs from it."""
    lines = units.where(unusual(F.col("text")))
    prepared = lines.select(*UNIT, "text").mapInArrow(
        _line_words,
        "src string, doc_id bigint, page int, line int, name string, text string, suspects array<struct<word:string,script:string,shape:string>>",
    )
    prepared = stored(prepared, "lookalikes-lines")
    canon = _canonical(prepared, vocabulary(units)).where("canonical <> word")
    hits = prepared.select(*UNIT, F.inline("suspects")).join(canon.hint("merge"), ["word", "script"]).groupBy(*UNIT).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("word", "canonical")))).alias("swap"))
    joined = prepared.select(*UNIT, "text").join(hits.hint("merge"), list(UNIT), "left")
    return joined.mapInArrow(_swap, "src string, doc_id bigint, page int, line int, name string, text string, consistent string")


def _swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their words in canonical spelling and all else by table, where that changes them."""
    k = len(UNIT)
    for b in batches:
        keep, out = [], []
        for i, (text, swap) in enumerate(zip(b.column(k).to_pylist(), b.column(k + 1).to_pylist(), strict=True)):
            swap = dict(swap or ())
            now = by_table(_RAW_WORD.sub(lambda m: swap.get(m[0], m[0]), text))  # noqa: B023
            if now != text:
                keep.append(i)
                out.append(now)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(j).take(at) for j in range(k + 1)), pa.array(out, pa.string())], names=[*UNIT, "text", "consistent"])
