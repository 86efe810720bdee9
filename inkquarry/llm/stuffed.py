"""Problem 8: pages of repeated keywords, links, tags and word lists instead of sentences.

Method: the rank-frequency curve of every page, fitted with SQL windows (log frequency over log rank: slope and
residual), and the divergence of its words from prose of the same language. What is usual at a length is learnt from all
distinct texts (``usual``); a page whose slope, residual or divergence is extreme for its length is flagged, all others
are cleared. On the flagged texts an exact check follows: the share of the text whose lines are keywords, tags, links or
lists.

What is usual must not be what a hot group of pages is: every distinct text has one vote, and a length is held against
the lengths around it, so near-copies of one page, which have one length, are outvoted (``usual``).

The words of a page are counted where the page is read, so only its frequency spectrum (how many words occur how often)
is shuffled. Reference words are computed over all distinct texts, one vote for each text and language, so copies of a
page don't make its keywords common; their table has a proven bound (``LANGUAGES`` x ``TOP`` words). Pages in a language
that is not among the ``LANGUAGES`` largest are held against the one they diverge least from, as all pages are.

Defined results: null, empty and wordless pages are never found; the language label is only a hint, a page is held
against the language it diverges least from; repeated rows and copies of a text count once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .leaks import plain_words

TOP, LANGUAGES = 50, 40
SHARE = 0.5
#: What is extreme, in median deviations from the usual at that length: slope to either side, residual and divergence above.
EXTREME = {"slope": 2.5, "residual": 3.0, "divergence": 1.25}
#: A text is cleared only as far as the usual is known: so many standard errors of the median of its length are taken off
#: what is extreme. 1.86 median deviations over the root of their number is that error for a normal distribution.
DOUBT = 3 * 1.86
#: Lengths (powers of two) on each side that a length is held against.
AROUND = 2
_SALTS = 64


def language(label):
    """First part of a language label, lower case; labels of other forms count as unknown."""
    code = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.when(code.rlike("^[a-z]{2}([_-].*)?$"), F.substring(code, 1, 2)).otherwise("und")


def _digest(text: str):
    return F.sha2(F.col(text), 256)


def distinct_texts(documents: DataFrame) -> DataFrame:
    """``(digest, langs, text)``: every text once, with the languages it is labelled with."""
    docs = documents.where(F.col("text").isNotNull()).select(_digest("text").alias("digest"), language(F.col("lang")).alias("lang"), "text")
    return stored(docs.groupBy("digest").agg(F.sort_array(F.collect_set("lang")).alias("langs"), F.first("text").alias("text")), "stuffed-texts")


def reference(texts: DataFrame) -> DataFrame:
    """``(lang, word, share)``: the commonest words of each language with their share of all words of its distinct texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = plain_words(b.column(1), markup=True)
            flat = words.flatten().dictionary_encode()
            langs = b.column(0).dictionary_encode()
            of = np.repeat(np.asarray(langs.indices), np.asarray(pc.list_value_length(words)))
            v = max(1, len(flat.dictionary))
            key, n = np.unique(of.astype(np.int64) * v + np.asarray(flat.indices), return_counts=True)
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(key // v)), flat.dictionary.take(pa.array(key % v)), pa.array(n)], names=["lang", "word", "n"])

    counts = texts.select(F.explode("langs").alias("lang"), "text").mapInArrow(count, "lang string, word string, n bigint").where("word <> ''").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # the top of each part of a language first, then of the language: no task sees a whole vocabulary
    counts = stored(counts, "stuffed-counts")
    part = Window.partitionBy("lang", "salt").orderBy(F.desc("n"), "word")
    whole = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counts.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(_SALTS))).withColumn("k", F.row_number().over(part)).where(F.col("k") <= TOP)
    top = top.withColumn("k", F.row_number().over(whole)).where(F.col("k") <= TOP)
    largest = counts.where("lang <> 'und'").groupBy("lang").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "lang").limit(LANGUAGES)
    return top.join(F.broadcast(largest), "lang").select("lang", "word", (F.col("n") / F.col("total")).alias("share"))


def spectra(texts: DataFrame, ref: list[tuple[str, str, float]]) -> DataFrame:
    """``(digest, n_words, divergence, freq, words)``: frequency spectrum and divergence of every distinct text."""
    langs = sorted({r[0] for r in ref})
    tables = []
    for lang in langs:
        mine = [(w, s) for x, w, s in ref if x == lang]
        q = np.array([s for _, s in mine] + [max(1e-4, 1 - sum(s for _, s in mine))])
        tables.append((pa.array([w for w, _ in mine], pa.string()), q))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = plain_words(b.column(1), markup=True)
            flat = words.flatten()
            doc = np.repeat(np.arange(b.num_rows), np.asarray(pc.list_value_length(words)))
            coded = flat.dictionary_encode()
            real = np.asarray(pc.not_equal(coded.dictionary, "")) if len(coded.dictionary) else np.zeros(0, bool)
            code = np.asarray(coded.indices)
            keep = real[code] if len(code) else np.zeros(0, bool)
            doc, code = doc[keep], code[keep]
            n = np.bincount(doc, minlength=b.num_rows)
            best = np.full(b.num_rows, np.inf)
            for vocab, q in tables:
                at = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, vocab), len(vocab)))[code] if len(code) else code
                p = np.bincount(doc * len(q) + at, minlength=b.num_rows * len(q)).reshape(-1, len(q)) / np.maximum(n, 1)[:, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    best = np.minimum(best, np.where(p > 0, p * np.log(p / q), 0).sum(axis=1))
            v = max(1, len(coded.dictionary))
            pair, times = np.unique(doc * np.int64(v) + code, return_counts=True)
            deep = int(times.max()) + 1 if len(times) else 1
            key, many = np.unique((pair // v) * deep + times, return_counts=True)
            rows = key // deep
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows)), pa.array(n[rows]), pa.array(np.where(np.isfinite(best), best, 0.0)[rows]), pa.array(key % deep), pa.array(many)],
                names=["digest", "n_words", "divergence", "freq", "words"],
            )

    return texts.select("digest", "text").mapInArrow(make, "digest string, n_words bigint, divergence double, freq bigint, words bigint")


def curves(spectrum: DataFrame) -> DataFrame:
    """``(digest, bucket, slope, residual, divergence)``: the fitted rank-frequency curve of every text."""
    spectrum.createOrReplaceTempView("stuffed_spectrum")
    return spectrum.sparkSession.sql("""
        WITH ranked AS (
          SELECT *, sum(words) OVER (PARTITION BY digest ORDER BY freq DESC ROWS UNBOUNDED PRECEDING) - (words - 1) / 2.0D AS rank FROM stuffed_spectrum),
        logs AS (SELECT digest, n_words, divergence, words AS w, ln(rank) AS x, ln(freq) AS y FROM ranked),
        sums AS (SELECT digest, max(n_words) AS n_words, max(divergence) AS divergence, sum(w) AS sw, sum(w*x) AS sx, sum(w*y) AS sy, sum(w*x*x) AS sxx, sum(w*x*y) AS sxy, sum(w*y*y) AS syy FROM logs GROUP BY digest),
        fit AS (SELECT *, coalesce(try_divide(sw*sxy - sx*sy, sw*sxx - sx*sx), 0) AS slope FROM sums)
        SELECT digest, cast(floor(log2(n_words)) AS int) AS bucket, slope, divergence,
               sqrt(greatest(0, (syy - sy*sy/sw) - slope * (sxy - sx*sy/sw)) / sw) AS residual
        FROM fit WHERE n_words > 0""")  # fmt: skip



def usual(measured: DataFrame) -> dict[str, dict[int, tuple[float, float, float]]]:
    """For each measure and length (bucket): the usual value, the usual deviation from it, and from how many of those a text is extreme.

    Medians of each bucket over all texts (sketches, merged in the tasks), at most 64 buckets. Their trend over the buckets
    is the median of all slopes between two of them; a bucket's value is the trend plus the median of what the ``AROUND``
    buckets on either side and it itself stand off the trend. So half of the lengths around would have to be stuffed
    before stuffing is the usual. Deviations are medians over the same neighbourhood.
    """
    found: dict[str, dict[int, tuple[float, float, float]]] = {}
    flat = _on_trend(measured)
    mid = flat.groupBy("bucket").agg(*(F.percentile_approx(c, 0.5, 10_000).alias(c) for c in EXTREME), F.count("*").alias("n")).orderBy("bucket").take(64)
    n = {r["bucket"]: r["n"] for r in mid}
    centre = {c: _smooth({r["bucket"]: r[c] for r in mid}, trend=True) for c in EXTREME}
    if not mid:
        return {c: {} for c in EXTREME}
    off = [F.abs(F.col(c) - F.element_at(F.create_map(*(F.lit(x) for kv in centre[c].items() for x in kv)), F.col("bucket"))) for c in EXTREME]
    spread = flat.groupBy("bucket").agg(*(F.percentile_approx(x, 0.5, 10_000).alias(c) for c, x in zip(EXTREME, off, strict=True))).orderBy("bucket").take(64)
    for c in EXTREME:
        wide = _smooth({r["bucket"]: r[c] for r in spread}, trend=False)
        found[c] = {b: (centre[c][b], max(wide[b], 1e-3), EXTREME[c] - DOUBT / math.sqrt(n[b])) for b in centre[c]}
    return found


def _on_trend(measured: DataFrame) -> DataFrame:
    """Measures that follow a straight line over the bucket: a divergence falls by a factor for each doubling of the length."""
    return measured.withColumn("divergence", F.log2(F.greatest("divergence", F.lit(1e-4))))


def _smooth(at: dict[int, float], trend: bool) -> dict[int, float]:
    xs = sorted(at)
    steep = [(at[b] - at[a]) / (b - a) for i, a in enumerate(xs) for b in xs[i + 1 :]] if trend else []
    k = float(np.median(steep)) if steep else 0.0
    level = {x: at[x] - k * x for x in xs}
    return {x: k * x + float(np.median([level[y] for y in xs if abs(y - x) <= AROUND])) for x in xs}


def flagged(measured: DataFrame, ref: list[tuple[str, str, float]]) -> DataFrame:
    """``digest`` of the texts whose curve is extreme for their length, or that have no word of any language's commonest."""
    known = usual(measured)
    if not any(known.values()):
        return measured.select("digest").limit(0)
    extreme = F.lit(False)
    for c, at in known.items():
        mid, wide, most = (F.element_at(F.create_map(*(F.lit(x) for b in at for x in (b, at[b][k]))), F.col("bucket")) for k in range(3))
        z = (F.col(c) - mid) / wide
        extreme = extreme | ((F.abs(z) if c == "slope" else z) > most)
    rest: dict[str, float] = {}
    for lang, _, share in ref:
        rest[lang] = rest.get(lang, 1.0) - share
    if rest:
        # the divergence of a page without any of these words, whatever its length
        extreme = extreme | (F.col("divergence") >= math.log2(-math.log(min(1 - 1e-4, max(1e-4, *rest.values())))) - 1e-9)
    return _on_trend(measured).where(extreme).select("digest")


# the exact check

_CUE = re.compile(r"(?m)^\d+\r?$|^[\d:., ]+-->.*$|^\{\d+\}\{\d+\}|^[\d:.]+,[\d:.]+\r?$|^WEBVTT.*$|^NOTE\b.*$")
_URL = re.compile(r"https?://\S+|www\.\S+|<a\s[^>]*>.*?</a>|\[[^\]\n]*\]\(\S*?\)|\b[\w-]+(?: dot [\w-]+)+(?:/\S*)?|\b[\w-]+(?:\.[\w-]+)+/\S+|\b[\w-]+\.(?:com|net|org|info|test|invalid|example)\b\S*", re.I)
#: Without one of these there is no address in a text.
_MAYBE_URL = re.compile(r"://|\]\(|<a\s|\.\S| dot ", re.I)
_TAG = re.compile(r"<[^<>]*>|\{[^{}]*\}|♪|\[br\]", re.I)
_SPOKEN_NOISE = re.compile(r"\[[^\]\n]*\]|\([^)\n]*\)|\*[^*\n]*\*")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_SPACED = re.compile(r"(?:\b\w ){3,}\w\b")
_SENTENCE = re.compile(r"[^.!?…]+[.!?…]*")
#: A word that is more than this share of a page's words, common ones apart, is what the page is stuffed with.
DENSE = 0.05


def segments(text: str) -> list[str]:
    """Cues of subtitles (their lines joined), lines of pages and transcripts; cue numbers and times left out."""
    timed = "-->" in text or re.search(r"(?m)^[\d:.]+,[\d:.]+\r?$", text) is not None
    body = _CUE.sub("\x00" if timed else "\n", text)
    parts = re.split(r"\x00|\n\s*\n", body) if timed else body.split("\n")
    out = []
    for p in parts:
        p = re.sub(r"\s+", " ", re.sub(r"\[br\]|\|(?=\S)(?! )", " ", p, flags=re.I)).strip()
        if p:
            out.append(p)
    return out


def _unlinked(segment: str) -> tuple[str, int]:
    """A segment without its links, and their number."""
    return _URL.subn(" ", segment) if _MAYBE_URL.search(segment) else (segment, 0)


def listed(segment: str, unlinked: tuple[str, int], keywords: set[str], common: frozenset[str]) -> bool:
    """Whether a segment is keywords, tags, links or a list instead of speech or prose."""
    if segment.startswith("♪"):
        return False
    rest, links = unlinked
    if any(c in rest for c in "<{♪["):
        rest = _TAG.sub(" ", rest)
    words = _WORD.findall(rest.lower())
    if links and len(words) <= 7:
        return True
    if not words:
        return False
    tags = re.findall(r"#\w+", segment) if "#" in segment else []
    if len(tags) >= 2 and len(tags) * 2 >= len(words):
        return True
    if segment.count(" | ") >= 2 or segment.count("$$") >= 2 or ">>>" in segment or _SPACED.search(rest):
        return True
    if re.search(r"[.!?…]['\"”»)]*$", rest.strip()):
        return False
    items = [x for x in re.split(r"[;,]", rest) if x.strip()]
    if len(items) >= 2 and ";" in rest and all(len(x.split()) <= 7 for x in items):
        return True
    if len(items) >= 3 and all(len(x.split()) <= 5 for x in items):
        return True
    # words in a row without any of the words that make sentences
    return len(words) >= 4 and not any(w in common for w in words) and any(w in keywords for w in words) and segment == segment.lower()


def spam_share(text: str, common: frozenset[str]) -> float:
    """Share of the text, cue numbers and times apart, that is keywords, tags, links or lists, or sentences that repeat a keyword."""
    parts = segments(text)
    total = sum(map(len, parts))
    if not total:
        return 0.0
    unlinked = [_unlinked(p) for p in parts]
    tokens: Counter = Counter()
    for rest, _ in unlinked:
        tokens.update(w for w in _WORD.findall(rest.lower()) if w not in common)
    n = sum(tokens.values())
    keywords = {w for w, k in tokens.items() if k >= 3 and k > 0.015 * n and len(w) > 1}
    dense = {w for w in keywords if tokens[w] > DENSE * n and tokens[w] > 4 and len(w) > 2 and w.isalpha()}
    spam = 0
    for p, u in zip(parts, unlinked, strict=True):
        if listed(p, u, keywords, common):
            spam += len(p)
        elif dense and not p.startswith("♪"):
            for sentence in _SENTENCE.findall(p):
                counts = Counter(_WORD.findall(sentence.lower()))
                most = max((counts[w] for w in dense if w in counts), default=0)
                if most > 1:
                    spam += len(sentence)
                elif most and sentence.rstrip().endswith("?") and sum(w in dense for w in counts) * 4 >= len(counts):
                    spam += len(sentence)
    return spam / total


def _reference_rows(texts: DataFrame) -> list[tuple[str, str, float]]:
    return [tuple(r) for r in reference(texts).orderBy("lang", F.desc("share"), "word").take(LANGUAGES * TOP)]


def _measured(texts: DataFrame) -> tuple[DataFrame, list[tuple[str, str, float]]]:
    ref = _reference_rows(texts)
    return stored(curves(spectra(texts, ref)), "stuffed-curves"), ref


def _pages(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), _digest("text").alias("digest"))


def found(documents: DataFrame) -> DataFrame:
    """``doc_id`` of the flagged pages that are keywords, links, tags or lists for more than ``SHARE`` of their text."""
    docs = documents.select("doc_id", "lang", "text")
    texts = distinct_texts(docs)
    measured, ref = _measured(texts)
    common = frozenset(w for _, w, s in ref if s > 0.004)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [k for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if spam_share(t, common) > SHARE]
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.string())], names=["digest"])

    suspects = texts.select("digest", "text").join(flagged(measured, ref), "digest", "left_semi")
    spam = suspects.mapInArrow(check, "digest string")
    return _pages(docs).join(spam, "digest", "left_semi").select("doc_id").distinct()


def measures(documents: DataFrame) -> DataFrame:
    """``doc_id, bucket, slope, residual, divergence`` of every page."""
    docs = documents.select("doc_id", "lang", "text")
    measured, _ = _measured(distinct_texts(docs))
    per = _pages(docs).distinct().join(measured, "digest")
    return per.select("doc_id", "bucket", F.round("slope", 6).alias("slope"), F.round("residual", 6).alias("residual"), F.round("divergence", 6).alias("divergence"))
