"""Problem 7: passages of evaluation items inside training documents.

Method: an FM-index for each shard of the corpus. Documents are read as word symbols; words that are in no passage are
one separator symbol, since no test phrase can cross them. The phrases (all runs of ``SEED`` words of all passages) are
searched backwards through wavelet-matrix ranks, all at once, and located by sampled suffix positions. Occurrences on
neighbouring diagonals make candidates where the words around them agree, weighted by their information in the whole
corpus; an alignment of the words themselves then decides (``LEAST`` consecutive words of the passage, some miswritten,
a share of ``MISSING`` of them missing), and the spans to remove are merged.

A shard is what one task holds of the corpus at a time (about ``SHARD_WORDS`` words), so nothing is shuffled but the
hits, and memory doesn't grow with the corpus. The passages go to all tasks in blocks whose size is checked.

Defined results: null or empty documents and passages have no words and never match; items with one passage all count;
a passage shorter than ``LEAST`` words counts where it is found whole, one of fewer than ``SEED`` words by its own phrase;
repeated documents count once. Spans are given by word number and by character, so that texts can be cut (``cut_out``).
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fmindex import FMIndex

SEED = 3
LEAST = 12
#: Of the passage words in a leaked stretch so many may be missing, and words of the document come in between.
MISSING = 0.2
#: Words of the document that are not in the passage: one for so many words. Copies lose and misspell words, they don't
#: replace them; a sentence of the same pattern with other names is no copy.
FOREIGN = 16
#: Share of the information in a stretch that must agree: to make a candidate, and after alignment.
CANDIDATE, CERTAIN = 0.7, 0.78
#: Diagonals to either side that an alignment may wander.
BAND = 7
SHARD_WORDS = 1_500_000
#: Passages of one pass over the corpus: this many characters at most. More passages take more passes.
BLOCK_CHARS = 4_000_000

# What stands between words of a subtitle or page and isn't spoken.
_NOISE = (
    (r"(?m)^\d+\r?\n(\d[\d:.,]+ *-->)", r"\1"),
    (r"(?m)^[\d:.,]+ *--> *[\d:.,]+.*$", " "),
    (r"(?m)^\d\d:\d\d:\d\d[.,]\d+,\d\d:\d\d:\d\d[.,]\d+\r?$", " "),
    (r"\{\d+\}|<[^<>]{0,80}>|\[[^\[\]\n]{0,80}\]|\{[^{}\n]{0,80}\}|\([^()\n]{0,80}\)|♪|&[a-z]+;|\\[Nnh]", " "),
)
_WORD_GAPS = r"[^\pL\pM\pN]+"


def plain_words(texts: pa.Array, markup: bool = False) -> pa.ListArray:
    """Lower-case words of all texts, without cue numbers and times; without markup and sound descriptions unless asked for."""
    t = pc.fill_null(texts.cast(pa.string()), "")
    for pattern, to in _NOISE[:-1] if markup else _NOISE:
        t = pc.replace_substring_regex(t, pattern, to)
    t = pc.utf8_lower(pc.replace_substring_regex(t, _WORD_GAPS, " "))
    return pc.split_pattern(pc.utf8_trim(t, " "), " ")


_NOISE_SEEN = tuple((regex.compile(a), b == " ") for a, b in _NOISE)
_BLANKED = re.compile(r"[^\n]")
_WORDS_SEEN = regex.compile(r"[\pL\pM\pN]+")


def word_places(text: str, words: list[str]) -> list[tuple[int, int]]:
    """Where each of the words of a text (as ``plain_words`` gives them) begins and ends in the raw text.

    What isn't spoken is blanked out in place, so positions and lines stay.
    """
    t = text
    for pattern, whole in _NOISE_SEEN:
        t = pattern.sub(lambda m: _BLANKED.sub(" ", m[0] if whole else m[0][: m.start(1) - m.start()]) + ("" if whole else m[1]), t)  # noqa: B023
    places = [m.span() for m in _WORDS_SEEN.finditer(t)]
    if len(places) == len(words):
        return places
    # the two ways of reading differ (a letter that one of them doesn't know): find the words one after the other
    places, low, at = [], text.lower() if len(text.lower()) == len(text) else text, 0
    for w in words:
        k = low.find(w, at)
        a = k if k >= 0 else at
        at = min(len(text), a + len(w))
        places.append((a, at))
    return places


class Passages:
    """Words of the passages as symbols, and all phrases of SEED words with the places they come from."""

    def __init__(self, passages: list[str]) -> None:
        lists = plain_words(pa.array(passages, pa.string())).to_pylist()
        self.words = [[w for w in x if w] for x in lists]
        vocab = sorted({w for x in self.words for w in x})
        self.vocab = pa.array(vocab, pa.string())
        number = {w: i + 1 for i, w in enumerate(vocab)}
        self.ids = [np.array([number[w] for w in x], np.int64) for x in self.words]
        rows = [(p, i, tuple(ids[i : i + SEED])) for p, ids in enumerate(self.ids) for i in range(len(ids) - SEED + 1)]
        distinct = sorted({r[2] for r in rows})
        self.patterns = np.array(distinct, np.int64).reshape(len(distinct), SEED)
        # passages too short for a seed, by length: the phrase is the passage
        self.short = {n: [p for p, x in enumerate(self.ids) if len(x) == n] for n in range(1, SEED)}
        self.shortest = min((n for n in self.short if self.short[n]), default=SEED)
        at = {d: k for k, d in enumerate(distinct)}
        places: list[list[tuple[int, int]]] = [[] for _ in distinct]
        for p, i, d in rows:
            places[at[d]].append((p, i))
        self.place_start = np.concatenate([[0], np.cumsum([len(x) for x in places])]).astype(np.int64)
        flat = [x for y in places for x in y]
        self.place_passage = np.array([x[0] for x in flat], np.int64)
        self.place_at = np.array([x[1] for x in flat], np.int64)
        self.info = np.ones(len(vocab) + 1)
        # passages side by side, each with room around it: gathering beside a passage gives 0
        self.pad = 2 * LEAST + 8
        self.offset = np.cumsum([0] + [len(x) + 2 * self.pad for x in self.ids]).astype(np.int64)
        self.length = np.array([len(x) for x in self.ids], np.int64)
        self.flat = np.zeros(int(self.offset[-1]) + 2 * self.pad, np.int64)
        for p, x in enumerate(self.ids):
            self.flat[self.offset[p] + self.pad : self.offset[p] + self.pad + len(x)] = x

    def weights(self, passage: int) -> list[float]:
        return self.info[self.ids[passage]].tolist()

    def weigh(self, counts: dict[int, int], total: int) -> Passages:
        """Information of the words, from their counts over all documents."""
        n = np.array([0, *(counts.get(k + 1, 0) for k in range(len(self.vocab)))], float)
        self.info = np.log1p(max(total, 1) / (1 + n))
        self.info[0] = 0
        return self


def _indexed(symbols: np.ndarray, shortest: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that some phrase could cover, runs of at least the shortest, with one separator between; and where they stand."""
    n = len(symbols)
    known = symbols != 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
    first, end = edge[::2], edge[1::2]
    long = end - first >= shortest
    first, end = first[long], end[long]
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mark = np.zeros(n + 1, np.int64)
    mark[first] += 1
    mark[end] -= 1
    inside = np.cumsum(mark[:n]) > 0
    inside[end[end < n]] = True  # the separator after each run
    at = np.flatnonzero(inside)
    return np.where(known[at], symbols[at], 0), at


def _occurrences(index: FMIndex, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, position) of every occurrence of every pattern."""
    lo, hi = index.search(patterns)
    counts = hi - lo
    which = np.repeat(np.arange(len(counts)), counts)
    rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)
    return which, index.locate(rows) if len(rows) else rows


def _short_hits(index: FMIndex, at: np.ndarray, doc_of: np.ndarray, p: Passages) -> list[tuple[int, int, int, int]]:
    """(document row, passage, position, words) of whole passages of fewer than SEED words."""
    found = []
    for n, passages in p.short.items():
        if passages:
            which, spot = _occurrences(index, np.array([p.ids[q] for q in passages], np.int64).reshape(-1, n))
            found += [(int(doc_of[x]), passages[k], int(x), n) for k, x in zip(which, at[spot], strict=True)]
    return found


def _hits(index: FMIndex, at: np.ndarray, symbols: np.ndarray, doc_of: np.ndarray, p: Passages) -> np.ndarray:
    """(document row, passage, diagonal, position, place) of occurrences around which words agree enough, in order."""
    which, spot = _occurrences(index, p.patterns)
    if not len(spot):
        return np.zeros((0, 5), np.int64)
    spot = at[spot]
    # every place of the phrase in the passages
    n_places = (p.place_start[1:] - p.place_start[:-1])[which]
    spot, doc = np.repeat(spot, n_places), np.repeat(doc_of[spot], n_places)
    place = np.arange(n_places.sum()) - np.repeat(np.cumsum(n_places) - n_places, n_places) + np.repeat(p.place_start[which], n_places)
    found = []
    padded = np.concatenate([np.zeros(p.pad, np.int64), symbols, np.zeros(p.pad, np.int64)])
    span = np.arange(-LEAST + SEED, LEAST)
    wide = np.arange(-LEAST + SEED - 2, LEAST + 2)
    info = p.info.astype(np.float32)
    for a in range(0, len(spot), 50_000):
        s, d, k = spot[a : a + 50_000], doc[a : a + 50_000], place[a : a + 50_000]
        q, i = p.place_passage[k], p.place_at[k]
        want = p.flat[(p.offset[q] + p.pad + i)[:, None] + span]
        got = padded[(s + p.pad)[:, None] + wide]
        agree = np.zeros(want.shape, bool)
        for shift in range(5):
            agree |= want == got[:, shift : shift + len(span)]
        weight = info[want]
        both = np.cumsum(np.stack([np.where(agree, weight, 0), weight, (want != 0).astype(np.float32)]), axis=2)
        both = np.concatenate([np.zeros((3, len(s), 1), np.float32), both], axis=2)
        window = both[:, :, LEAST:] - both[:, :, :-LEAST]
        # windows that run over the end of a passage count only where the passage is that short
        full = window[2] >= np.minimum(LEAST, p.length[q])[:, None] - 0.5
        ok = (full & (window[0] >= CANDIDATE * window[1])).any(axis=1)
        found.append(np.stack([d[ok], q[ok], (s[ok] - i[ok]) // 8, s[ok], i[ok]], axis=1))
    return np.unique(np.concatenate(found), axis=0)


# Characters that recognition confuses, folded to one.
_FOLD = {ord(a): b for a, b in zip("0156839", "olsbbeg", strict=True)}


def same_word(a: str, b: str) -> bool:
    """Equal, or one a slight misspelling of the other."""
    if a == b:
        return True
    if a.isdigit() and b.isdigit():
        return False
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 2:
        return False
    fa, fb = (x.translate(_FOLD).replace("rn", "m").replace("cl", "d").replace("li", "h").replace("vv", "w").replace("i", "l") for x in (a, b))
    if fa == fb:
        return True
    if min(len(a), len(b)) < 3:
        return False
    most = 1
    row = list(range(len(fb) + 1))
    for i, x in enumerate(fa, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(fb, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


def aligned(doc: list[str], passage: list[str], weight: list[float], spots: list[tuple[int, int]], memo: dict, every: bool = True) -> list[tuple[int, int, int, int]]:
    """The alignments around spots of one diagonal: document from, to, passage from, to. All of them, or one if there is any.

    Every maximal exact run counts, and every stretch that passes with words missing or miswritten.
    """
    least = min(LEAST, len(passage))
    out: list[tuple[int, int, int, int]] = []
    seen: dict[int, int] = {}
    for s, i in spots:
        if s < seen.get(s - i, 0):
            continue
        a = b = 0
        while i - a > 0 and s - a > 0 and doc[s - a - 1] == passage[i - a - 1]:
            a += 1
        while i + b < len(passage) and s + b < len(doc) and doc[s + b] == passage[i + b]:
            b += 1
        seen[s - i] = s + b
        if a + b >= least:
            out.append((s - a, s + b, i - a, i + b))
            if not every:
                return out
    lo = max(0, spots[0][0] - min(3 * LEAST, spots[0][1] + BAND))
    hi = min(len(doc), spots[-1][0] + min(3 * LEAST, len(passage) - spots[-1][1] + BAND))
    if not every:
        return [got] if (got := _banded(doc, passage, weight, spots, least, memo, lo, hi)) else []
    starts = sorted({s for s, _ in spots})
    todo = [(lo, hi)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < (1 - MISSING) * least:
            continue
        if got := _banded(doc, passage, weight, spots, least, memo, lo, hi):
            out.append(got)
            todo += [(lo, got[0]), (got[1], hi)]
        elif (k := bisect.bisect_right(starts, lo)) < len(starts) and starts[k] < hi:
            # words that go before may have spoilt a stretch: begin again at the next spot
            todo.append((starts[k], hi))
    return out


def _banded(x: list[str], y: list[str], weight: list[float], spots: list[tuple[int, int]], least: int, memo: dict, lo: int, hi: int, band: int = BAND) -> tuple[int, int, int, int] | None:
    """The best local alignment of document words from lo to hi within a band around the diagonal of the spots."""
    d = spots[0][0] - spots[0][1]
    # score, first document word, first passage word, matches, their information, foreign words
    zero = (0.0, 0, 0, 0, 0.0, 0)
    sums = [0.0]
    for w in weight:
        sums.append(sums[-1] + w)
    before: dict[int, tuple] = {}
    best = None
    for i in range(lo, hi):
        now: dict[int, tuple] = {}
        a = x[i]
        for j in range(max(0, i - d - band), min(len(y), i - d + band + 1)):
            b = y[j]
            eq = a == b
            if not eq:
                eq = memo.get((a, b))
                if eq is None:
                    eq = memo[a, b] = same_word(a, b)
            if eq:
                c = before.get(j - 1, zero)
                cell = (c[0] + 1, c[1], c[2], c[3] + 1, c[4] + weight[j], c[5]) if c[0] > 0 else (1.0, i, j, 1, weight[j], 0)
            else:
                up, left = before.get(j, zero), now.get(j - 1, zero)
                cell = (up[0] - 2, up[1], up[2], up[3], up[4], up[5] + 1)
                if left[0] - 1 > cell[0]:
                    cell = (left[0] - 1, *left[1:])
            if cell[0] > 0:
                now[j] = cell
                n = j + 1 - cell[2]
                if eq and n >= least and cell[3] >= (1 - MISSING) * n and cell[5] <= n // FOREIGN and cell[4] >= CERTAIN * (sums[j + 1] - sums[cell[2]]):
                    if best is None or cell[3] > best[0]:
                        best = cell[3], cell[1], i + 1, cell[2], j + 1
        before = now
    return best[1:] if best else None


_OUT = "doc_id bigint, passage int, first int, last int, p_first int, p_last int, start int, stop int"


def scan(documents: DataFrame, passages: Passages, key: str = "doc_id", text: str = "text", every: bool = True) -> DataFrame:
    """``doc_id, passage, first, last, p_first, p_last, start, stop``: leaked stretches by word (first, last) and character (start, stop).

    All of them, or one for each diagonal and then without characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[pa.Array] = []
        texts: list[pa.Array] = []
        words: list[pa.ListArray] = []
        n = 0
        for b in batches:
            w = plain_words(b.column(1))
            keys.append(b.column(0))
            texts.append(b.column(1))
            words.append(w)
            n += len(w.values) if len(w) else 0
            if n >= SHARD_WORDS:
                yield _shard(keys, texts, words, passages, every)
                keys, texts, words, n = [], [], [], 0
        if keys:
            yield _shard(keys, texts, words, passages, every)

    docs = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(run, _OUT)


def _shard(keys: list[pa.Array], texts: list[pa.Array], words: list[pa.ListArray], p: Passages, every: bool) -> pa.RecordBatch:
    key = pa.concat_arrays(keys)
    raw = pa.chunked_array(texts)
    lists = pa.concat_arrays(words)
    flat = lists.flatten()
    sizes = np.asarray(pc.list_value_length(lists))
    start = np.concatenate([[0], np.cumsum(sizes)])
    coded = flat.dictionary_encode()
    number = np.asarray(pc.fill_null(pc.add(pc.index_in(coded.dictionary, p.vocab), 1), 0)).astype(np.int64)
    symbols = number[np.asarray(coded.indices)] if len(flat) else np.zeros(0, np.int64)
    # a separator between documents: no phrase runs on from one into the next
    n_docs = len(sizes)
    doc_of = np.repeat(np.arange(n_docs), sizes)
    spaced = np.zeros(len(symbols) + n_docs, np.int64)
    spaced[np.arange(len(symbols)) + doc_of] = symbols
    doc_spaced = np.repeat(np.arange(n_docs), sizes + 1)
    rows: set[tuple] = set()
    indexed, at = _indexed(spaced, p.shortest)
    if len(indexed):
        index = FMIndex(indexed, len(p.vocab) + 1)
        # positions in the spaced sequence to positions in the document
        rows |= {(d, q, x - int(start[d]) - d, x - int(start[d]) - d + n, 0, n) for d, q, x, n in _short_hits(index, at, doc_spaced, p)}
        hits = _hits(index, at, spaced, doc_spaced, p)
        memo: dict[tuple[str, str], bool] = {}
        last, doc = -1, []
        group = np.flatnonzero(np.any(np.diff(hits[:, :3], axis=0, prepend=-9), axis=1)) if len(hits) else []
        for a, z in zip(group, [*group[1:], len(hits)], strict=False):
            d, q = int(hits[a, 0]), int(hits[a, 1])
            if d != last:
                last, doc = d, flat.slice(start[d], sizes[d]).to_pylist()
            spots = [(s - int(start[d]) - d, i) for s, i in hits[a:z, 3:].tolist()]
            rows |= {(d, q, *got) for got in aligned(doc, p.words[q], p.weights(q), spots, memo, every)}
    out: list[tuple] = []
    last, places = -1, []
    for d, q, first, end, *of in sorted(rows):
        if every and d != last:
            last, places = d, word_places(raw[d].as_py(), flat.slice(start[d], sizes[d]).to_pylist())
        out.append((key[d].as_py(), q, first, end, *of, *((places[first][0], places[end - 1][1]) if every else (None, None))))
    cols = list(zip(*out, strict=True)) or [[] for _ in range(8)]
    types = (pa.int64(), *[pa.int32()] * 7)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "passage", "first", "last", "p_first", "p_last", "start", "stop"])


def word_counts(documents: DataFrame, passages: Passages, key: str = "doc_id", text: str = "text") -> tuple[dict[int, int], int]:
    """Occurrences of the words of the passages over all documents, and of all words. As many numbers as passages have words."""
    vocab = passages.vocab

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(vocab) + 1, np.int64)
        total = 0
        for b in batches:
            coded = plain_words(b.column(0)).flatten().dictionary_encode()
            number = np.asarray(pc.fill_null(pc.add(pc.index_in(coded.dictionary, vocab), 1), 0)).astype(np.int64)
            each = np.bincount(np.asarray(coded.indices), minlength=len(number)) if len(number) else np.zeros(0, np.int64)
            np.add.at(n, number, each)
            total += len(coded)
        n[0] = total
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)), pa.int32()), pa.array(n)], names=["word", "n"])

    got = documents.where(F.col(text).isNotNull()).select(text).mapInArrow(count, "word int, n bigint").where("n > 0").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r[0]: r[1] for r in got}
    return counts, counts.pop(0, 0)


def leaks(documents: DataFrame, items: DataFrame, every: bool = True) -> DataFrame:
    """``item_id, doc_id, first, last, start, stop``: spans of each item's passage in each document, by word and by character. All, or one for each diagonal."""
    spark = documents.sparkSession
    per_passage = items.where(F.col("passage").isNotNull()).groupBy("passage").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    out = None
    block: list = []
    size = 0

    def add(rows: list) -> None:
        nonlocal out
        table = spark.createDataFrame([(k, i) for k, r in enumerate(rows) for i in r[1]], "passage int, item_id bigint").coalesce(1)
        p = Passages([r[0] for r in rows])
        hits = scan(documents, p.weigh(*word_counts(documents, p)), every=every).join(table, "passage").select("item_id", "doc_id", "first", "last", "start", "stop")
        out = hits if out is None else out.unionByName(hits)

    for r in per_passage.orderBy("passage").toLocalIterator():
        if block and size + len(r[0]) > BLOCK_CHARS:
            add(block)
            block, size = [], 0
        block.append(r)
        size += len(r[0])
    if block or out is None:
        add(block)
    return out


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(documents, items, every=False).select("item_id", "doc_id").distinct()


def removal_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, first, last, start, stop``: the stretches to remove, by word and by character, overlapping ones merged.

    Grouped by document: its own spans only.
    """
    each = F.struct("first", "last", "start", "stop")
    spans = leaks(documents, items).select("doc_id", each.alias("x")).distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("s"))
    top = lambda acc: F.element_at(acc, -1)
    both = lambda a, x: F.struct(a["first"].alias("first"), F.greatest(a["last"], x["last"]).alias("last"), a["start"].alias("start"), F.greatest(a["stop"], x["stop"]).alias("stop"))
    merged = F.aggregate(
        "s", F.expr("cast(array() as array<struct<first:int,last:int,start:int,stop:int>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (top(acc)["last"] >= x["first"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(both(top(acc), x)))).otherwise(F.concat(acc, F.array(x))),
    )
    return spans.select("doc_id", F.inline(merged))


def cut_out(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, text, cleaned``: the texts with leaks, without the stretches of ``removal_spans``; a blank stands for each."""
    s = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("s"))
    kept = F.aggregate(
        "s", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(x["stop"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit(" ")).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    one = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return one.join(s, "doc_id").select("doc_id", "text", kept.alias("cleaned")).distinct()
