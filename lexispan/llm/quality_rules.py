"""Quality rules: counts of words, symbols and repeats, and n-gram perplexity within language bands.

The model is an interpolated modified Kneser-Ney model of symbol 4-grams, one per language. Symbols
are 32: the letters without case and accents, and classes of white space, marks, digits and signs. Any other
character is spelled by several, so that none shares another's. So a language has 2**20 4-grams at most. The languages found are numbered,
and SLOTS of them are worked on at once, 2**24 4-grams together whatever the corpus: that bounds what is
counted, gathered and broadcast (at most 16 M keys of 4 bytes with 4-byte values). A table of more
languages goes through in groups of SLOTS, each language still with its own model and band. The 4-grams of all texts are counted in Spark (each task adds up
its own before the shuffle). The model is kept as sorted arrays of keys, found by binary search.

A language's band is the median of its documents' log perplexity plus and minus a multiple of their
median deviation, wider by the square root for documents shorter than the median one, whose perplexity
varies more. Documents outside the band are rejected. One above it is first judged again by the best of
the group's models in each window of WINDOW symbols, so that clean texts of several languages stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import SPACE, code_points, hash_spans, materialize, mix, slices, small_batches, spans, utf8

SLOTS = 16
MIN_WORDS = 50
#: A band is the median plus and minus SPREAD * MAD (FLOOR at least) of log10 perplexity.
SPREAD, FLOOR = 5.0, 0.01
#: Symbols of a document that one language's model judges when it lies above its band.
WINDOW = 32
#: (slot, median, half-width, median length) of a band.
Band = tuple[int, float, float, float]
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """Class of each code point below 0x250, and whether it is its own: the other letters are places in a page (`classes`)."""
    import unicodedata

    out, own = np.zeros(0x250, np.uint8), np.ones(0x250, bool)
    for c in range(0x250):
        base = unicodedata.normalize("NFD", chr(c).lower())[0]
        if base in "abcdefghijklmnopqrstuvwxyz":
            out[c] = ord(base) - 97
        elif chr(c).isspace() or c < 32:
            out[c] = 26
        elif chr(c) in ".,;:'\"-?()":
            out[c] = 27
        elif chr(c).isdigit():
            out[c] = 28
        elif chr(c).isalpha():
            out[c], own[c] = c % 26, False
        elif c < 128:
            out[c] = 29 + c % 2
        else:
            out[c] = 30
    return out, own


_CLASS, _OWN = _symbols()
#: Capitals that follow a capital are one symbol of their own.
CAPITAL = 31
_UPPER = np.array([chr(c).isupper() for c in range(0x250)])
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def languages(docs: DataFrame, lang: str = "lang") -> list[list[str | None]]:
    """The distinct languages in groups of SLOTS, null being one; one empty group for an empty table."""
    found = [x[0] for x in docs.select(lang).distinct().collect()]
    found.sort(key=lambda x: (x is None, x or ""))
    return [found[i : i + SLOTS] for i in range(0, len(found), SLOTS)] or [[]]


def numbers(langs: pa.Array, group: list[str | None]) -> np.ndarray:
    """The place of each row's language in its group."""
    at = {x: i for i, x in enumerate(group)}
    return np.array([at[x] for x in langs.to_pylist()], np.int64)


def _code_points_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points that begin at these bytes."""
    b = data[at].astype(np.int32)
    cp = b.copy()
    for lead, size in ((0xC0, 1), (0xE0, 2), (0xF0, 3)):
        some = np.flatnonzero(b >= lead)  # the longer ones again below
        value = b[some] & ((1 << (6 - size)) - 1)
        for k in range(1, size + 1):
            value = value << 6 | (data[at[some] + k] & 0x3F)
        cp[some] = value
    return cp


def _paged(sym: np.ndarray, off: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sym with a switch before each letter whose page is not that of the letter before it, 0 at the start of a row.

    A switch is two spaces, which occur nowhere else, and the page: one digit below 20, or four, the first from 20 to 25."""
    letters = np.flatnonzero(sym < 26)
    before = np.concatenate([[0], page[letters][:-1]])
    first = np.searchsorted(letters, off[:-1])
    before[first[first < len(letters)]] = 0
    turns = letters[page[letters] != before]
    to = page[turns]
    short = to < 20
    size = np.where(short, 3, 6)
    more = np.zeros(len(sym) + 1, np.int64)
    more[turns] = size
    shift = np.cumsum(more)  # a letter comes after its switch
    out = np.full(len(sym) + shift[-1], 26, np.uint8)
    at = np.arange(len(sym)) + shift[:-1]
    out[at] = sym
    begin = at[turns] - size
    out[begin[short] + 2] = to[short]
    for k, unit in enumerate((26**3, 26**2, 26, 1)):
        out[begin[~short] + 2 + k] = (to[~short] // unit % 26) + (20 if k == 0 else 0)
    return out, off + np.concatenate([[0], shift])[off]


def classes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all rows, white space runs as one, and the offsets of the rows.

    A character has one symbol. Those with none of their own have a page and a place in it (their code point by 26), and
    the page is written where it changes, so that no two of them share their symbols."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    cp = _code_points_at(data, at)
    known = cp < 0x250
    sym = np.where(known, _CLASS[np.minimum(cp, 0x24F)], (cp % 26).astype(np.uint8))
    upper = known & _UPPER[np.minimum(cp, 0x24F)]
    total = np.concatenate([[0], np.cumsum(lead)])
    follows = np.ones(len(sym) + 1, bool)  # not the first of its row
    follows[total[off]] = False
    follows = follows[:-1]
    before = np.concatenate([[False], upper[:-1]])
    sym[upper & before & follows] = CAPITAL
    blank = sym == 26
    keep = ~(blank & np.concatenate([[False], blank[:-1]]) & follows)
    count = np.concatenate([[0], np.cumsum(keep)])
    sym, ends = sym[keep], count[total[off]]
    own = known & _OWN[np.minimum(cp, 0x24F)]
    return (sym, ends) if own.all() else _paged(sym, ends, np.where(own, 0, cp // 26)[keep])


def grams(sym: np.ndarray, off: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key (slot, four symbols) of every place whose three symbols before it are of its row, and the rows' first keys.

    A row starts with three spaces, so that every symbol has a key."""
    n = np.diff(off)
    padded = np.full(len(sym) + 3 * len(n), 26, np.uint32)
    start = off[:-1] + 3 * np.arange(len(n))
    shift = np.repeat(3 * (np.arange(len(n)) + 1), n)
    padded[np.arange(len(sym)) + shift] = sym
    at = np.arange(len(sym)) + shift
    key = (padded[at - 3] << 15) | (padded[at - 2] << 10) | (padded[at - 1] << 5) | padded[at]
    del start
    return key | (np.repeat(slots.astype(np.uint32), n) << 20), off


def _count(batches: Iterator[pa.RecordBatch], group: list[str | None]) -> Iterator[pa.RecordBatch]:
    """(text, lang) to the task's own counts of each key."""
    keys, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for batch in batches:
        langs = numbers(batch.column(1), group)
        for i, j in slices(batch.column(0)):
            key, _ = grams(*classes(*utf8(batch.column(0).slice(i, j - i))), langs[i:j])
            codes, values = pd.factorize(key)
            both, where = np.unique(np.concatenate([keys, values]), return_inverse=True)
            added = np.concatenate([counts, np.bincount(codes, minlength=len(values))])
            keys, counts = both, np.bincount(where, weights=added, minlength=len(both)).astype(np.int64)
    for i in range(0, len(keys), 1 << 18):
        yield pa.record_batch([pa.array(keys[i : i + (1 << 18)].astype(np.int32)), pa.array(counts[i : i + (1 << 18)])], names=["key", "n"])


class KneserNey:
    """Interpolated modified Kneser-Ney of order 4, as sorted keys with log10 probabilities per order.

    An unseen key's probability is its context's weight times that of the key without its first
    symbol; contexts are the keys of the order below, found by the same search."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.prob, self.ctx, self.gamma = {}, {}, {}, {}
        order = np.argsort(keys)
        level = {4: (keys[order].astype(np.int64), counts[order].astype(np.float64))}
        for n in (3, 2, 1):  # continuation counts: how many symbols come before
            k, _ = level[n + 1]
            low = (k >> 5 * (n + 1) << 5 * n) | (k & ((1 << 5 * n) - 1)) if n < 3 else (k >> 20 << 15) | (k & 0x7FFF)
            level[n] = tuple(x.astype(t) for x, t in zip(np.unique(low, return_counts=True), (np.int64, np.float64), strict=True))
        below = None
        for n in (1, 2, 3, 4):
            k, c = level[n]
            cut = np.empty(len(k))
            edges = np.append(np.flatnonzero(np.diff(k >> 5 * n, prepend=-1)), len(k))
            for i, j in pairwise(edges):  # each language's own discounts
                cut[i:j] = np.take([0.0, *self._discounts(c[i:j])], np.minimum(c[i:j], 3).astype(int))
            ctx, where = np.unique(k >> 5, return_inverse=True)
            total = np.bincount(where, weights=c, minlength=len(ctx))
            gamma = np.bincount(where, weights=cut, minlength=len(ctx)) / total
            lower = np.full(len(k), 1 / 32) if below is None else below(self._shorter(k, n))
            self.keys[n], self.ctx[n], self.gamma[n] = k, ctx, gamma
            self.prob[n] = (c - cut) / total[where] + gamma[where] * lower
            below = lambda q, n=n: self._linear(q, n)

    @staticmethod
    def _shorter(k: np.ndarray, n: int) -> np.ndarray:
        """The key of order n without its first symbol."""
        return (k >> 5 * n << 5 * (n - 1)) | (k & ((1 << 5 * (n - 1)) - 1))

    @staticmethod
    def _discounts(c: np.ndarray) -> tuple[float, float, float]:
        n1, n2, n3, n4 = (float((c == i).sum()) for i in (1, 2, 3, 4))
        if not (n1 and n2 and n3 and n4):
            return 0.5, 0.75, 0.9
        y = n1 / (n1 + 2 * n2)
        return tuple(min(max(d, 0.05), i - 0.05) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))

    def _linear(self, q: np.ndarray, n: int) -> np.ndarray:
        if n == 0:
            return np.full(len(q), 1 / 32)
        if not len(self.keys[n]):
            return np.full(len(q), 1 / 32)
        at = np.minimum(np.searchsorted(self.keys[n], q), len(self.keys[n]) - 1)
        seen = self.keys[n][at] == q
        out = self.prob[n][at].copy()
        miss = np.flatnonzero(~seen)
        if len(miss):
            ctx = q[miss] >> 5
            c = np.minimum(np.searchsorted(self.ctx[n], ctx), len(self.ctx[n]) - 1)
            weight = np.where(self.ctx[n][c] == ctx, self.gamma[n][c], 1.0)
            out[miss] = weight * self._linear(self._shorter(q[miss], n), n - 1)
        return out

    def log10(self, q: np.ndarray) -> np.ndarray:
        """Of each key of order 4; equal keys are searched once."""
        codes, values = pd.factorize(q)
        return np.log10(self._linear(values.astype(np.int64), 4))[codes] if len(q) else np.zeros(0)


def train(docs: DataFrame, group: list[str | None], text: str = "text", lang: str = "lang") -> KneserNey:
    counts = docs.select(text, lang).mapInArrow(lambda batches: _count(batches, group), "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return KneserNey(counts.column("key").to_numpy(), counts.column("n").to_numpy())


def base_counts(arr: pa.Array) -> dict[str, np.ndarray]:
    """STATS of each text of a slice."""
    data, off = utf8(arr)
    starts, ends, first = spans(data, off)
    words = hash_spans(data, starts, ends)
    out = {"n_words": np.diff(first), "word_chars": code_points(data, off, ~SPACE[data])}
    total = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    out["n_symbols"] = total[off[1:]] - total[off[:-1]]
    rows = len(off) - 1
    # lines: every \n and every row end closes one; those with a word count
    cuts = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, off]))
    begin, end = cuts[:-1], cuts[1:]
    end = end - (data[end - 1] == 10) if len(end) else end
    some = np.searchsorted(starts, begin) < np.searchsorted(starts, end)
    begin, end = begin[some], end[some]
    row = np.searchsorted(off, begin, side="right") - 1
    out["n_dup_lines"] = np.bincount(row[_repeats(row, hash_spans(data, begin, end))[0]], minlength=rows)
    # words in windows of three that occur twice or more in their row
    n = np.maximum(np.diff(first) - 2, 0)
    idx = np.arange(n.sum()) + np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    owner = np.repeat(np.arange(rows), n)
    three = mix(mix(words[idx] * np.uint64(3) + words[idx + 1]) * np.uint64(5) + words[idx + 2]) if len(idx) else np.zeros(0, np.uint64)
    again = idx[_repeats(owner, three)[1]]
    hit = np.zeros(len(words) + 2, bool)
    for k in range(3):
        hit[again + k] = True
    seen = np.concatenate([[0], np.cumsum(hit[: len(words)])])
    out["n_repeat_words"] = seen[first[1:]] - seen[first[:-1]]
    return out


def _repeats(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose value an earlier place of the row has; places whose value another place has."""
    key = mix(value + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    codes, uniques = pd.factorize(key)
    count = np.bincount(codes, minlength=len(uniques))
    first = np.zeros(len(codes), bool)
    at = np.full(len(uniques), len(codes))
    np.minimum.at(at, codes, np.arange(len(codes))) if len(codes) < 64 else at.__setitem__(codes[::-1], np.arange(len(codes))[::-1])
    first[at[at < len(codes)]] = True
    return np.flatnonzero(~first), np.flatnonzero(count[codes] > 1)


def _windows(model: KneserNey, key: np.ndarray, off: np.ndarray, rows: np.ndarray, slots: int) -> np.ndarray:
    """Log perplexity of these rows, each window by the model of the group that fits it best."""
    n = np.diff(off)[rows]
    at = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(at[-1]) - np.repeat(at[:-1], n)
    base = key[place + np.repeat(off[:-1][rows], n)] & np.uint32(0xFFFFF)
    starts = np.flatnonzero(place % WINDOW == 0)
    best = np.max([np.add.reduceat(model.log10(base | np.uint32(k << 20)), starts) for k in range(slots)], axis=0)
    return -np.bincount(np.repeat(np.arange(len(rows)), n)[starts], best, len(rows)) / n


def measure(docs: DataFrame, model: KneserNey, group: list[str | None], text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with STATS (long), log_ppl (double, null without text) and lang_slot (int)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c not in (*STATS, "log_ppl", "lang_slot")]
    fields = docs.select(*[F.col(f"`{c}`") for c in own])
    schema = StructType(list(fields.schema)).add("log_ppl", "double").add("lang_slot", "integer")
    for c in STATS:
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            arr, langs = batch.column(own.index(text)), numbers(batch.column(own.index(lang)), group)
            for i, j in slices(arr):
                part = arr.slice(i, j - i)
                stats = base_counts(part)
                key, off = grams(*classes(*utf8(part)), langs[i:j])
                total = np.concatenate([[0], np.cumsum(model.log10(key))])
                n = np.diff(off)
                ppl = -(total[off[1:]] - total[off[:-1]]) / np.maximum(n, 1)
                got = [*[batch.column(k).slice(i, j - i) for k in range(len(own))], pa.array(ppl, mask=n == 0), pa.array(langs[i:j].astype(np.int32)), *[pa.array(stats[c].astype(np.int64)) for c in STATS]]
                yield pa.record_batch(got, names=schema.names)

    return fields.mapInArrow(run, schema)


def windowed(measured: DataFrame, model: KneserNey, group: list[str | None], text: str, lang: str) -> DataFrame:
    """measured with mixed_ppl, the log perplexity of each text's windows."""
    shared = measured.sparkSession.sparkContext.broadcast(model)
    columns, schema = measured.columns, StructType(list(measured.schema)).add("mixed_ppl", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arr, langs = batch.column(columns.index(text)), numbers(batch.column(columns.index(lang)), group)
            for i, j in slices(arr):
                key, off = grams(*classes(*utf8(arr.slice(i, j - i))), langs[i:j])
                mixed = _windows(shared.value, key, off, np.arange(j - i), len(group))
                yield pa.record_batch([*batch.slice(i, j - i).columns, pa.array(mixed)], names=schema.names)

    return measured.mapInArrow(run, schema)


LENGTH = "n_words + word_chars"


def bands(measured: DataFrame) -> list[Band]:
    """The band of each language, from all documents that pass the base rules."""
    good = measured.where(~base_failed() & F.col("log_ppl").isNotNull())
    middle = good.groupBy("lang_slot").agg(F.percentile_approx("log_ppl", 0.5, 10_000).alias("m")).collect()
    at = F.lit(0.0)
    for r in middle:
        at = F.when(F.col("lang_slot") == r["lang_slot"], F.lit(r["m"])).otherwise(at)
    spread = good.withColumn("m", at).groupBy("lang_slot").agg(F.first("m").alias("m"), F.percentile_approx(F.abs(F.col("log_ppl") - F.col("m")), 0.5, 10_000).alias("d"), F.percentile_approx(F.expr(LENGTH), 0.5, 10_000).alias("n")).collect()
    return [(r["lang_slot"], r["m"], max(SPREAD * r["d"], FLOOR), float(r["n"])) for r in spread]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _excess(limits: list[Band]) -> Column:
    """Log perplexity over the median, in widths of the document's band; null without a band."""
    out = F.lit(None).cast("double")
    for s, middle, width, length in limits:
        wide = F.lit(width) * F.sqrt(F.greatest(F.lit(1.0), F.lit(length) / F.greatest(F.expr(LENGTH), F.lit(1))))
        out = F.when(F.col("lang_slot") == s, (F.col("ppl") - F.lit(middle)) / wide).otherwise(out)
    return out


def judge(measured: DataFrame, limits: list[Band], model: KneserNey, group: list[str | None], text: str, lang: str) -> DataFrame:
    """measured with base_failed and kept. Texts above their band, few, are read once more."""
    placed = measured.withColumn("ppl", F.col("log_ppl")).withColumn("excess", _excess(limits)).withColumn("base_failed", base_failed())
    again = F.coalesce((F.col("excess") > 1) & ~F.col("base_failed"), F.lit(False))
    usual = placed.where(~again).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.abs("excess") <= 1, F.col("log_ppl").isNotNull()))
    mixed = windowed(placed.where(again), model, group, text, lang)
    mixed = mixed.withColumn("ppl", F.least("log_ppl", "mixed_ppl")).drop("mixed_ppl", "excess").withColumn("excess", _excess(limits))
    mixed = mixed.withColumn("kept", F.col("excess") <= 1)
    return usual.drop("ppl", "excess").unionByName(mixed.drop("ppl", "excess"))


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", narrow: bool = False, id_col: str = "doc_id") -> DataFrame:
    """docs with STATS, log_ppl, lang_slot (the language's number in its group), base_failed and kept; narrow: id_col and these columns alone.

    A null text has no words, so it fails the base rules; a null language is a language of its own.
    Texts are read whole, a very long one alone. Repeated rows are judged alike; a document on the edge
    of a band is inside. Documents of a language without any that passes the base rules have no band. An empty table gives
    no rows. Own columns with the names of the results are replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop("base_failed", "kept", "mixed_ppl", "ppl", "excess")
    groups = languages(docs, lang)
    parts = [_of_group(_rows(docs, lang, group) if len(groups) > 1 else docs, group, text, lang, narrow, id_col) for group in groups]
    return reduce(DataFrame.unionByName, parts)


def _rows(docs: DataFrame, lang: str, group: list[str | None]) -> DataFrame:
    some = F.coalesce(F.col(lang).isin([x for x in group if x is not None]), F.lit(False))
    return docs.where(some | F.col(lang).isNull() if None in group else some)


def _of_group(docs: DataFrame, group: list[str | None], text: str, lang: str, narrow: bool, id_col: str) -> DataFrame:
    if narrow:
        docs = docs.select(id_col, text, lang)
    model = train(docs, group, text, lang)
    measured = materialize(measure(docs, model, group, text, lang))
    out = judge(measured, bands(measured), model, group, text, lang)
    return out.drop(text, lang) if narrow else out
