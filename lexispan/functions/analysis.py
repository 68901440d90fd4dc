"""Text to terms: native Column expressions for ordinary text, an Arrow UDF for the rest.

A document is an array of terms in which a place without a term (a dropped token whose position is
kept) is null, so that a term's index is its position."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, fields
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stemming

LETTER, DIGIT = "A-Za-zÀ-ÖØ-öø-ÿ", "0-9"
#: Word segments of ASCII and Latin-1 text; understood alike by Java, Python and RE2.
WORDS = f"(?:[{LETTER}](?:[:'.]?[{LETTER}])*|[{DIGIT}](?:['.,;]?[{DIGIT}])*|_)+"
#: Text for which that pattern does not hold.
UNUSUAL = r"[^\x00-\x7f\xa0-\xa8\xab\xac\xaf-\xb1\xb4\xb6\xbb\xbf-\xff]"
_PLAIN = "".join(c for c in map(chr, range(0xC0, 0x100)) if len(unicodedata.normalize("NFD", c)) > 1)
_BASE = "".join(unicodedata.normalize("NFD", c)[0] for c in _PLAIN)


class AnalysisError(ValueError):
    """Options that don't go together."""


@dataclass(frozen=True)
class Options:
    """How an index analyzes its text and scores it."""

    tokenizer: str = "unicode"
    case_folding: str = "fold"
    accent_folding: str = "fold"
    long_tokens: str = "split"
    max_token_bytes: int = 256
    graphemes: str = "emoji"
    position_gaps: str = "preserve"
    stemmer: str | None = None
    k1: float = 1.2
    b: float = 0.75
    score_stop_words: str = ""

    def __post_init__(self) -> None:
        for name, allowed in (
            ("tokenizer", ("unicode", "whitespace")),
            ("case_folding", ("preserve", "fold")),
            ("accent_folding", ("preserve", "fold")),
            ("long_tokens", ("truncate", "discard", "split")),
            ("graphemes", ("discard", "emoji", "retain")),
            ("position_gaps", ("collapse", "preserve")),
        ):
            if getattr(self, name) not in allowed:
                raise AnalysisError(f"{name} must be one of {', '.join(allowed)}")
        if not 4 <= self.max_token_bytes <= 2692:
            raise AnalysisError("max_token_bytes must be from 4 to 2692")
        if self.stemmer is not None and self.stemmer not in stemming.STEMMERS:
            raise AnalysisError(f"no stemmer for {self.stemmer!r}; there are {', '.join(stemming.STEMMERS)}")
        if self.stemmer is not None and self.case_folding != "fold":
            raise AnalysisError("a stemmer needs case folding")
        if not 0 <= self.k1 <= 10_000 or not 0 <= self.b <= 1:
            raise AnalysisError("k1 must be from 0 to 10000 and b from 0 to 1")

    def analysis(self) -> tuple:
        return tuple(getattr(self, f.name) for f in fields(self)[:8])

    @property
    def stop_words(self) -> frozenset[str]:
        return frozenset(w.strip() for w in self.score_stop_words.split(",") if w.strip())


DEFAULT = Options()


@dataclass(frozen=True)
class Token:
    text: str
    pos: int
    split: bool = False
    start: int = 0
    end: int = 0


def _general_words() -> re.Pattern:
    import regex

    e = r"[\p{WB=Extend}\p{WB=Format}\p{WB=ZWJ}]*"
    a = r"[\p{WB=ALetter}\p{WB=Hebrew_Letter}]"
    ml = r"[\p{WB=MidLetter}\p{WB=MidNumLet}\p{WB=Single_Quote}]"
    mn = r"[\p{WB=MidNum}\p{WB=MidNumLet}\p{WB=Single_Quote}]"
    n = r"\p{WB=Numeric}"
    word = rf"(?:{a}{e}(?:(?:{ml}{e})?{a}{e})*|{n}{e}(?:(?:{mn}{e})?{n}{e})*|\p{{WB=Katakana}}{e}|\p{{WB=ExtendNumLet}}{e})+|[\p{{Alphabetic}}\p{{N}}]{e}"
    return regex.compile(word)


@lru_cache(1)
def _patterns() -> tuple:
    import regex

    return _general_words(), regex.compile(r"[\p{Alphabetic}\p{N}]"), regex.compile(r"\X"), regex.compile(r"\p{Extended_Pictographic}|\p{Regional_Indicator}{2}|[0-9#*]️?⃣"), regex.compile(r"\p{S}|\A\p{M}+\Z")


def is_emoji(cluster: str) -> bool:
    *_, emoji, _symbol = _patterns()
    return bool(emoji.match(cluster)) and not (len(cluster) == 1 and cluster.isascii())


def segments(text: str, options: Options) -> list[tuple[int, int]]:
    """Ranges of the base tokens, each of which takes a position."""
    if options.tokenizer == "whitespace":
        return [m.span() for m in re.finditer(r"\S+", text)]
    if not re.search(UNUSUAL, text):
        return [m.span() for m in re.finditer(WORDS, text) if re.search(f"[{LETTER}{DIGIT}]", m[0])]
    words, alnum, cluster, _, symbol = _patterns()
    out, end = [], 0

    def gap(a: int, b: int) -> None:
        if options.graphemes != "discard":
            for m in cluster.finditer(text, a, b):
                if is_emoji(m[0]) or (options.graphemes == "retain" and symbol.match(m[0])):
                    out.append(m.span())

    for m in words.finditer(text):
        if alnum.search(m[0]):
            gap(end, m.start())
            out.append(m.span())
            end = m.end()
    gap(end, len(text))
    return out


def fold(text: str, options: Options, literal: bool = False) -> str:
    if options.case_folding == "fold":
        text = text.lower()
    if options.stemmer is not None and not literal:
        text = stemming.stem(unicodedata.normalize("NFC", text), options.stemmer)
    if options.accent_folding == "fold" and not text.isascii():
        text = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)))
    return text


def chunks(text: str, most: int) -> list[str]:
    """Pieces of at most most bytes, cut between grapheme clusters, or inside one that is too long."""
    out, now, size = [], "", 0
    for m in _patterns()[2].finditer(text):
        parts = [m[0]] if len(m[0].encode()) <= most else list(m[0])
        for p in parts:
            n = len(p.encode())
            if size + n > most and now:
                out.append(now)
                now, size = "", 0
            now, size = now + p, size + n
    return [*out, now] if now else out


def analyze(text: str, options: Options = DEFAULT, literal: bool = False) -> tuple[list[Token], int]:
    """The tokens of a text and how many positions it takes. literal: without stemming."""
    out: list[Token] = []
    extra = place = 0
    for place, (a, b) in enumerate(segments(text, options), 1):
        base = place - 1 + extra
        folded = fold(text[a:b], options, literal)
        if not folded:
            continue
        if len(folded.encode("utf-8", "surrogatepass")) <= options.max_token_bytes:
            out.append(Token(folded, base, False, a, b))
        elif options.long_tokens == "truncate":
            first = chunks(folded, options.max_token_bytes)
            if first and len(first[0].encode()) <= options.max_token_bytes:
                out.append(Token(first[0], base, False, a, b))
        elif options.long_tokens == "split":
            parts = chunks(folded, options.max_token_bytes)
            out += [Token(p, base + k, True, a, b) for k, p in enumerate(parts)]
            extra += max(0, len(parts) - 1)
    consumed = place + extra
    if options.position_gaps == "collapse":
        out = [Token(t.text, k, t.split, t.start, t.end) for k, t in enumerate(out)]
        consumed = len(out)
    return out, consumed


def terms_of(text: str | None, options: Options) -> list[str | None] | None:
    if text is None:
        return None
    tokens, _ = analyze(text, options)
    out: list[str | None] = [None] * (tokens[-1].pos + 1 if tokens else 0)
    for t in tokens:
        out[t.pos] = t.text
    return out


def _java_words() -> str:
    """WORDS for Java: its possessive repeats never go back, and runs of _ alone are no match."""
    letters, digits = f"[{LETTER}]++(?:[:'.][{LETTER}]++)*+", f"[{DIGIT}]++(?:['.,;][{DIGIT}]++)*+"
    return f"_*+(?:{letters}|{digits})(?:{letters}|{digits}|_++)*+"


JAVA_WORDS = _java_words()


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


#: UNUSUAL with its characters one by one, which Java looks up in a table.
JAVA_UNUSUAL = "[^" + "".join(f"\\x{i:02x}" for i in range(256) if not re.match(UNUSUAL, chr(i))) + "]"


def is_plain(text: Column) -> Column:
    """Whether native_terms holds for a text: no unusual characters."""
    return _ascii(text) | ~text.rlike(JAVA_UNUSUAL)


def native_fold(text: Column, options: Options = DEFAULT) -> Column:
    if options.accent_folding == "fold":
        text = F.when(_ascii(text), text).otherwise(F.translate(text, _PLAIN, _BASE))
    return F.lower(text) if options.case_folding == "fold" else text


#: Follows each character of two bytes, so that characters count as bytes; ends a piece. Neither is in a plain text.
_SECOND, _END = "\u0100", "\u0101"


def _cut(found: Column, options: Options) -> Column:
    """Terms of plain text, those of too many bytes as analyze has them; each character is a cluster there."""
    most = options.max_token_bytes

    def fits(t: Column) -> Column:
        return F.octet_length(t) <= most

    def pieces(t: Column) -> Column:
        wide = F.regexp_replace(t, r"([^\x00-\x7f])", f"$1{_SECOND}")
        ended = F.regexp_replace(wide, f"(?s)(.{{1,{most}}})(?!{_SECOND})", f"$1{_END}")
        return F.filter(F.split(F.translate(ended, _SECOND, ""), _END), lambda p: p != "")

    if options.long_tokens == "truncate":
        return F.transform(found, lambda t: F.when(fits(t), t).otherwise(pieces(t)[0]))
    if options.long_tokens == "split":
        return F.flatten(F.transform(found, lambda t: F.when(fits(t), F.array(t)).otherwise(pieces(t))))
    if options.position_gaps == "collapse":
        return F.filter(found, fits)
    size = F.coalesce(F.array_max(F.transform(found, lambda t, i: F.when(fits(t), i + 1))), F.lit(0))
    return F.slice(F.transform(found, lambda t: F.when(fits(t), t)), 1, size)


def native_terms(text: Column, options: Options = DEFAULT) -> Column:
    """The terms array by built-in functions: for text that is plain, not stemmed."""
    text = native_fold(text, options)
    if options.tokenizer == "whitespace":
        found = F.filter(F.split(text, r"[\s\x85\xa0]+"), lambda t: t != "")
    else:
        found = F.regexp_extract_all(text, F.lit(JAVA_WORDS), 0)
    long = lambda terms_: F.exists(terms_, lambda t: F.octet_length(t) > options.max_token_bytes)
    return F.transform(F.array(found), lambda all_: F.when(long(all_), _cut(all_, options)).otherwise(all_))[0]  # found once


#: Bytes of text whose terms a Python worker holds as lists at once; a longer text is alone.
SLICE_BYTES = 1 << 20


def terms_of_all(texts: pa.Array, options: Options) -> pa.Array:
    """terms_of each text, some at a time: only Arrow's own form of the terms is held for a whole batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    out, i = [], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE_BYTES, side="right")))
        out.append(pa.array([terms_of(t, options) for t in texts[i:j].to_pylist()], pa.list_(pa.string())))
        i = j
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))


def general_terms(text: Column, options: Options = DEFAULT) -> Column:
    @F.arrow_udf("array<string>")
    def general(texts: pa.Array) -> pa.Array:
        return terms_of_all(texts, options)

    return general(text)


def terms(text: Column, options: Options = DEFAULT) -> Column:
    """The terms array of a text as one expression; null for null.

    All rows visit Python, plain ones as nulls; `with_terms` keeps those in the JVM."""
    if options.stemmer is not None:
        return general_terms(text, options)
    plain = is_plain(text)
    return F.when(text.isNull(), F.lit(None)).when(plain, native_terms(text, options)).otherwise(general_terms(F.when(~plain, text), options))


#: Bytes of a table for each core below which its rows are spread over all cores before they are analyzed.
SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table that is too small to have a full split for each core, evenly over the cores; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if 1 << 20 < size < cores * SMALL else df


def _bound(df: DataFrame, value: Column, name: str) -> DataFrame:
    """df with a column that is computed once: no filter moves below a generator of one row."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_terms(df: DataFrame, text: Column, options: Options = DEFAULT, need: Callable[[Column], Column] | None = None, name: str = "_terms") -> DataFrame:
    """The rows whose text is not null, with their terms, analyzed once.

    Plain texts never leave the JVM; the others go through an Arrow UDF, in a branch of their own.
    need: of a plain text as folded, a condition without which the row isn't wanted."""
    df = df.where(text.isNotNull())
    if options.stemmer is not None:
        return _bound(df, general_terms(text, options), name)
    if df.isStreaming:  # one source, read once
        return _bound(df, terms(text, options), name)
    df = _bound(spread(df), is_plain(text), "_plain")
    usual, other = df.where("_plain"), df.where("not _plain")
    if need is not None:
        usual = usual.where(F.exists(F.array(native_fold(text, options)), need))
    return _bound(usual.drop("_plain"), native_terms(text, options), name).union(_bound(other.drop("_plain"), general_terms(text, options), name))


def token_count(terms_: Column) -> Column:
    return F.size(F.filter(terms_, lambda t: t.isNotNull()))
