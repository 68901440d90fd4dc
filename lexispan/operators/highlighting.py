"""Highlighting: which positions a query marks, and the text with those marks."""

from __future__ import annotations

import html
import re
import textwrap

from ..functions.analysis import DEFAULT, Options, Token, analyze
from ..plans.nodes import LEAVES, RELATIONS, Node, walk
from ..plans.render import lowered
from . import spans
from .matching import edits

Mark = tuple[str, int, int]
_CONVERSE = {"encloses": "enclosed_by", "enclosed_by": "encloses", "overlapping": "overlapping", "before": "after", "after": "before"}
_NAMES = "black red green yellow blue magenta cyan white gray".split()
#: ANSI codes by colour, for terms and for spans (a background with black or white on it).
TERM_COLORS = dict(zip(_NAMES, [*(f"1;{30 + i}" for i in range(8)), "1;90"], strict=True))
SPAN_COLORS = dict(zip(_NAMES, [f"{30 if n in ('yellow', 'cyan', 'white') else 97};{40 + i}" for i, n in enumerate(_NAMES[:8])] + ["97;100"], strict=True))
for _colors in (TERM_COLORS, SPAN_COLORS):
    _colors |= {"purple": _colors["magenta"], "grey": _colors["gray"]}
TERM_OTHERS = [*(TERM_COLORS[n] for n in _NAMES[1:7]), "1;91", "1;94"]
SPAN_OTHERS = [*(SPAN_COLORS[n] for n in _NAMES[1:7]), "30;101", "97;104"]


def marks(node: Node, tokens: list[Token]) -> list[Mark]:
    """(label, first, last position) of every part of the query that occurs, matched as a whole or not."""
    at: dict[str, list[int]] = {}
    for t in tokens:
        at.setdefault(t.text, []).append(t.pos)
    length = len(tokens)

    def places(leaf: Node) -> list[int]:
        if leaf.op == "term":
            return at.get(leaf.arg, [])
        if leaf.op == "regex":
            fits = re.compile(leaf.arg).fullmatch
        elif leaf.op == "range":
            low, high = leaf.arg
            fits = lambda t: (low is None or low.encode() <= t.encode()) and (high is None or t.encode() <= high.encode())
        else:
            text, prefix, most = leaf.arg
            p = min(prefix, len(text))
            fits = lambda t: t[:p] == text[:p] and edits(t[p:], text[p:]) <= most
        return sorted(i for t, own in at.items() if fits(t) for i in own)

    def label(leaf: Node) -> str:
        return leaf.arg if leaf.op == "term" else f"MATCHES {leaf.arg}" if leaf.op == "regex" else lowered(leaf)

    def inside(n: Node) -> list[spans.Span]:
        """Intervals whose parts witness a span tree."""
        if n.op in RELATIONS:
            own = spans.evaluate(n, places, length)
            if n.op.startswith("not_"):
                return own
            return own + spans.related(_CONVERSE[n.op], inside(n.kids[1]), spans.evaluate(n.kids[0], places, length))
        return spans.evaluate(n, places, length)

    out: list[Mark] = []

    def visit(n: Node) -> None:
        if n.op in LEAVES:
            out.extend((label(n), i, i) for i in places(n))
        elif n.op == "span":
            text = lowered(n)
            out.extend((text, s, e) for s, e, _ in inside(n.kids[0]))
        elif n.op != "not":
            for k in n.kids:
                visit(k)

    if tokens:
        visit(node)
    return out


def ranges(text: str, found: list[Mark], tokens: list[Token]) -> list[tuple[int, int, list[str]]]:
    """Character ranges of marks; those that overlap or touch are one."""
    start: dict[int, int] = {}
    end: dict[int, int] = {}
    for t in tokens:
        start.setdefault(t.pos, t.start)
        end[t.pos] = t.end
    known = sorted(start)
    raw = []
    for label, a, b in found:
        own = [p for p in known if a <= p <= b] if a != b else [a]
        if own and own[0] in start:
            raw.append((start[own[0]], end[own[-1]], label))
    out: list[tuple[int, int, list[str]]] = []
    for a, b, label in sorted(raw):
        if out and a <= out[-1][1]:
            x, y, labels = out[-1]
            out[-1] = (x, max(y, b), labels if label in labels else [*labels, label])
        else:
            out.append((a, b, [label]))
    return out


def slug(labels: list[str]) -> str:
    return re.sub(r"[^a-z0-9]+", "-", " ".join(labels).lower()).strip("-") or "qpart"


def highlight(text: str, node: Node, begin: str = "<b>", end: str = "</b>", options: Options = DEFAULT) -> str:
    """The text with begin and end around each marked range.

    $QUERY_PART in them is the parts of the query, escaped for HTML; $QUERY_LABEL a name made of them."""
    tokens, _ = analyze(text, options)
    out, last = [], 0
    for a, b, labels in ranges(text, marks(node, tokens), tokens):
        parts = {"$QUERY_PART": html.escape("; ".join(labels)), "$QUERY_LABEL": slug(labels)}
        fill = lambda s, parts=parts: re.sub(r"\$QUERY_PART|\$QUERY_LABEL", lambda m: parts[m[0]], s)
        out += [text[last:a], fill(begin), text[a:b], fill(end)]
        last = b
    return "".join([*out, text[last:]])


def _hash(labels: list[str]) -> int:
    """A 64-bit rotate, xor and multiply over the labels, eight bytes a step."""
    h = 0

    def add(word: int) -> None:
        nonlocal h
        h = (((h << 5 | h >> 59) & (2**64 - 1)) ^ word) * 0x517CC1B727220A95 & (2**64 - 1)

    for label in labels:
        raw = label.encode()
        while raw:
            n = next(n for n in (8, 4, 2, 1) if len(raw) >= n)
            add(int.from_bytes(raw[:n], "little"))
            raw = raw[n:]
        add(0xFF)
        add(0xFF)
    return h


def color(labels: list[str], is_span: bool) -> str:
    """The colour that a label names as a whole, else one by the hash of all."""
    named, others = (SPAN_COLORS, SPAN_OTHERS) if is_span else (TERM_COLORS, TERM_OTHERS)
    return next((named[x] for label in labels if (x := label.strip().lower()) in named), None) or others[_hash(labels) % len(others)]


def highlight_ansi(text: str, node: Node, wrap_to: int | None = None, options: Options = DEFAULT) -> str:
    """The text with ANSI colours, a line break never being coloured; wrap_to re-wraps it first."""
    if wrap_to:
        text = "\n".join(textwrap.fill(line, wrap_to, break_long_words=False, break_on_hyphens=False) for line in text.split("\n"))
    tokens, _ = analyze(text, options)
    spans_ = {lowered(n) for n in walk(node) if n.op == "span"}
    out, last = [], 0
    for a, b, labels in ranges(text, marks(node, tokens), tokens):
        begin = f"\x1b[{color(labels, any(x in spans_ for x in labels))}m"
        inner = re.sub(r"[^\r\n]+", lambda m, begin=begin: f"{begin}{m[0]}\x1b[0m", text[a:b])
        out += [text[last:a], inner]
        last = b
    return "".join([*out, text[last:]])
