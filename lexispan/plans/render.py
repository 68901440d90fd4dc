"""Trees as text: written ones as a query that parses to the same tree, lowered ones in functional form."""

from __future__ import annotations

import re

from .nodes import LEAVES, RELATIONS, WINDOWS, Node
from .parser import QueryError, parse

_TIGHT = {"or": 1, "and": 2, "andnot": 3, "then": 6, "near": 6, "within": 7, "boost": 8} | dict.fromkeys(WINDOWS, 4) | dict.fromkeys(RELATIONS, 5)
_STARS = re.compile(r"([*?])")
_SPECIAL = re.compile(r'([\\"\[\]_])')


def number(x: float) -> str:
    if x == int(x):
        return str(int(x))
    import numpy as np

    return np.format_float_positional(np.float32(x), trim="-")


def fuzzy(arg: tuple) -> str:
    text, prefix, distance = arg
    return f"{text}~{distance}" if prefix == 1 else f"{text}~{prefix}:{distance}"


def bounds(arg: tuple) -> str:
    return " TO ".join("*" if b is None else b for b in arg)


def window(node: Node) -> str:
    if node.op in ("first", "last"):
        unit, n = node.arg
        return f"IN {node.op.upper()} {n}" + ("%" if unit == "%" else " WORDS")
    if node.op == "middle":
        return f"IN MIDDLE {node.arg}%"
    return f"IN WORDS {node.arg[0]} TO {node.arg[1]}"


def element(e: Node | int) -> str:
    if isinstance(e, int):
        return "_" * e
    if e.op == "alts":
        return "[" + " ".join(map(surface, e.kids)) + "]"
    return _SPECIAL.sub(r"\\\1", e.arg)


def surface(node: Node, least: int = 0) -> str:
    """A written tree, with parentheses only where they are needed."""
    op, kids, arg = node.op, node.kids, node.arg
    mine = _TIGHT.get(op, 9)
    if op == "term":
        out = _STARS.sub(r"\\\1", arg)
    elif op == "all":
        out = "*"
    elif op == "none":
        out = ""
    elif op == "fuzzy":
        out = fuzzy(arg)
    elif op == "wild":
        out = "".join(p[0] if isinstance(p, tuple) else _STARS.sub(r"\\\1", p) for p in arg)
    elif op == "regex":
        out = "MATCHES " + re.sub(r"([ \t\r\n\f])", r"\\\1", arg)
    elif op == "range":
        out = bounds(arg)
    elif op == "phrase":
        out = '"' + " ".join(map(element, arg[0])) + '"' + (f"~{arg[1]}" if arg[1] is not None else "")
    elif op in ("alts", "atleast"):
        head = "" if op == "alts" else "ALL OF " if arg[0] == "all" else f"AT LEAST {arg[1]}{'%' if arg[0] == '%' else ''} OF "
        out = head + "[" + " ".join(map(surface, kids)) + "]"
    elif op in ("or", "and", "andnot"):
        word = {"or": " OR ", "and": " AND ", "andnot": " AND NOT "}[op]
        out = surface(kids[0], mine) + word + surface(kids[1], mine + 1)
    elif op in ("then", "near"):
        out = f"{surface(kids[0], 6)} {op.upper()}/{arg} {surface(kids[1], 7)}"
    elif op in RELATIONS:
        out = f"{surface(kids[0], 6)} {RELATIONS[op]} {surface(kids[1], 6)}"
    elif op in WINDOWS:
        out = f"{surface(kids[0], 5)} {window(node)}"
    elif op == "within":
        out = f"{surface(kids[0], 8)} WITHIN {arg}"
    else:
        inner = surface(kids[0], 9)
        out = (f"({inner})" if kids[0].op == "regex" else inner) + f"^{number(arg)}"  # a pattern would go on
    return f"({out})" if mine < least else out


_SPAN_NAMES = {
    "encloses": "CONTAINING",
    "enclosed_by": "CONTAINED_BY",
    "not_encloses": "NOT_CONTAINING",
    "not_enclosed_by": "NOT_CONTAINED_BY",
    "overlapping": "OVERLAPPING",
    "not_overlapping": "NON_OVERLAPPING",
    "before": "BEFORE",
    "after": "AFTER",
    "ordered": "ORDERED",
    "unordered": "UNORDERED",
    "or": "OR",
}


def _phrase_like(node: Node) -> str | None:
    if node.op == "maxgaps" and node.kids[0].op == "ordered" and all(k.op == "term" for k in node.kids[0].kids):
        words = " ".join(_SPECIAL.sub(r"\\\1", k.arg) for k in node.kids[0].kids)
        return f'PHRASE{f"/{node.arg}" if node.arg else ""}("{words}")'
    return None


def span(node: Node, simple: bool) -> str:
    """A tree of spans; simple: none of its parts needs a document's length."""
    if simple and (p := _phrase_like(node)):
        return p
    kids = [span(k, simple) for k in node.kids]
    op, arg = node.op, node.arg
    if op == "empty":
        return "EMPTY"
    if op == "term":
        return arg
    if op == "regex":
        return f"/{arg}/"
    if op == "range":
        return bounds(arg)
    if op == "fuzzy":
        return fuzzy(arg)
    if op == "boost":
        return kids[0]
    if op == "maxgaps":
        return f"MAXGAPS({arg}, {kids[0]})"
    if op == "gaps":
        return f"GAPS({arg[0]}..{arg[1]}, {kids[0]})"
    if op == "width":
        return f"MAXWIDTH({arg}, {kids[0]})"
    if op == "atleast":
        return f"ATLEAST({', '.join([str(arg), *kids])})"
    if op == "between" and simple:
        low, high = max(arg[0], 1) - 1, arg[1] - 1
        return f"WITHIN_POSITIONS({low}, {high}, {kids[0]})"
    if op == "first" and simple:
        return f"WITHIN_POSITIONS(0, {arg[1] - 1}, {kids[0]})"
    if op in WINDOWS:
        return f"POSITION_FILTER({window(node)}, {kids[0]})"
    return f"{_SPAN_NAMES[op]}({', '.join(kids)})"


def needs_length(node: Node) -> bool:
    """Whether a window of the tree depends on the document's length, or a threshold is open."""
    if node.op == "atleast" or node.op in ("last", "middle") or (node.op == "first" and node.arg[0] == "%"):
        return True
    if node.op == "first" and node.arg[1] == 0 or node.op == "between" and (node.arg[0] > node.arg[1] or node.arg[1] == 0):
        return True
    return any(map(needs_length, node.kids))


def lowered(node: Node) -> str:
    op, kids, arg = node.op, node.kids, node.arg
    if op == "span":
        root = kids[0]
        outer = root.op in WINDOWS
        body = root.kids[0] if outer else root
        if needs_length(body):
            return f"SPAN({span(root, False)})"
        text = _phrase_like(body) or f"SPAN({span(body, True)})"
        return f"{text} {window(root)}" if outer else text
    if op in ("and", "or"):
        return f"{op.upper()}({', '.join(map(lowered, kids))})"
    if op == "atleast":
        return f"ATLEAST({', '.join([str(arg), *map(lowered, kids)])})"
    if op == "not":
        return f"NOT({lowered(kids[0])})"
    if op == "all":
        return "*"
    if op == "regex":
        return f"REGEX({arg})"
    if op == "range":
        low, high = ("*" if b is None else b for b in arg)
        return f"RANGE({low}, {high})"
    if op == "fuzzy":
        return fuzzy(arg)
    if op == "boost":
        inner = lowered(kids[0])
        return f"{inner}^{number(arg)}" if kids[0].op in ("term", "fuzzy") else f"({inner})^{number(arg)}"
    assert op in LEAVES, op
    return arg


def maybe_quote(text: str) -> str:
    """The text, in quotes unless it is a query for itself as one term."""
    try:
        if parse(text) == Node("term", (), text):
            return text
    except QueryError:
        pass
    return '"' + _SPECIAL.sub(r"\\\1", text) + '"'
