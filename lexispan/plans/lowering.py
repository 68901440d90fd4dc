"""From a written tree to one that can be run: terms through the analyzer, spans, simplification."""

from __future__ import annotations

import re
from functools import lru_cache

from ..functions.analysis import DEFAULT, Options, Token, analyze
from .nodes import ALL, LEAVES, NONE, RELATIONS, WINDOWS, Node, QueryError, term
from .parser import parse

NOTHING = Node("not", (ALL,))
_ESCAPE = re.compile(r"([\\.+*?()|\[\]{}^$#&\-~])")
_FOREIGN = re.compile(r"\(\?(?:[=!]|<[=!]|>)|\\[1-9]|\\[kG]|[*+?}]\+")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\1", text)


def check_regex(pattern: str) -> str:
    """Patterns without look-around, back-references and possessive quantifiers, which not every engine has."""
    if _FOREIGN.search(re.sub(r"\\\\", "", pattern)):
        raise QueryError("regex", f"unsupported construct in pattern {pattern!r}")
    try:
        re.compile(pattern)
    except re.error as e:
        raise QueryError("regex", f"bad pattern {pattern!r}: {e}") from e
    return pattern


# words through the analyzer


def _elements(tokens: list[Token]) -> list[Node | int]:
    out: list[Node | int] = []
    for before, t in zip([None, *tokens], tokens, strict=False):
        if before is not None and t.pos - before.pos > 1:
            out.append(t.pos - before.pos - 1)
        out.append(term(t.text))
    return out


def _whole(kind: str, text: str, options: Options) -> list[Token]:
    tokens, _ = analyze(text, options, literal=True)
    if any(t.split for t in tokens):
        raise QueryError("split", f"{kind} {text!r} is longer than a token may be")
    return tokens


def _wild(parts: tuple, options: Options) -> Node:
    pieces: list[tuple[int, list]] = [(0, [])]
    for p in parts:
        if isinstance(p, tuple):
            pieces[-1][1].append(p)
            continue
        tokens = _whole("wildcard literal", p, options)
        if not tokens:
            return NONE
        for before, t in zip([None, *tokens], tokens, strict=False):
            if before is not None:
                pieces.append((t.pos - before.pos - 1, []))
            pieces[-1][1].append(t.text)
    made: list[Node | int] = []
    for gap, piece in pieces:
        if all(isinstance(x, str) for x in piece):
            node = term("".join(piece))
        else:
            node = Node("regex", (), "".join({"*": ".*", "?": "."}[x[0]] if isinstance(x, tuple) else escape(x) for x in piece))
        if len(pieces) == 1:
            return node
        made += [gap] if gap else []
        made.append(node if node.op == "term" else Node("alts", (node,)))
    return Node("phrase", (), (tuple(made), None))


def _phrase(elements: tuple, options: Options) -> tuple:
    """Words next to each other are analyzed as one text; gaps add up, before the first word they drop."""
    out: list[Node | int] = []
    pending, run = 0, []

    def put(node: Node) -> None:
        nonlocal pending
        if out and pending:
            out.append(pending)
        pending = 0
        out.append(node)

    def flush() -> None:
        nonlocal pending
        if not run:
            return
        tokens, consumed = analyze(" ".join(run), options)
        run.clear()
        last = -1
        for t in tokens:
            pending += t.pos - last - 1
            put(term(t.text))
            last = t.pos
        pending += consumed - last - 1

    for e in elements:
        if isinstance(e, int):
            flush()
            pending += e
        elif e.op == "term":
            run.append(e.arg)
        else:
            flush()
            put(Node("alts", tuple(analyzed(k, options) for k in e.kids)))
    flush()
    return tuple(out)


def analyzed(node: Node, options: Options = DEFAULT) -> Node:
    """The written tree with its words as the index spells them."""
    op, arg = node.op, node.arg
    if op == "term":
        tokens, _ = analyze(arg, options)
        if len(tokens) == 1:
            return term(tokens[0].text)
        return Node("phrase", (), (tuple(_elements(tokens)), None)) if tokens else NONE
    if op == "fuzzy":
        tokens = _whole("fuzzy term", arg[0], options)
        if not tokens:
            return NONE
        last = Node("fuzzy", (), (tokens[-1].text, *arg[1:]))
        if len(tokens) == 1:
            return last
        return Node("phrase", (), ((*_elements(tokens)[:-1], Node("alts", (last,))), None))
    if op == "wild":
        return _wild(arg, options)
    if op == "range":
        low, high = (None if b is None else "".join(t.text for t in _whole("range bound", b, options)) for b in arg)
        if low == "" or high == "":
            raise QueryError("empty_bound", "a range bound has no word")
        return Node("range", (), (low, high))
    if op == "phrase":
        return Node("phrase", (), (_phrase(arg[0], options), arg[1]))
    return Node(op, tuple(analyzed(k, options) for k in node.kids), arg)


# lowering


def threshold(arg: tuple, n: int) -> int:
    unit, k = arg
    return n if unit == "all" else -(-k * n // 100) if unit == "%" else k


def as_span(node: Node) -> Node:
    """The node where positions count. A boost stays in the tree; it changes no interval."""
    op, arg = node.op, node.arg
    if op == "all":
        raise QueryError("all_in_span", "* has no positions")
    if op == "none":
        return Node("empty")
    if op == "regex":
        check_regex(arg)
    if op in LEAVES:
        return node
    if op == "phrase":
        kids: list[tuple[int, Node]] = []
        gap = 0
        for e in arg[0]:
            if isinstance(e, int):
                gap += e
            else:
                kids.append((gap if kids else 0, e if e.op == "term" else Node("or", tuple(map(as_span, e.kids)))))
                gap = 0
        if len(kids) < 2:
            return kids[0][1] if kids else Node("empty")
        flat, total = tuple(k for _, k in kids), sum(g for g, _ in kids)
        if not total:
            return Node("maxgaps", (Node("ordered", flat),), arg[1] or 0)
        if arg[1] is not None:
            return Node("gaps", (Node("ordered", flat),), (total, total + arg[1]))
        out = flat[0]
        for g, k in kids[1:]:
            out = Node("gaps", (Node("ordered", (out, k)),), (g, g))
        return out
    kids = tuple(map(as_span, node.kids))
    if op == "and":
        return Node("unordered", kids)
    if op in ("or", "alts"):
        return Node("or", kids)
    if op == "andnot":
        return Node("not_encloses", kids)
    if op == "atleast":
        return Node("atleast", kids, threshold(arg, len(kids)))
    if op in ("then", "near"):
        return Node("maxgaps", (Node("ordered" if op == "then" else "unordered", kids),), arg)
    if op == "within":
        return Node("width", kids, arg)
    assert op in RELATIONS or op in WINDOWS or op == "boost", op
    return Node(op, kids, arg)


def lower(node: Node) -> Node:
    op, arg = node.op, node.arg
    if op == "none":
        return NOTHING
    if op == "regex":
        check_regex(arg)
    if op in LEAVES or op == "all":
        return node
    if op == "phrase" and len(arg[0]) == 1 and isinstance(arg[0][0], Node) and arg[0][0].op == "term":
        return arg[0][0]
    if op in ("and", "or", "alts", "andnot", "atleast", "boost"):
        kids = tuple(map(lower, node.kids))
        if op == "and":
            return Node("and", kids)
        if op in ("or", "alts"):
            return Node("atleast", kids, 1)
        if op == "andnot":
            return Node("and", (kids[0], Node("not", kids[1:])))
        if op == "atleast":
            return Node("atleast", kids, threshold(arg, len(kids)))
        return Node("boost", kids, arg)
    return Node("span", (as_span(node),))


def _unique(kids: list[Node]) -> list[Node]:
    seen: set[Node] = set()
    return [k for k in kids if k.op != "term" or not (k in seen or seen.add(k))]


def simplify(node: Node, keep_repeats: bool = False) -> Node:
    """Flattens, folds what matches all or nothing, and (unless keep_repeats) drops repeated terms."""
    kids = [simplify(k, keep_repeats) for k in node.kids] if node.op != "span" else []
    if node.op == "not":
        inner = kids[0]
        return ALL if inner == NOTHING else NOTHING if inner == ALL else inner.kids[0] if inner.op == "not" else Node("not", (inner,))
    if node.op == "boost":
        return Node("boost", tuple(kids), node.arg)
    if node.op == "and":
        flat = [g for k in kids for g in (k.kids if k.op == "and" else (k,))]
        if NOTHING in flat:
            return NOTHING
        return _conjunction([k for k in flat if k != ALL] if keep_repeats else _unique([k for k in flat if k != ALL]))
    if node.op in ("atleast", "or"):
        least = 1 if node.op == "or" else node.arg
        flat = []
        for k in kids:
            if k == ALL and not keep_repeats:
                least -= 1
            elif k != NOTHING:
                flat += k.kids if least == 1 and k.op == "or" else (k,)
        if least <= 0:
            return ALL
        if least > len(flat):
            return NOTHING
        if least == 1 and not keep_repeats:
            flat = _unique(flat)
        if least == len(flat):
            return _conjunction(flat)
        return Node("or", tuple(flat)) if least == 1 else Node("atleast", tuple(flat), least)
    return node


def _conjunction(kids: list[Node]) -> Node:
    return ALL if not kids else kids[0] if len(kids) == 1 else Node("and", tuple(kids))


@lru_cache(4096)
def compile_query(text: str, options: Options = DEFAULT, keep_repeats: bool = False) -> Node:
    """Text to a lowered tree; keep_repeats: for scoring, which weighs every written occurrence."""
    return simplify(lower(analyzed(parse(text), options)), keep_repeats)
