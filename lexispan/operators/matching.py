"""Lowered queries as Columns over a document's terms array.

Boolean nodes, expansions over a document's own terms, phrases and two-word proximity are built-in
functions. The general algebra of intervals is an Arrow UDF over the positions of its leaves; it runs
only on rows that pass a necessary condition, which is built-in and comes first."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.analysis import token_count
from ..plans.nodes import LEAVES, Node, walk
from . import spans


def leaf_test(leaf: Node, t: Column) -> Column:
    """Whether term t fits a leaf."""
    if leaf.op == "term":
        return t == leaf.arg
    if leaf.op == "regex":
        return t.rlike(rf"\A(?:{leaf.arg})\z")
    if leaf.op == "range":
        low, high = leaf.arg
        tests = ([t >= low] if low is not None else []) + ([t <= high] if high is not None else [])
        return reduce(lambda a, b: a & b, tests, t.isNotNull())
    text, prefix, distance = leaf.arg
    p = min(prefix, len(text))
    rest = F.levenshtein(F.substring(t, p + 1, 1 << 30) if p else t, F.lit(text[p:]), distance) >= 0
    return F.startswith(t, F.lit(text[:p])) & rest if p else rest


def has(leaf: Node, terms: Column) -> Column:
    """Whether a document has a term that fits; never null."""
    if leaf.op == "term":
        return F.coalesce(F.array_contains(terms, leaf.arg), F.lit(False))
    return F.coalesce(F.exists(terms, lambda t: F.coalesce(leaf_test(leaf, t), F.lit(False))), F.lit(False))


def positions(leaf: Node, terms: Column) -> Column:
    at = F.transform(terms, lambda t, i: F.when(leaf_test(leaf, t), i))
    return F.filter(at, lambda i: i.isNotNull())


def required(node: Node, terms: Column) -> Column:
    """A necessary condition of a span tree, of its leaves alone."""
    op, kids = node.op, node.kids
    if op in LEAVES:
        return has(node, terms)
    if op == "empty":
        return F.lit(False)
    if op in ("ordered", "unordered", "encloses", "enclosed_by", "overlapping", "before", "after"):
        return reduce(lambda a, b: a & b, [required(k, terms) for k in kids])
    if op == "or":
        return reduce(lambda a, b: a | b, [required(k, terms) for k in kids], F.lit(False))
    if op == "atleast":
        return F.lit(True) if node.arg else F.lit(False)
    return required(kids[0], terms)


def _phrase(words: list[str], terms: Column) -> Column:
    """Whether terms follow each other: a search in all terms joined by spaces, which no term holds."""
    text = F.concat(F.lit(" "), F.array_join(terms, " ", "\0"), F.lit(" "))
    return F.contains(text, F.lit(f" {' '.join(words)} "))


def _close(a: Node, b: Node, terms: Column, near: int, in_order: bool) -> Column:
    """Whether leaf b is at most near places after leaf a, or before it: one pass, whatever the counts."""
    never = F.lit(-(1 << 30))
    at = F.struct(F.lit(0).alias("i"), never.alias("a"), never.alias("b"), F.lit(False).alias("hit"))

    def step(s: Column, t: Column) -> Column:
        is_a, is_b = (F.coalesce(leaf_test(k, t), F.lit(False)) for k in (a, b))
        hit = is_b & (s["i"] - s["a"] <= near)
        if not in_order:
            hit = hit | (is_a & (s["i"] - s["b"] <= near))
        last = lambda here, name: F.when(here, s["i"]).otherwise(s[name]).alias(name)
        return F.struct((s["i"] + 1).alias("i"), last(is_a, "a"), last(is_b, "b"), (s["hit"] | hit).alias("hit"))

    return F.aggregate(terms, at, step, lambda s: s["hit"])


def _native_span(root: Node, terms: Column) -> Column | None:
    """Exact phrases of terms, and THEN or NEAR of two leaves."""
    if root.op in LEAVES:
        return has(root, terms)
    if root.op != "maxgaps" or root.kids[0].op not in ("ordered", "unordered"):
        return None
    inner = root.kids[0]
    each = reduce(lambda a, b: a & b, [has(k, terms) for k in dict.fromkeys(inner.kids)], F.lit(True)) if all(k.op in LEAVES for k in inner.kids) else None
    if inner.op == "ordered" and root.arg == 0 and all(k.op == "term" for k in inner.kids):
        return each & _phrase([k.arg for k in inner.kids], terms)
    if len(inner.kids) == 2 and each is not None:
        return each & _close(*inner.kids, terms, root.arg + 1, inner.op == "ordered")
    return None


def is_native(node: Node) -> bool:
    """Whether a query is built-in functions alone."""
    return all(_native_span(n.kids[0], F.lit(None)) is not None for n in walk(node) if n.op == "span")


def span_column(root: Node, terms: Column, intervals: bool = False) -> Column:
    """Whether a span tree has an interval, or its intervals as an array of (s, e)."""
    if not intervals and (native := _native_span(root, terms)) is not None:
        return native
    leaves = list(dict.fromkeys(n for n in walk(root) if n.op in LEAVES))
    kind = "array<struct<s:int,e:int>>" if intervals else "boolean"

    @F.pandas_udf(kind)
    def solve(length: pd.Series, slots: pd.Series) -> pd.Series:
        out = []
        for n, at in zip(length, slots, strict=True):
            if at is None or n is None or n != n:
                out.append([] if intervals else False)
                continue
            own = dict(zip(leaves, at, strict=True))
            found = spans.evaluate(root, lambda leaf, own=own: list(map(int, own[leaf])), int(n))
            out.append([{"s": s, "e": e} for s, e, _ in found] if intervals else bool(found))
        return pd.Series(out)

    need = required(root, terms)
    slots = F.array(*[positions(leaf, terms) for leaf in leaves]) if leaves else F.array().cast("array<array<int>>")
    # rows that can't match send nothing to Python
    found = solve(F.when(need, token_count(terms)), F.when(need, slots))
    return found if intervals else need & found


def predicate(node: Node, terms: Column) -> Column:
    """Whether a document matches, without the rule that an empty one never does; never null."""
    op, kids = node.op, node.kids
    if op in LEAVES:
        return has(node, terms)
    if op == "all":
        return F.lit(True)
    if op == "not":
        return ~predicate(kids[0], terms)
    if op == "boost":
        return predicate(kids[0], terms)
    if op == "and":
        return reduce(lambda a, b: a & b, [predicate(k, terms) for k in kids])
    if op == "or":
        return reduce(lambda a, b: a | b, [predicate(k, terms) for k in kids])
    if op == "atleast":
        return reduce(lambda a, b: a + b, [predicate(k, terms).cast("int") for k in kids]) >= node.arg
    return span_column(kids[0], terms)


def matches(node: Node, terms: Column) -> Column:
    """Whether a document matches; null for a null document, false for one without terms."""
    return F.when(terms.isNull(), F.lit(None).cast("boolean")).otherwise(F.exists(terms, lambda t: t.isNotNull()) & predicate(node, terms))


def intervals(node: Node, terms: Column) -> Column:
    """The intervals of a query whose root is a span or a leaf."""
    root = node.kids[0] if node.op == "span" else node
    while root.op == "boost":
        root = root.kids[0]
    if root.op not in LEAVES and node.op != "span":
        raise ValueError("only a term or a positional query has intervals")
    return span_column(root, terms, True)


def holds(node: Node, terms: list[str | None]) -> bool:
    """The same predicate in Python, for query texts that come with the rows."""

    def fits(leaf: Node, t: str | None) -> bool:
        if t is None:
            return False
        if leaf.op == "term":
            return t == leaf.arg
        if leaf.op == "regex":
            return re.fullmatch(leaf.arg, t) is not None
        if leaf.op == "range":
            low, high = leaf.arg
            b = t.encode()
            return (low is None or low.encode() <= b) and (high is None or b <= high.encode())
        text, prefix, distance = leaf.arg
        p = min(prefix, len(text))
        return t[:p] == text[:p] and edits(t[p:], text[p:]) <= distance

    def test(n: Node) -> bool:
        if n.op in LEAVES:
            return any(fits(n, t) for t in terms)
        if n.op == "all":
            return True
        if n.op == "not":
            return not test(n.kids[0])
        if n.op == "boost":
            return test(n.kids[0])
        if n.op == "and":
            return all(map(test, n.kids))
        if n.op == "or":
            return any(map(test, n.kids))
        if n.op == "atleast":
            return sum(map(test, n.kids)) >= n.arg
        at = lambda leaf: [i for i, t in enumerate(terms) if fits(leaf, t)]
        return bool(spans.evaluate(n.kids[0], at, sum(t is not None for t in terms)))

    return any(t is not None for t in terms) and test(node)


_BOTH = ("and", "ordered", "unordered", "encloses", "enclosed_by", "overlapping", "before", "after")


def anchors(node: Node) -> frozenset[str] | None:
    """Terms of which every matching document has one; None where there are no such terms."""
    op, kids = node.op, node.kids
    if op == "term":
        return frozenset([node.arg])
    if op in _BOTH:
        some = [a for a in map(anchors, kids) if a is not None]
        return min(some, key=len) if some else None
    if op in ("or", "atleast") and kids and (op == "or" or node.arg >= 1):
        each = [anchors(k) for k in kids]
        return None if None in each else frozenset().union(*each)
    if op in LEAVES or op in ("all", "not", "or", "atleast") or not kids:
        return None
    return anchors(kids[0])


def _literal(leaf: Node) -> str | None:
    """Text that every term of a leaf holds."""
    if leaf.op == "term":
        return leaf.arg
    if leaf.op == "regex":
        pieces = re.split(r"\.\*|\.", leaf.arg)
        return max(pieces, key=len) or None if all(p.isalnum() or not p for p in pieces) else None
    if leaf.op == "fuzzy":
        text, prefix, _ = leaf.arg
        return text[:prefix] or None
    return None


def clauses(node: Node) -> list[frozenset[str]]:
    """Sets of texts; the terms of every matching document hold one of each set."""
    op, kids = node.op, node.kids
    if op in LEAVES:
        text = _literal(node)
        return [frozenset([text])] if text else []
    if op in _BOTH or op == "atleast" and node.arg == len(kids) > 0:
        return list(dict.fromkeys(c for k in kids for c in clauses(k)))
    if op in ("or", "atleast"):
        if not kids or op == "atleast" and node.arg < 1:
            return []
        each = [min(clauses(k), key=len, default=None) for k in kids]
        return [] if None in each else [frozenset().union(*each)]
    return clauses(kids[0]) if kids and op != "not" else []


def needed(node: Node) -> Callable[[Column], Column] | None:
    """A necessary condition of a document's folded text."""
    found = clauses(node)
    if not found:
        return None
    return lambda text: reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in sorted(c)]) for c in found])


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]
