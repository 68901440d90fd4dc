"""The algebra of intervals over the positions of one document.

A node's value is a list of (start, end, gaps), sorted, in which no interval contains another; gaps
counts the positions between the parts of the interval, None where that has no meaning. Values are
computed bottom up as whole lists, so shared parts of long chains cost no more than their sum."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import permutations

from ..plans.nodes import LEAVES, WINDOWS, Node

Span = tuple[int, int, int | None]


def minimal(spans: list[Span]) -> list[Span]:
    """Those that contain no other; of equal ones the first in the list."""
    out: list[Span] = []
    least = None
    # from the right: an interval stays if it ends before all that start at or after its start
    for _, s in sorted(enumerate(spans), key=lambda x: (-x[1][0], x[1][1], x[0])):
        if least is None or s[1] < least:
            out.append(s)
            least = s[1]
    return out[::-1]


def ordered(children: list[list[Span]]) -> list[Span]:
    """Minimal chains, each part after the end of the one before; gaps of the tightest chain."""
    if any(not c for c in children):
        return []
    *rest, last = children
    found: list[Span] = []
    ends = [[e for _, e, _ in c] for c in rest]
    for start, end, _ in last:
        used, left = end - start + 1, start
        for c, e in zip(reversed(rest), reversed(ends), strict=True):
            k = bisect_left(e, left) - 1  # the latest that ends before
            if k < 0:
                break
            left = c[k][0]
            used += c[k][1] - c[k][0] + 1
        else:
            found.append((left, end, end - left + 1 - used))
    return minimal(found)


def hulls(a: list[Span], b: list[Span]) -> list[Span]:
    """Minimal hulls of one interval of each; they may overlap."""
    found: list[Span] = []
    for x, y in ((a, b), (b, a)):
        ys, ye = [s for s, _, _ in y], [e for _, e, _ in y]
        for s, e, _ in x:
            k = bisect_left(ys, s)
            if k < len(y):  # the first that starts no earlier
                found.append((s, max(e, y[k][1]), None))
            k = bisect_right(ye, e)
            if k:  # the latest that ends no later
                found.append((min(s, y[k - 1][0]), e, None))
    return minimal(found)


def unordered(nodes: tuple[Node, ...], value: Callable[[Node], list[Span]]) -> list[Span]:
    """One interval of each child; children that are the same node take different intervals."""
    out: list[Span] | None = None
    for node in dict.fromkeys(nodes):
        spans, k = value(node), nodes.count(node)
        spans = [(spans[i][0], spans[i + k - 1][1], None) for i in range(len(spans) - k + 1)]
        out = minimal(spans) if out is None else hulls(out, spans)
    return out or []


def union(children: list[list[Span]]) -> list[Span]:
    return minimal([s for c in children for s in c])


def bounds(node: Node, length: int) -> tuple[int, int] | None:
    """First and last position of a window in a document of so many tokens."""
    if node.op == "between":
        low, high = node.arg
        return (max(low, 1) - 1, high - 1) if low <= high and high >= 1 else None
    if node.op == "middle":
        cut = -(-length * (100 - min(node.arg, 100)) // 200)
        return (cut, length - cut - 1) if length - 2 * cut > 0 else None
    unit, n = node.arg
    n = -(-length * min(n, 100) // 100) if unit == "%" else n
    if n == 0:
        return None
    return (0, n - 1) if node.op == "first" else (length - min(n, length), length - 1)


def evaluate(node: Node, positions: Callable[[Node], list[int]], length: int) -> list[Span]:
    """The intervals of a span tree; positions gives those of a leaf, sorted."""
    known: dict[Node, list[Span]] = {}

    def value(n: Node) -> list[Span]:
        got = known.get(n)
        if got is None:
            got = known[n] = compute(n)
        return got

    def filtered(n: Node, keep: Callable[[Span], bool]) -> list[Span]:
        return [s for s in value(n) if keep(s)]

    def compute(n: Node) -> list[Span]:
        op, kids, arg = n.op, n.kids, n.arg
        if op in LEAVES:
            return [(p, p, 0) for p in positions(n)]
        if op == "empty":
            return []
        if op == "boost":
            return value(kids[0])
        if op == "ordered":
            return ordered([value(k) for k in kids])
        if op == "unordered":
            return unordered(kids, value)
        if op == "or":
            return union([value(k) for k in kids])
        if op == "atleast":
            return at_least(arg, kids)
        if op == "maxgaps":
            inner = kids[0]
            if inner.op == "unordered":  # under a gap limit the parts don't overlap: any order of them
                spans = union([ordered([value(k) for k in p]) for p in dict.fromkeys(permutations(inner.kids))])
                return [s for s in spans if s[2] is not None and s[2] <= arg]
            return filtered(inner, lambda s: s[2] is not None and s[2] <= arg)
        if op == "gaps":
            return filtered(kids[0], lambda s: s[2] is not None and arg[0] <= s[2] <= arg[1])
        if op == "width":
            return filtered(kids[0], lambda s: s[1] - s[0] + 1 <= arg)
        if op in WINDOWS:
            window = bounds(n, length)
            return filtered(kids[0], lambda s: s[0] >= window[0] and s[1] <= window[1]) if window else []
        return related(op, value(kids[0]), value(kids[1]))

    def at_least(k: int, kids: tuple[Node, ...]) -> list[Span]:
        if k == 0 or k > len(kids):
            return []
        if k == 1:
            return union([value(x) for x in kids])
        if k == len(kids):
            return unordered(kids, value)
        from itertools import combinations

        return union([unordered(c, value) for c in combinations(kids, k)])

    return value(node)


def related(op: str, a: list[Span], b: list[Span]) -> list[Span]:
    """Intervals of a by their relation to those of b."""
    if op in ("before", "after"):
        if not b:
            return []
        return [s for s in a if (b[-1][0] > s[0] if op == "before" else b[0][0] < s[0])]
    starts, ends = [s for s, _, _ in b], [e for _, e, _ in b]

    def inside(s: Span) -> bool:  # some b lies in s: the first that starts in it ends first
        k = bisect_left(starts, s[0])
        return k < len(b) and ends[k] <= s[1]

    def around(s: Span) -> bool:  # some b holds s: the first that ends no earlier starts first
        k = bisect_left(ends, s[1])
        return k < len(b) and starts[k] <= s[0]

    def touching(s: Span) -> bool:
        k = bisect_left(ends, s[0])
        return k < len(b) and starts[k] <= s[1]

    test = {"encloses": inside, "enclosed_by": around, "overlapping": touching}[op.removeprefix("not_")]
    return [s for s in a if test(s) != op.startswith("not_")]
