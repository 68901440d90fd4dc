"""One immutable tree for written queries and for what they are lowered to."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

MAX_INT = 2**32 - 1
MAX_BYTES = 2048
MAX_DEPTH = 64
MAX_BOOST = 10_000.0


class QueryError(ValueError):
    """A query that can't be used; kind tells why, pos is a byte offset where there is one."""

    def __init__(self, kind: str, message: str, pos: int | None = None) -> None:
        super().__init__(message if pos is None else f"{message} at byte {pos}")
        self.kind, self.pos = kind, pos


@dataclass(frozen=True)
class Node:
    """op names the node, kids are its operands in order, arg what else it holds.

    Written: term text | all | none | fuzzy (text, prefix, distance) | wild (parts) | regex pattern |
    range (low, high; None is open) | phrase ((elements), slop) | alts | atleast ('n' or '%' or 'all',
    number) | and | or | andnot | then n | near n | one of RELATIONS | first, last ('n' or '%', number) |
    middle n | between (a, b) | within n | boost f.
    Phrase elements: a Node for a word or for alts, an int for a gap.
    Lowered: the leaves, and, or (n-ary), atleast k, not, boost, span; inside a span: empty, leaves,
    ordered, unordered, or, atleast k, maxgaps n, gaps (a, b), width n, the windows, and RELATIONS."""

    op: str
    kids: tuple[Node, ...] = ()
    arg: Any = None


RELATIONS = {
    "encloses": "ENCLOSES",
    "not_encloses": "NOT ENCLOSES",
    "enclosed_by": "ENCLOSED BY",
    "not_enclosed_by": "NOT ENCLOSED BY",
    "overlapping": "OVERLAPPING",
    "not_overlapping": "NOT OVERLAPPING",
    "before": "BEFORE",
    "after": "AFTER",
}
WINDOWS = ("first", "last", "middle", "between")
LEAVES = ("term", "regex", "range", "fuzzy")
NONE = Node("none")
ALL = Node("all")


def term(text: str) -> Node:
    return Node("term", (), text)


def walk(node: Node):
    yield node
    for kid in node.kids:
        yield from walk(kid)
    if node.op == "phrase":
        for e in node.arg[0]:
            if isinstance(e, Node):
                yield from walk(e)
