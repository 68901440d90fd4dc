"""The query language: a recursive descent parser, used on the driver only."""

from __future__ import annotations

import re

from .nodes import ALL, MAX_BOOST, MAX_BYTES, MAX_DEPTH, MAX_INT, NONE, Node, QueryError, term

BLANK = " \t\r\n"
_WORD = re.compile(r'[^ \t\r\n()\[\]"~^]+')
_KEYWORDS = "AND OR NOT TO IN WITHIN THEN NEAR ALL AT MATCHES CONTAINS ENCLOSES ENCLOSED OVERLAPPING BEFORE AFTER".split()
_EDGE = re.compile(r'(?=[ \t\r\n()\[\]"/\\~^]|\Z)')
_BOUND = r'(?=[ \t\r\n()\[\]"/\\~^]|\Z)'
_RESERVED = re.compile("(?:" + "|".join(_KEYWORDS) + ")" + _BOUND)
_NUMBER = re.compile(r"[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_INT = re.compile("[0-9]+")
_FUZZY = re.compile("~([0-9]+)(?::([0-9]+))?")
_RELATION = [
    (("NOT", "ENCLOSES"), "not_encloses"),
    (("NOT", "ENCLOSED", "BY"), "not_enclosed_by"),
    (("NOT", "OVERLAPPING"), "not_overlapping"),
    (("ENCLOSES",), "encloses"),
    (("ENCLOSED", "BY"), "enclosed_by"),
    (("OVERLAPPING",), "overlapping"),
    (("BEFORE",), "before"),
    (("AFTER",), "after"),
]
_RELATION_WORDS = ("ENCLOSES", "ENCLOSED", "OVERLAPPING")


class _Parser:
    def __init__(self, text: str, implicit: str, base: int = 0) -> None:
        self.s, self.i, self.implicit, self.base = text, 0, implicit, base

    # characters
    def at(self, i: int) -> int:
        return self.base + len(self.s[:i].encode("utf-8", "surrogatepass"))

    def fail(self, expected: str, i: int | None = None) -> QueryError:
        i = self.i if i is None else i
        found = repr(self.s[i : i + 10]) if i < len(self.s) else "end of input"
        return QueryError("expected", f"expected {expected}, found {found}", self.at(i))

    def blank(self) -> int:
        start = self.i
        while self.i < len(self.s) and self.s[self.i] in BLANK:
            self.i += 1
        return self.i - start

    def peek(self, *words: str) -> int | None:
        """The place after these keywords, if they come next."""
        i = self.i
        for w in words:
            while i < len(self.s) and self.s[i] in BLANK:
                i += 1
            if not self.s.startswith(w, i) or not _EDGE.match(self.s, i + len(w)):
                return None
            i += len(w)
        return i

    def take(self, *words: str) -> bool:
        i = self.peek(*words)
        if i is not None:
            self.i = i
        return i is not None

    def number(self, text: str, i: int) -> int:
        if int(text) > MAX_INT:
            raise QueryError("number", f"number {text} is out of range", self.at(i))
        return int(text)

    def integer(self) -> int | None:
        save = self.i
        self.blank()
        m = _INT.match(self.s, self.i)
        if not m:
            self.i = save
            return None
        self.i = m.end()
        return self.number(m[0], m.start())

    # levels, loosest first
    def query(self) -> Node:
        out = self.disjunction(False)
        self.blank()
        if self.i < len(self.s):
            raise self.fail("end of query")
        return out

    def disjunction(self, listed: bool) -> Node:
        out = self.conjunction(listed)
        while self.take("OR"):
            out = Node("or", (out, self.conjunction(listed)))
        return out

    def conjunction(self, listed: bool) -> Node:
        out = self.exclusion()
        while True:
            if self.peek("AND") is not None:
                if self.peek("AND", "NOT") is not None:
                    return out
                self.take("AND")
                out = Node("and", (out, self.exclusion()))
            elif not listed and self.begins() and self.peek("OR") is None:
                out = Node(self.implicit, (out, self.exclusion()))
            else:
                return out

    def begins(self) -> bool:
        save = self.i
        self.blank()
        c = self.s[self.i : self.i + 1]
        self.i = save
        return bool(c) and c not in ")]:~^"

    def exclusion(self) -> Node:
        out = self.placed()
        while self.peek("AND", "NOT") is not None and all(self.peek("AND", "NOT", w) is None for w in _RELATION_WORDS):
            self.take("AND", "NOT")
            out = Node("andnot", (out, self.placed()))
        return out

    def placed(self) -> Node:
        out, save = self.relation(), self.i
        if not self.take("IN"):
            return out
        for word in ("FIRST", "LAST"):
            if self.take(word):
                spaced, n = self.blank(), self.integer()
                if spaced and n is not None:
                    if self.s.startswith("%", self.i):
                        self.i += 1
                        return Node(word.lower(), (out,), ("%", n))
                    if self.blank() and self.take("WORDS"):
                        return Node(word.lower(), (out,), ("n", n))
                self.i = save
                return out
        if self.take("MIDDLE"):
            spaced, n = self.blank(), self.integer()
            if spaced and n is not None and self.s.startswith("%", self.i):
                self.i += 1
                return Node("middle", (out,), n)
        elif self.take("WORDS"):
            low = self.integer()
            if low is not None and self.take("TO"):
                high = self.integer()
                if high is not None:
                    return Node("between", (out,), (low, high))
        self.i = save
        return out

    def relation(self) -> Node:
        out = self.near()
        for words, op in _RELATION:
            if self.take(*words):
                return Node(op, (out, self.near()))
        return out

    def near(self) -> Node:
        out = self.narrow()
        while True:
            for word in ("THEN", "NEAR"):
                i = self.peek(word)
                m = i is not None and re.compile("/([0-9]+)").match(self.s, i)
                if m:
                    self.i = m.end()
                    out = Node(word.lower(), (out, self.narrow()), self.number(m[1], m.start(1)))
                    break
            else:
                return out

    def narrow(self) -> Node:
        out, save = self.boosted(), self.i
        if self.take("WITHIN"):
            n = self.integer()
            if n is not None:
                return Node("within", (out,), n)
            self.i = save
        return out

    def boosted(self) -> Node:
        out, end = self.base_node(), self.i
        self.blank()
        if self.s.startswith("^", self.i):
            m = _NUMBER.match(self.s, self.i + 1)
            if m:
                if self.i != end:
                    raise self.fail("boost without space before it")
                factor = float(m[0])
                if not factor <= MAX_BOOST:
                    raise QueryError("boost", f"boost {m[0]} is out of range", self.at(m.start()))
                self.i = m.end()
                return Node("boost", (out,), factor)
        self.i = end
        return out

    # primaries
    def base_node(self) -> Node:
        self.blank()
        start = self.i
        c = self.s[start : start + 1]
        if c == "(":
            self.i += 1
            out = self.disjunction(False)
            self.blank()
            if not self.s.startswith(")", self.i):
                raise self.fail(")")
            self.i += 1
            return out
        if c == "[":
            return Node("alts", self.listed())
        if c == '"':
            return self.phrase()
        if self.take("ALL", "OF"):
            self.blank()
            if self.s.startswith("[", self.i):
                return Node("atleast", self.listed(), ("all", 0))
            self.i = start
        if self.take("AT", "LEAST"):
            n = self.integer()
            if n is not None:
                unit = "%" if self.s.startswith("%", self.i) else "n"
                self.i += unit == "%"
                if self.take("OF"):
                    self.blank()
                    if self.s.startswith("[", self.i):
                        return Node("atleast", self.listed(), (unit, n))
            self.i = start
        if self.take("MATCHES"):
            if self.blank():
                end = self.pattern(self.i)
                if end > self.i:
                    raw, self.i = self.s[self.i : end], end
                    return Node("regex", (), re.sub(r"\\([ \t\r\n\f])", r"\1", raw))
            self.i = start
        if self.take("CONTAINS"):
            if self.blank():
                return self.word()
            self.i = start
        return self.word()

    def word(self) -> Node:
        start = self.i
        m = _WORD.match(self.s, start)
        if not m:
            raise self.fail("a term")
        self.i = m.end()
        if self.blank() and self.take("TO") and self.blank():
            high = _WORD.match(self.s, self.i)
            if high:
                self.i = high.end()
                return Node("range", (), (self.bound(m), self.bound(high)))
        self.i = m.end()
        f = _FUZZY.match(self.s, self.i)
        if f:
            self.i = f.end()
            a = self.number(f[1], f.start(1))
            return Node("fuzzy", (), (m[0], a, self.number(f[2], f.start(2))) if f[2] else (m[0], 1, a))
        if _RESERVED.match(self.s, start):
            self.i = start
            raise self.fail("a term")
        return ALL if m[0] == "*" else classify(m[0])

    def bound(self, m: re.Match) -> str | None:
        if m[0] == "*":
            return None
        if classify(m[0]).op == "wild":
            raise QueryError("wildcard_bound", f"wildcard in range bound {m[0]!r}", self.at(m.start()))
        return m[0]

    def listed(self) -> tuple[Node, ...]:
        items = self.items()
        out: list[Node] = []
        for item in items:
            if item.op == "term" and "," in item.arg:
                pieces = [p for p in re.split(r"(?<![0-9]),|,(?![0-9])", item.arg) if p]
                out += [classify(p) for p in pieces] or [NONE]
            else:
                out.append(item)
        return tuple(out)

    def items(self) -> list[Node]:
        start = self.i
        self.i += 1
        out: list[Node] = []
        while True:
            self.blank()
            if self.s.startswith("]", self.i):
                self.i += 1
                break
            if self.i >= len(self.s):
                raise self.fail("]")
            out.append(self.disjunction(True))
        if not out:
            raise QueryError("empty_alternatives", "empty alternatives", self.at(start))
        return out

    def pattern(self, i: int) -> int:
        """Where a regular expression ends: at a blank or a bracket that it doesn't open."""

        def atom(i: int) -> int:
            c = self.s[i : i + 1]
            if not c:
                return i
            if c == "\\":
                return i + 2 if i + 1 < len(self.s) else i + 1
            if c == "(":
                k = i + 1
                while k < len(self.s) and self.s[k] != ")" and (n := atom(k)) > k:
                    k = n
                if self.s.startswith(")", k):
                    return k + 1
            if c == "[":
                m = re.compile(r"\[(?:\\.|[^\] \t\r\n\\])*\]", re.S).match(self.s, i)
                if m:
                    return m.end()
            return i if c in BLANK or c in ")]" else i + 1

        while (n := atom(i)) > i:
            i = n
        return i

    def phrase(self) -> Node:
        start = self.i
        m = re.compile(r'"((?:\\.|[^"\\])*)"(?:~([0-9]+))?', re.S).match(self.s, start)
        if not m:
            raise self.fail('closing "')
        self.i = m.end()
        slop = self.number(m[2], m.start(2)) if m[2] else None
        elements = self.elements(m[1], m.start(1), start)
        return Node("phrase", (), (tuple(elements), slop))

    def elements(self, body: str, offset: int, start: int) -> list[Node | int]:
        out: list[Node | int] = []
        part = re.compile(r"(?P<blank>[ \t\r\n]+)|(?P<gap>_+)|\[(?P<alts>(?:\\.|[^\]\\])*)\]|(?P<word>(?:\\.|[^ \t\r\n\[\]_\\])+)", re.S)
        i = 0
        while i < len(body):
            m = part.match(body, i)
            if not m:
                raise QueryError("expected", "expected valid phrase content", self.at(offset))
            i = m.end()
            if m["gap"]:
                out.append(len(m["gap"]))
            elif m["alts"] is not None:
                inner = _Parser(f"[{m['alts']}]", self.implicit, self.at(offset + m.start()))
                out.append(Node("alts", tuple(inner.items())))
            elif m["word"]:
                out.append(term(re.sub(r"\\(.)", r"\1", m["word"], flags=re.S)))
        if not out:
            raise QueryError("empty_phrase", "empty phrase", self.at(start))
        return out


def classify(word: str) -> Node:
    """A term, or a pattern where * or ? is not escaped. Parts: text, or '*' and '?' as 1-tuples."""
    parts: list[str | tuple[str]] = []
    for m in re.finditer(r"\\([*?])|([*?])|((?:\\(?![*?])|[^*?\\])+)", word):
        if m[2]:
            parts.append((m[2],))
        elif parts and isinstance(parts[-1], str):
            parts[-1] += m[1] or m[3]
        else:
            parts.append(m[1] or m[3])
    if any(isinstance(p, tuple) for p in parts):
        return Node("wild", (), tuple(parts))
    return term("".join(parts))


def depth(text: str) -> int:
    """Deepest nesting of ( and [ outside of quotes."""
    now = most = 0
    quoted = skip = False
    for c in text:
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "([":
            now += 1
            most = max(most, now)
        elif not quoted and c in ")]":
            now = max(0, now - 1)
    return most


def parse(text: str, implicit: str = "and") -> Node:
    """The written tree of a query; a blank one matches nothing."""
    if len(text.encode("utf-8", "surrogatepass")) > MAX_BYTES:
        raise QueryError("limit", f"query text exceeds {MAX_BYTES} bytes")
    if depth(text) > MAX_DEPTH:
        raise QueryError("limit", f"query nesting exceeds {MAX_DEPTH} levels")
    return _Parser(text, implicit).query() if text.strip(BLANK) else NONE
