r"""Assignments in source and configuration text: which names are given which literals.

A lexer walks over a text and tells comments, strings, names and brackets apart:

* ``name = value``, ``name: value``, ``name := value``, ``name => value``, ``name: type = value``, a
  quoted name, ``name["item"] = value``; the value is one or more literals side by side or joined by
  ``+``, in parentheses over several lines or not, a bare word, or the name of a constant;
* ``name("literal", ...)``: a call gives its first literals to its name, so ``setKey("...")`` counts;
* ``name: |`` and ``name: >``, whose indented lines are the value;
* ``<name>value</name>``, attributes, and the pair of attributes ``key``/``name`` and ``value``.

Strings are in single, double, triple or back quotes; a quote right after a letter is an apostrophe.
Comments run from ``#`` or ``//`` after white space or a bracket to the line's end, and from ``/*`` or
``<!--`` to their ends or the text's. What is inside strings and comments is lexed too, each on its own, so that a
connection string or a line commented out is seen, but defines no constant outside.

Braces open scopes. A constant is looked for in the scope of its use and those around it: the last
one defined before, else the first one after. Constants of constants are followed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass, field

Place = tuple[int, int]

_NAME = r"(?<![A-Za-z0-9_.-])[A-Za-z_][A-Za-z0-9_.-]*+"
#: Opening quotes, with the letters that may stand before them.
_QUOTED = r"(?:(?<![A-Za-z0-9_])(?:[bBfFrRuU]{1,2}(?=[\"']))?)"
_STRING = rf"""{_QUOTED}(?:\"{{3}}(?P<s1>(?:[^\\]|\\.)*?)\"{{3}}|'{{3}}(?P<s2>(?:[^\\]|\\.)*?)'{{3}}|"(?P<s3>(?:[^"\\\n]|\\.)*+)"|'(?P<s4>(?:[^'\\\n]|\\.)*+)'|`(?P<s5>(?:[^`\\\n]|\\.)*+)`)"""
_COMMENT = r"(?<![^\s;,(){}])(?:\#|//)(?P<c1>[^\n]*)|/\*(?P<c2>.*?)(?:\*/|\Z)|<!--(?P<c3>.*?)(?:-->|\Z)"
_TYPE = r"(?:[ \t]*+:[ \t]*+[A-Za-z_][A-Za-z0-9_.\[\], ]*+(?==[^=]))?"
_ASSIGN = rf"""(?P<quote>["'`]?)(?P<name>{_NAME})(?P=quote)(?:\[["'](?P<item>{_NAME})["']\])?{_TYPE}[ \t]*+(?P<op>=>|:=|=(?![=~])|:(?!//|:))"""
_TOKEN = re.compile(rf"""{_COMMENT}|{_ASSIGN}|(?P<call>{_NAME})\((?=[ \t]*[bBfFrRuU]{{0,2}}["'`])|{_STRING}|<(?P<tag>[A-Za-z_][A-Za-z0-9_.:-]*+)(?P<attributes>[^<>]*+)>|(?P<brace>[{{}}])""", re.S)
_LITERAL = re.compile(_STRING, re.S)
_BARE = re.compile(r"[A-Za-z0-9+/_.=~!@#$%^&*-]+")
_WHOLE_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*")
_BLOCK = re.compile(r"[ \t]*[|>][+-]?[ \t]*\n")
_LINE = re.compile(r"([ \t]*)([^\n]*)\n?")
_BODY = re.compile(r"([^<>\n]+)</")
_BLANKS, _WHITE = re.compile(r"[ \t]*"), re.compile(r"\s*")
#: Strings and comments inside each other are lexed so deep.
DEPTH = 3


@dataclass
class Assignment:
    """name: the target. places: its literals. ref: the bare name that it is set to, instead."""

    name: str
    places: list[Place]
    ref: str | None = None
    scope: int = 0


@dataclass
class Lexed:
    assignments: list[Assignment] = field(default_factory=list)
    #: The scope around each scope.
    around: list[int] = field(default_factory=lambda: [-1])

    def resolved(self) -> list[tuple[str, list[Place]]]:
        """Names and the literals that they are given, constants followed."""
        defined: dict[tuple[str, int], list[int]] = defaultdict(list)
        names = set()
        for k, a in enumerate(self.assignments):
            defined[a.name, a.scope].append(k)
            names.add(a.name)

        def find(ref: str, k: int) -> int | None:
            scope, before, after = self.assignments[k].scope, None, None
            while scope >= 0:
                at = defined.get((ref, scope))
                if at:
                    i = bisect_left(at, k)
                    if i and (before is None or at[i - 1] > before):
                        before = at[i - 1]
                    later = [x for x in at[i : i + 2] if x != k]
                    if later and (after is None or later[0] < after):
                        after = later[0]
                scope = self.around[scope]
            return after if before is None else before

        out = []
        for k, a in enumerate(self.assignments):
            places, seen = a.places, {k}
            at, ref = k, a.ref
            while ref in names and (at := find(ref, at)) is not None and at not in seen:
                seen.add(at)
                places, ref = self.assignments[at].places, self.assignments[at].ref
            out.append((a.name, places))
        return out


def _content(m: re.Match) -> Place:
    return next(m.span(g) for g in ("s1", "s2", "s3", "s4", "s5") if m[g] is not None)


def _literals(text: str, at: int, end: int) -> tuple[list[Place], int]:
    """Literals side by side or joined by +, from a place on; in parentheses they may stand on several lines. Where they end."""
    found, m = [], _BLANKS.match(text, at, end)
    gap = _BLANKS
    if text[m.end() : m.end() + 1] == "(":
        gap, m = _WHITE, _WHITE.match(text, m.end() + 1, end)
    at = m.end()
    while m := _LITERAL.match(text, at, end):
        found.append(_content(m))
        at = m.end()
        after = gap.match(text, at, end).end()
        if text[after : after + 1] == "+":
            after = _WHITE.match(text, after + 1, end).end()
        if not _LITERAL.match(text, after, end):
            break
        at = after
    return found, at


def _block(text: str, at: int, end: int, key: int) -> tuple[list[Place], int]:
    """The lines of a block that are indented further than its key, without their indent."""
    line = text.rfind("\n", 0, key) + 1
    indent, found = len(text[line:key]) - len(text[line:key].lstrip(" \t")), []
    while at < end and (m := _LINE.match(text, at, end)) and m.end() > at:
        if m[2].strip():
            if len(m[1]) <= indent:
                break
            found.append((m.start(2), m.start(2) + len(m[2].rstrip())))
        at = m.end()
    return found, at


def lex(text: str) -> list[tuple[str, list[Place]]]:
    """Names and the places of the literals that they are given, in the order of the text."""
    out: list[tuple[str, list[Place]]] = []
    todo = [(0, len(text), 0)]
    while todo:
        low, high, depth = todo.pop()
        found, inner = _lex(text, low, high)
        out += found.resolved()
        if depth < DEPTH:
            todo += [(a, b, depth + 1) for a, b in inner if b - a > 3]
    return out


def _lex(text: str, at: int, end: int) -> tuple[Lexed, list[Place]]:
    out, scope, inner = Lexed(), 0, []
    put = lambda *a: out.assignments.append(Assignment(*a, scope=scope))
    while m := _TOKEN.search(text, at, end):
        at = m.end()
        if m["op"]:
            name = f"{m['name']}.{m['item']}" if m["item"] else m["name"]
            if m["op"] == ":" and (b := _BLOCK.match(text, at, end)):
                places, at = _block(text, b.end(), end, m.start())
                put(name, places)
                continue
            places, after = _literals(text, at, end)
            if places:
                put(name, places)
                inner += places
                at = after
            elif bare := _BARE.match(text, _BLANKS.match(text, at, end).end(), end):
                if text[bare.end() : bare.end() + 1] in ("(", "["):  # the result of a call, or an item
                    at = bare.start()
                    continue
                put(name, [bare.span()], bare[0] if _WHOLE_NAME.fullmatch(bare[0]) else None)
                at = bare.end()
        elif m["call"]:
            places, at = _literals(text, at, end)
            put(m["call"], places)
            inner += places
        elif m["tag"]:
            pairs = [(a["name"], _content(v)) for a in re.finditer(rf"(?P<name>{_NAME})[ \t]*=[ \t]*", text[m.start("attributes") : m.end("attributes")]) if (v := _LITERAL.match(text, m.start("attributes") + a.end(), m.end("attributes")))]
            of = {n.lower(): p for n, p in pairs}
            for n, p in pairs:
                put(n, [p])
            if key := of.get("key") or of.get("name"):
                if value := of.get("value"):
                    put(text[key[0] : key[1]], [value])
            if (b := _BODY.match(text, at, end)) and text.startswith(m["tag"], b.end()):
                put(m["tag"], [b.span(1)])
                at = b.end()
        elif m["brace"] == "{":
            out.around.append(scope)
            scope = len(out.around) - 1
        elif m["brace"] == "}":
            scope = max(0, out.around[scope])
        else:
            part = next((m.span(g) for g in ("c1", "c2", "c3") if m[g] is not None), None)
            inner.append(part or _content(m))
    return out, inner
