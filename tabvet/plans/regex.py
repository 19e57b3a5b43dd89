"""Python patterns as Java patterns of the same meaning (V7).

Python's own parser reads the pattern; the parsed tree is written out in Java's syntax. So what the
two dialects spell alike but read differently comes out right: brackets inside classes, ``$`` and ``.`` at line ends,
Unicode ``\\d``, ``\\w``, ``\\s`` and ``\\b``, named groups, octal escapes, verbose layout. What Java cannot
express is refused when the rules are loaded.
"""

from __future__ import annotations

import re
from re import _constants as c
from re import _parser as parser

from tabvet.functions.text import PY_WHITESPACE


class PatternError(ValueError):
    """A pattern that isn't Python's, or that Java can't express."""


def _char(code: int) -> str:
    text = chr(code)
    return text if text.isascii() and text.isalnum() else "\\x{%x}" % code


_SPACES = "".join(map(_char, map(ord, PY_WHITESPACE)))
# Bodies of character classes: (Unicode, ASCII)
_CLASSES = {"DIGIT": (r"\p{Nd}", "0-9"), "SPACE": (_SPACES, r" \t\n\r\f\x0b"), "WORD": (r"\p{L}\p{N}_", "a-zA-Z0-9_")}


class _Writer:
    def __init__(self, flags: int):
        self.flags = flags

    def category(self, op) -> str:
        """The inside of a class for a category, nested and negated where needed."""
        name = str(op).removeprefix("CATEGORY_")
        body = _CLASSES[name.removeprefix("NOT_")][bool(self.flags & re.ASCII)]
        return f"[^{body}]" if name.startswith("NOT_") else f"[{body}]"

    def tree(self, items) -> str:
        return "".join(self.item(op, value) for op, value in items)

    def item(self, op, value) -> str:
        if op is c.LITERAL:
            return _char(value)
        if op is c.NOT_LITERAL:
            return f"[^{_char(value)}]"
        if op is c.ANY:
            return r"[\x{0}-\x{10ffff}]" if self.flags & re.DOTALL else r"[^\n]"
        if op is c.IN:
            return self.one_of(value)
        if op is c.BRANCH:
            return "(?:" + "|".join(self.tree(x) for x in value[1]) + ")"
        if op is c.SUBPATTERN:
            return self.group(*value)
        if op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
            low, high, body = value
            times = f"{{{low},{'' if high is c.MAXREPEAT else high}}}"
            return f"(?:{self.tree(body)}){times}{ {c.MAX_REPEAT: '', c.MIN_REPEAT: '?', c.POSSESSIVE_REPEAT: '+'}[op]}"
        if op is c.ATOMIC_GROUP:
            return f"(?>{self.tree(value)})"
        if op is c.GROUPREF:
            return f"(?:\\{value})"
        if op in (c.ASSERT, c.ASSERT_NOT):
            side, body = value
            return f"(?{'' if side > 0 else '<'}{'=' if op is c.ASSERT else '!'}{self.tree(body)})"
        if op is c.AT:
            return self.place(value)
        raise PatternError(f"{str(op).lower()} can't be written in Java's dialect")

    def one_of(self, items) -> str:
        negate = bool(items) and items[0][0] is c.NEGATE
        out = []
        for op, value in items[negate:]:
            if op is c.LITERAL:
                out.append(_char(value))
            elif op is c.RANGE:
                out.append(f"{_char(value[0])}-{_char(value[1])}")
            elif op is c.CATEGORY:
                out.append(self.category(value))
            else:
                raise PatternError(f"{str(op).lower()} in a class can't be written in Java's dialect")
        return f"[{'^' if negate else ''}{''.join(out)}]" if not (negate and len(out) > 1) else "[^" + "[" + "".join(out) + "]]"

    def group(self, number, add, drop, body) -> str:
        kept, self.flags = self.flags, (self.flags | add) & ~drop
        text = self.tree(body)
        on, off = ("iu" if add & re.IGNORECASE else ""), ("i" if drop & re.IGNORECASE else "")
        self.flags = kept
        if number is not None:
            return f"({text})"
        return f"(?{on}{'-' + off if off else ''}:{text})"

    def place(self, at) -> str:
        word = _CLASSES["WORD"][bool(self.flags & re.ASCII)]
        many = self.flags & re.MULTILINE
        boundary = f"(?:(?<=[{word}])(?![{word}])|(?<![{word}])(?=[{word}]))"
        places = {c.AT_BEGINNING: r"(?<![^\n])" if many else r"\A", c.AT_BEGINNING_STRING: r"\A", c.AT_END: r"(?=\n|\z)" if many else r"(?=\n?\z)",
                  c.AT_END_STRING: r"\z", c.AT_BOUNDARY: boundary, c.AT_NON_BOUNDARY: f"(?!{boundary})"}
        return places[at]


def python_regex_to_java(pattern: str) -> str:
    """A Java pattern that finds what Python's ``re`` finds."""
    try:
        re.compile(pattern)  # checks more than the parser does
        tree = parser.parse(pattern)
    except re.error as exc:
        raise PatternError(str(exc)) from exc
    text = _Writer(tree.state.flags).tree(tree)
    return f"(?iu:{text})" if tree.state.flags & re.IGNORECASE else text
