"""Scanner: one token at a time, so that the parser can say what may come next."""

from __future__ import annotations

import re
from bisect import bisect_right

import regex

# Reserved words, and words that only some places reserve.
KEYWORDS = frozenset(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in "
    "instanceof new return super switch this throw try typeof var void while with null true false enum".split()
)
#: Words after which a slash begins a regular expression.
BEFORE_OPERAND = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())
# Punctuators, longest first.
PUNCTUATORS = sorted(
    "{ } ( ) [ ] ; , < > <= >= == != === !== + - * / % ** ++ -- << >> >>> & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= "
    ">>= >>>= &= |= ^= &&= ||= ??= => ... . @ #".split(),
    key=len, reverse=True,
)

_SPACE = regex.compile(r"(?:[\s﻿]|//[^\n\r  ]*|/\*[\s\S]*?\*/|<!--[^\n]*)+")
_NAME = regex.compile(r"(?:[\p{ID_Start}$_]|\\u\{?[0-9a-fA-F]+\}?)(?:[\p{ID_Continue}$‌‍]|\\u\{?[0-9a-fA-F]+\}?)*")
_NUMBER = regex.compile(r"0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?")
_STRING = regex.compile(r"'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*\"")
_REGEX = regex.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[\p{ID_Continue}$]*")
_PUNCT = regex.compile("|".join(regex.escape(p) for p in PUNCTUATORS))
#: What most tokens are: a name in ASCII that nothing else can continue, after a space at most.
_PLAIN = re.compile(r" ?([A-Za-z_$][A-Za-z0-9_$]*)(?=[ -#%-/:-@\[\]^`{-~\n])")
_BREAKS = re.compile("[\n\r\u2028\u2029]")
#: Tokens that a scanner remembers at most: the parser looks ahead and comes back.
REMEMBERED = 4096


class JsError(ValueError):
    """Text that the parser does not take, with its line."""


class Token:
    __slots__ = ("kind", "text", "start", "end", "line", "after_newline")

    def __init__(self, kind, text, start, end, line, after_newline):
        self.kind, self.text, self.start, self.end, self.line, self.after_newline = kind, text, start, end, line, after_newline


class Scanner:
    def __init__(self, source: str, line: int = 1):
        self.source = source
        self.first_line = line
        self._marks = [m.end() for m in re.finditer(r"\n", source)]
        self._known: dict[tuple[int, bool], Token] = {}

    def line_at(self, pos: int) -> int:
        return self.first_line + bisect_right(self._marks, pos)

    def token(self, pos: int, operand: bool) -> Token:
        """The token at pos. operand: a value may begin here, so a slash opens a regular expression."""
        found = self._known.get((pos, operand))
        if found is None:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            found = self._known[pos, operand] = self._token(pos, operand)
        return found

    def _token(self, pos: int, operand: bool) -> Token:
        s = self.source
        if m := _PLAIN.match(s, pos):
            text, start = m.group(1), m.start(1)
            return Token("keyword" if text in KEYWORDS else "name", text, start, m.end(1), self.line_at(start), False)
        start = pos
        if pos == 0 and s.startswith("#!"):
            start = (s.find("\n") + 1) or len(s)
        if (m := _SPACE.match(s, start)) is not None:
            start = m.end()
        newline = start > pos and _BREAKS.search(s, pos, start) is not None
        line = self.line_at(start)
        if start >= len(s):
            return Token("end", "", start, start, line, True)
        c = s[start]
        if m := _NAME.match(s, start):
            kind = "keyword" if m.group() in KEYWORDS else "name"
            return Token(kind, m.group(), start, m.end(), line, newline)
        if c == "#" and (m := _NAME.match(s, start + 1)):
            return Token("private", "#" + m.group(), start, m.end(), line, newline)
        if c.isdigit() or (c == "." and s[start + 1 : start + 2].isdigit()):
            m = _NUMBER.match(s, start)
            return Token("number", m.group(), start, m.end(), line, newline)
        if c in "'\"":
            if m := _STRING.match(s, start):
                return Token("string", m.group(), start, m.end(), line, newline)
            raise JsError(f"line {line}: the string does not end")
        if c == "`":
            return Token("template", "`", start, self.template_end(start), line, newline)
        if c == "/" and operand and (m := _REGEX.match(s, start)):
            return Token("regex", m.group(), start, m.end(), line, newline)
        if m := _PUNCT.match(s, start):
            text = m.group()
            if text == "?." and s[m.end() : m.end() + 1].isdigit():
                text = "?"
            return Token("punct", text, start, start + len(text), line, newline)
        raise JsError(f"line {line}: {c!r} begins no token")

    def template_parts(self, start: int) -> list[tuple[int, int]]:
        """Spans of the ${...} expressions of the template at start; the last span is the end itself."""
        s, pos, parts = self.source, start + 1, []
        while pos < len(s):
            c = s[pos]
            if c == "\\":
                pos += 2
            elif c == "`":
                return [*parts, (pos + 1, pos + 1)]
            elif s.startswith("${", pos):
                close = self._close(pos + 2)
                parts.append((pos + 2, close))
                pos = close + 1
            else:
                pos += 1
        raise JsError(f"line {self.line_at(start)}: the template does not end")

    def template_end(self, start: int) -> int:
        return self.template_parts(start)[-1][1]

    def _close(self, pos: int) -> int:
        """Place of the brace that closes an expression in a template."""
        depth, operand = 0, True
        while True:
            t = self.token(pos, operand)
            if t.kind == "end":
                raise JsError(f"line {t.line}: the template does not end")
            if t.kind == "punct":
                if t.text == "{":
                    depth += 1
                elif t.text == "}":
                    if not depth:
                        return t.start
                    depth -= 1
            operand = operand_after(t)
            pos = t.end


def operand_after(t: Token) -> bool:
    """Whether a value may begin after this token."""
    if t.kind == "punct":
        return t.text not in (")", "]", "}", "++", "--")
    if t.kind == "keyword":
        return t.text in BEFORE_OPERAND or t.text not in ("this", "super", "null", "true", "false")
    return t.kind == "name" and t.text in ("of", "yield", "await")
