"""Patterns over syntax trees. ``find(pattern, tree)`` gives the parts that a pattern names, or None.

A pattern is a function from (value, parts found so far) to parts or None, so patterns are put together freely.
"""

from __future__ import annotations

from collections.abc import Callable

from codeloom.jsast.parse import Node

Parts = dict
Pattern = Callable[[object, Parts], Parts | None]


def part(name: str) -> Pattern:
    """Any node, under a name."""
    return lambda value, parts: None if value is None else {**parts, name: value}


def absent(value, parts: Parts) -> Parts | None:
    return parts if not value else None


def variable(name: str) -> Pattern:
    """An identifier; where the name was met before, the same identifier."""

    def match(value, parts: Parts) -> Parts | None:
        if not isinstance(value, Node) or value.kind != "Identifier":
            return None
        spelled = value.fields["name"]
        return {**parts, name: spelled} if parts.get(name, spelled) == spelled else None

    return match


def word(name: str, *spellings: str) -> Pattern:
    """An identifier with one of some spellings."""

    def match(value, parts: Parts) -> Parts | None:
        found = variable(name)(value, parts)
        return found if found and found[name] in spellings else None

    return match


def node(*kinds: str, **fields: Pattern) -> Pattern:
    def match(value, parts: Parts | None) -> Parts | None:
        if not isinstance(value, Node) or value.kind not in kinds:
            return None
        for field, pattern in fields.items():
            parts = pattern(value.fields.get(field), parts)
            if parts is None:
                return None
        return parts

    return match


def only(pattern: Pattern) -> Pattern:
    """A list of one."""
    return lambda value, parts: pattern(value[0], parts) if isinstance(value, list) and len(value) == 1 else None


def either(*patterns: Pattern) -> Pattern:
    return lambda value, parts: next((p for p in (x(value, parts) for x in patterns) if p is not None), None)


def alone(pattern: Pattern) -> Pattern:
    """A statement by itself or as all there is in a block."""
    return either(node("BlockStatement", body=only(pattern)), pattern)


def in_turn(*patterns: Pattern) -> Pattern:
    """A list that the patterns match one by one."""

    def match(value, parts: Parts | None) -> Parts | None:
        if len(value) != len(patterns):
            return None
        for pattern, v in zip(patterns, value, strict=True):
            parts = pattern(v, parts)
            if parts is None:
                return None
        return parts

    return match


def find(pattern: Pattern, value) -> Parts | None:
    return pattern(value, {})
