"""The row filter language: `key op value` terms, `and`/`or` from left to right without precedence, parentheses.

A query compiles to one Column, so that Catalyst prunes and pushes it like any predicate.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = ("!~=", "~=", "!=", "=")
_MARKS = re.compile(r"(!~=|~=|!=|=|\(|\))")


def split_query(query: str) -> list[str]:
    return _MARKS.sub(r" \1 ", query).split()


class _Invalid(Exception):
    pass


def _read(tokens: list[str], at: int, depth: int) -> tuple[tuple, int]:
    """A nested tuple of terms and connectives from position `at`."""
    left, at = _term(tokens, at, depth)
    while at < len(tokens) and tokens[at] in ("and", "or"):
        word = tokens[at]
        if at + 1 >= len(tokens):
            raise ValueError(f"nothing follows {word!r}")
        right, at = _term(tokens, at + 1, depth)
        left = (word, left, right)
    return left, at


def _term(tokens: list[str], at: int, depth: int) -> tuple[tuple, int]:
    if at < len(tokens) and tokens[at] == "(":
        inner, at = _read(tokens, at + 1, depth + 1)
        if at >= len(tokens) or tokens[at] != ")":
            raise ValueError("a parenthesis is not closed")
        return inner, at + 1
    if len(tokens) - at < 3 or tokens[at + 1] not in OPERATORS:
        raise _Invalid
    return ("term", tokens[at], tokens[at + 1], tokens[at + 2]), at + 3


def parse(query: str) -> tuple | None:
    """The query's tree; None where it is no sentence of the language. Dangling `and`, `or` and parentheses are errors."""
    tokens = split_query(query)
    try:
        tree, at = _read(tokens, 0, 0)
    except _Invalid:
        return None
    if at < len(tokens):
        if tokens[at] == ")":
            raise ValueError("a parenthesis closes that was not opened")
        return None
    return tree


def references(query: str) -> list[str]:
    """Distinct column names that a query's terms name, in order."""
    tokens = split_query(query)
    return list(dict.fromkeys(tokens[i - 1] for i, t in enumerate(tokens) if t in OPERATORS and i))


def _column(tree: tuple, get) -> Column:
    if tree[0] == "term":
        _, key, op, value = tree
        cell = get(key)
        if op in ("=", "!="):
            return cell == value if op == "=" else cell != value
        inside = F.coalesce(cell, F.lit("")).contains(value)
        return inside if op == "~=" else ~inside
    a, b = _column(tree[1], get), _column(tree[2], get)
    return a & b if tree[0] == "and" else a | b


def compiled(query: str, columns: list[str]) -> Column:
    """The predicate over string casts of the named columns. No query keeps all; an invalid one or an unknown column none."""
    if not query.strip():
        return F.lit(True)
    tree = parse(query)
    if tree is None or any(k not in columns for k in references(query)):
        return F.lit(False)
    return _column(tree, lambda k: F.col(f"`{k}`").cast("string"))


def where(df: DataFrame, query: str) -> DataFrame:
    return df.filter(compiled(query, df.columns))


def matches_map(query: str, cells: Column) -> Column:
    """The query on one map of strings: with = and != a missing key fails, with ~= it is empty text."""
    if not query.strip():
        return F.lit(True)
    tree = parse(query)
    return F.lit(False) if tree is None else F.coalesce(_column(tree, lambda k: F.try_element_at(cells, F.lit(k))), F.lit(False))


def any_of(*parts: Column) -> Column:
    return reduce(lambda a, b: a | b, parts)
