"""Identifiers of Java source text with their package, type and method.

A lexer with brace tracking, not a parser: comments, strings and numbers are skipped;
what is a method follows from the shape ``name ( ... )`` at the level of a type's body.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|(?<![\w$])\.?\d[\w.]*|(?P<id>[^\W\d][\w$]*|\$[\w$]*)|(?P<p>->|::|[{}()\[\];,.=@<>?:])|\S""",
)
_KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends false final finally float for goto if implements import instanceof int interface long native new null package private protected public return short static strictfp super switch synchronized this throw throws transient true try void volatile while".split()
)
SCHEMA = "source_name string, pos int, package string, type string, method string, is_ctor boolean, identifier string, error string"


def _opened(tokens: list[str]) -> dict[int, int]:
    """Partner of each parenthesis, both ways."""
    stack, out = [], {}
    for i, t in enumerate(tokens):
        if t == "(":
            stack.append(i)
        elif t == ")" and stack:
            j = stack.pop()
            out[i], out[j] = j, i
    return out


def _creates(tokens: list[str], at: int) -> bool:
    """Whether the parenthesis at ``at`` belongs to ``new Type(``."""
    i, angle = at - 1, 0
    while i >= 0:
        t = tokens[i]
        if t == ">":
            angle += 1
        elif t == "<":
            angle -= 1
        elif t == "new":
            return True
        elif not (angle or t == "." or t not in _KEYWORDS and (t[0].isalpha() or t[0] in "_$")):
            return False
        i -= 1
    return False


def identifiers(text: str) -> list[tuple[int, str, str | None, str | None, bool, str]]:
    """(pos, package, type, method, is_ctor, identifier) of each identifier, in order; type and method are null outside of them."""
    tokens = [m.group() for m in _TOKEN.finditer(text) if m.lastgroup]
    pair = _opened(tokens)
    package, n = "", len(tokens)
    if "package" in tokens[:50]:
        i = tokens.index("package") + 1
        while i < n and tokens[i] != ";":
            package += tokens[i]
            i += 1
    owner: list[tuple[str | None, str | None, bool] | None] = [None] * n
    # scopes: (kind, name, constructor); kinds type, enum and anonymous have members
    scopes: list[tuple[str, str | None, bool]] = []
    pending: tuple[str, str | None, bool] | None = None
    begin, value, i = 0, False, 0

    def here() -> tuple[str | None, str | None, bool] | None:
        typ = next((s[1] for s in reversed(scopes) if s[0] == "type"), None)
        for k in range(len(scopes) - 1, -1, -1):
            if scopes[k][0] == "method":
                typ = next((s[1] for s in reversed(scopes[:k]) if s[0] == "type"), None)
                return typ, scopes[k][1], scopes[k][2]
        return (typ, None, False) if typ else None

    while i < n:
        t = tokens[i]
        level = not scopes or scopes[-1][0] in ("type", "enum", "anonymous")
        owner[i] = here()
        if t in ("class", "interface", "enum") and (i == 0 or tokens[i - 1] != ".") and i + 1 < n and tokens[i + 1] not in _KEYWORDS and tokens[i + 1] not in "{}();,.":
            pending = ("enum" if t == "enum" else "type", None if t == "enum" else tokens[i + 1], False)
        elif t == "{":
            if pending:
                scopes.append(pending)
                pending = None
            elif i and tokens[i - 1] == ")" and _creates(tokens, pair.get(i - 1, 0)):
                scopes.append(("anonymous", None, False))
            elif scopes and scopes[-1][0] == "enum" and not value and i and tokens[i - 1] != "static" and tokens[i - 1] not in "};":
                scopes.append(("anonymous", None, False))
            else:
                scopes.append(("block", None, False))
            begin, value = i + 1, False
        elif t == "}":
            if scopes:
                scopes.pop()
            begin = i + 1
            value = bool(i + 1 < n and tokens[i + 1] in (";", ",", ")", "."))
        elif t == ";":
            begin, value = i + 1, False
        elif t == "=" and level:
            value = True
        elif t == "(" and level and scopes and not value and not pending and i and i in pair:
            name, close = tokens[i - 1], pair[i]
            after = tokens[close + 1] if close + 1 < n else ""
            while after == "[" and close + 2 < n:
                close += 2
                after = tokens[close + 1] if close + 1 < n else ""
            before = tokens[i - 2] if i > 1 else ""
            if name not in _KEYWORDS and (name[0].isalpha() or name[0] in "_$") and before not in ("new", ".", "@") and after in ("{", ";", "throws", "default"):
                constant = scopes[-1][0] == "enum" and begin == i - 1 and after != "throws"
                typ = next((s[1] for s in reversed(scopes) if s[0] == "type"), None)
                if not constant or typ == name:
                    mark = (typ, name, name == scopes[-1][1])
                    end = close
                    while end + 1 < n and tokens[end + 1] not in "{;":
                        end += 1
                    for k in range(begin, min(end + 1, n)):
                        owner[k] = mark
                    i = end
                    if end + 1 < n and tokens[end + 1] == "{":
                        pending = ("method", name, mark[2])
        i += 1
    out = []
    for i, t in enumerate(tokens):
        if t not in _KEYWORDS and (t[0].isalpha() or t[0] in "_$"):
            typ, method, ctor = owner[i] or (None, None, False)
            out.append((i, package, typ, method, ctor, t))
    return out


def java_identifiers(sources: DataFrame, name_col: str = "source_name", content_col: str = "content", scanner: Callable[[str], list[tuple]] = identifiers) -> DataFrame:
    """One row per identifier (see SCHEMA), as ``scanner`` finds them. A file that fails gives one row with ``error``; a null text gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["source_name", "pos", "package", "type", "method", "is_ctor", "identifier", "error"]
        for pdf in batches:
            rows = []
            for name, text in zip(pdf["_name"], pdf["_text"]):
                try:
                    rows += [(name, *r, None) for r in scanner(text)]
                except Exception as e:  # noqa: BLE001 - one bad file must not end the scan
                    rows.append((name, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=cols)

    picked = sources.select(F.col(name_col).cast("string").alias("_name"), F.col(content_col).alias("_text")).where("_text IS NOT NULL")
    return picked.mapInPandas(run, SCHEMA)
