"""Full-text conditions: tokens, phrases and a small query language.

    login error          either word
    login AND error      both; also OR, NOT, parentheses, +must, -must_not
    "disk is full"       the words in this order
    conn*                words that begin so
    level:error          the level;  ctx:key=value  a context entry

Everything becomes column expressions.  A term is first looked for as a plain
substring, which is cheap and never misses; only rows that have it are
tokenised.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

TOKEN = r"[\p{L}\p{N}]+"


class QuerySyntaxError(ValueError):
    pass


def search_text(message: Column, context: Column) -> Column:
    """Message and context values, by rising key, in lower case."""
    values = F.transform(F.array_sort(F.map_entries(context)), lambda e: e["value"])
    return F.lower(F.concat_ws(" ", message, F.coalesce(values, F.array().cast("array<string>"))))


def tokens(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(TOKEN), F.lit(0))


@dataclass(frozen=True)
class Fields:
    """Columns that a query looks at.  ``text`` is lower case."""

    text: Column
    level: Column | None = None
    context: Column | None = None


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def has_term(f: Fields, word: str) -> Column:
    return f.text.contains(word) & F.array_contains(tokens(f.text), word)


def has_phrase(f: Fields, words: list[str]) -> Column:
    joined = F.concat(F.lit(" "), F.array_join(tokens(f.text), " "), F.lit(" "))
    parts = [f.text.contains(w) for w in words]
    return reduce(Column.__and__, parts) & joined.contains(" " + " ".join(words) + " ")


def has_prefix(f: Fields, prefix: str) -> Column:
    return f.text.contains(prefix) & F.exists(tokens(f.text), lambda t: t.startswith(prefix))


def has_context(context: Column, key: str, value: str) -> Column:
    """A context entry, both sides compared without regard to case."""
    wanted = f"{key}={value}".lower()
    return F.exists(F.map_entries(context), lambda e: F.lower(F.concat(e["key"], F.lit("="), e["value"])) == wanted)


_LEX = re.compile(
    r"\s*(?:(?P<open>\()|(?P<close>\))|(?P<op>AND|OR|NOT)(?=[\s()]|$)|(?P<sign>[+-])(?=\S)"
    r"|(?P<field>level|ctx):(?:\"(?P<quoted_value>[^\"]*)\"|(?P<value>[^\s()]+))"
    r"|\"(?P<phrase>[^\"]*)\"|(?P<word>[^\s()\"]+))"
)


def _lex(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while query[at:].strip():
        m = _LEX.match(query, at)
        if not m:
            raise QuerySyntaxError(f"cannot read the query at {query[at:]!r}")
        kind = m.lastgroup
        if m["field"]:
            value = m["quoted_value"] if m["quoted_value"] is not None else m["value"]
            out.append(("field", f"{m['field']}:{value}"))
        else:
            out.append((kind, m[kind]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, query: str, fields: Fields):
        self.items, self.at, self.f = _lex(query), 0, fields

    def peek(self) -> tuple[str, str] | None:
        return self.items[self.at] if self.at < len(self.items) else None

    def next(self) -> tuple[str, str]:
        item = self.peek()
        if item is None:
            raise QuerySyntaxError("the query ends too early")
        self.at += 1
        return item

    def group(self, closing: bool) -> Column:
        """Clauses side by side: all musts, no must-nots, else any of the rest."""
        must, never, may = [], [], []
        while (item := self.peek()) and item[0] != "close":
            if item == ("op", "OR"):
                if not (must or never or may):
                    raise QuerySyntaxError("OR needs a left side")
                self.next()
                if self.peek() is None or self.peek()[0] == "close":
                    raise QuerySyntaxError("OR needs a right side")
                continue
            if item[0] == "sign":
                self.next()
                (must if item[1] == "+" else never).append(self.conjunction())
            else:
                may.append(self.conjunction())
        if closing != bool(self.peek()):
            raise QuerySyntaxError("parentheses do not match")
        if not (must or never or may):
            raise QuerySyntaxError("an empty group")
        parts = must + [~c for c in never]
        if may and not must:
            parts.append(reduce(Column.__or__, may))
        return reduce(Column.__and__, parts)

    def conjunction(self) -> Column:
        out = self.unary()
        while self.peek() == ("op", "AND"):
            self.next()
            out = out & self.unary()
        return out

    def unary(self) -> Column:
        kind, text = self.next()
        if (kind, text) == ("op", "NOT"):
            return ~self.unary()
        if kind == "open":
            out = self.group(True)
            self.next()
            return out
        if kind == "field":
            return self.field(text)
        if kind in ("word", "phrase"):
            if kind == "word" and text.endswith("*") and len(w := _words(text[:-1])) == 1:
                return has_prefix(self.f, w[0])
            words = _words(text)
            if not words:
                raise QuerySyntaxError(f"no word in {text!r}")
            return has_term(self.f, words[0]) if len(words) == 1 else has_phrase(self.f, words)
        raise QuerySyntaxError(f"unexpected {text!r}")

    def field(self, text: str) -> Column:
        name, _, value = text.partition(":")
        if name == "level" and self.f.level is not None:
            return F.lower(self.f.level) == value.lower()
        key, eq, wanted = value.partition("=")
        if name == "ctx" and self.f.context is not None and eq:
            return has_context(self.f.context, key, wanted)
        raise QuerySyntaxError(f"cannot use {text!r} here")


def matches(query: str | None, fields: Fields, strict: bool = True) -> Column | None:
    """Condition for a query; None if it is blank.

    A malformed query raises QuerySyntaxError, or with ``strict=False`` means
    no condition at all.
    """
    if query is None or not query.strip():
        return None
    try:
        parser = _Parser(query, fields)
        return F.coalesce(parser.group(False), F.lit(False))
    except QuerySyntaxError:
        if strict:
            raise
        return None


def message_like(message: Column, phrase: str | None) -> Column | None:
    """Substring of the message without regard to case; % and _ stay wildcards."""
    if phrase is None or not phrase.strip():
        return None
    pattern = phrase.strip().lower().replace("\\", "\\\\")
    return F.lower(message).like(f"%{pattern}%")
