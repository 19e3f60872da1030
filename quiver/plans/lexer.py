"""Tokens of the query language."""

from __future__ import annotations

from dataclasses import dataclass

from quiver.schema import GraphError

KEYWORDS = frozenset({"MATCH", "WHERE", "RETURN", "LIMIT", "CONTAINS", "AND"})
PAIRS = ("->", "<-", "!=")
SINGLES = frozenset("()[]:.,-=")


class CypherSyntaxError(GraphError):
    """Text that isn't a query."""


@dataclass(frozen=True)
class Token:
    kind: str  # a keyword, a mark itself, or IDENT, STRING, NUMBER, END
    text: str
    at: int


def tokens(text: str) -> list[Token]:
    """Keywords ignore case; strings have no escapes and may span lines; a line that starts with -- is a comment; NUL ends."""
    text = text.partition("\0")[0]
    out: list[Token] = []
    i, fresh = 0, True  # fresh: nothing but blanks since the line began
    while i < len(text):
        c = text[i]
        if c.isspace():
            fresh = fresh or c == "\n"
            i += 1
            continue
        if fresh and text.startswith("--", i):
            end = text.find("\n", i)
            i = len(text) if end < 0 else end
            continue
        fresh = False
        start = i
        if text[i : i + 2] in PAIRS:
            i += 2
            out.append(Token(text[start:i], text[start:i], start))
        elif c in SINGLES:
            i += 1
            out.append(Token(c, c, start))
        elif c in "'\"":
            end = text.find(c, i + 1)
            if end < 0:
                raise CypherSyntaxError(f"the string that starts at {start} doesn't end")
            i = end + 1
            out.append(Token("STRING", text[start + 1 : end], start))
        elif c.isdecimal() and c.isascii():
            while i < len(text) and text[i].isdecimal():
                i += 1
            out.append(Token("NUMBER", text[start:i], start))
        elif c.isalpha() or c == "_":
            while i < len(text) and (text[i].isalnum() or text[i] == "_"):
                i += 1
            word = text[start:i]
            out.append(Token(word.upper() if word.upper() in KEYWORDS else "IDENT", word, start))
        else:
            raise CypherSyntaxError(f"unexpected character {c!r} at {start}")
    return [*out, Token("END", "", len(text))]
