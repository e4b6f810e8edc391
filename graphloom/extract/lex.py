"""A small lexer for the brace languages, with places in lines and UTF-16 columns.

It fails closed: a text whose strings, comments or brackets do not end raises ParseError, and
the file becomes a ``parse_error`` violation instead of half a graph.
"""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple


class ParseError(ValueError):
    """The text is not what the lexer can read."""

    def __init__(self, reason: str, line: int = 1):
        super().__init__(reason)
        self.line = line


class Token(NamedTuple):
    kind: str  # id, num, str, tpl, char, life, p
    text: str
    line: int
    at: int


_WORD = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*")
_NUMBER = re.compile(r"\d[\w.]*")
_PUNCT = re.compile(r"=>|->|:=|::|\.\.\.|&&|\|\||[^\s\w]")
_PAIRS = {")": "(", "]": "[", "}": "{"}
_BEFORE_REGEX = set("(,=:[!&|?{};+-*%~^<>") | {"=>", "&&", "||", "return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do"}


class Lines:
    """Offsets to 1-based lines and 0-based UTF-16 columns."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *[m.end() for m in re.finditer("\n", text)]]

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)

    def column(self, at: int) -> int:
        part = self.text[self.starts[self.line(at) - 1] : at]
        return len(part) + sum(c > "\uffff" for c in part)


def string_value(token: Token) -> str | None:
    """What a plain string literal says; None for templates with holes."""
    if token.kind not in ("str", "tpl") or token.kind == "tpl" and "${" in token.text:
        return None
    return token.text.strip("'\"`")


def tokens(text: str, language: str) -> list[Token]:
    lines, out, i, n = Lines(text), [], 0, len(text)
    script, rust = language in ("typescript", "tsx", "javascript", "jsx"), language == "rust"
    if text.startswith("#!"):
        i = text.find("\n") if "\n" in text else n
    stack: list[Token] = []

    def bad(reason: str, at: int) -> ParseError:
        return ParseError(reason, lines.line(at))

    def quoted(start: int, quote: str) -> int:
        k = start + 1
        while k < n and text[k] != quote:
            if text[k] == "\n" and quote != "`" and not rust:
                raise bad("string without an end", start)
            k += 2 if text[k] == "\\" else 1
        if k >= n:
            raise bad("string without an end", start)
        return k + 1

    def template(start: int) -> int:
        k, depth = start + 1, 0
        while k < n:
            if text[k] == "\\":
                k += 2
            elif depth == 0 and text[k] == "`":
                return k + 1
            elif text.startswith("${", k):
                depth, k = depth + 1, k + 2
            elif depth and text[k] in "{}":
                depth, k = depth + (1 if text[k] == "{" else -1), k + 1
            elif depth and text[k] == "`":
                k = template(k)
            else:
                k += 1
        raise bad("template without an end", start)

    while i < n:
        c = text[i]
        if c.isspace():
            i += 1
            continue
        if text.startswith("//", i):
            i = text.find("\n", i) if "\n" in text[i:] else n
            continue
        if text.startswith("/*", i):
            depth, k = 1, i + 2
            while depth:
                close, nest = text.find("*/", k), text.find("/*", k) if rust else -1
                if close < 0:
                    raise bad("comment without an end", i)
                depth, k = (depth + 1, nest + 2) if 0 <= nest < close else (depth - 1, close + 2)
            i = k
            continue
        start = i
        last = out[-1] if out else None
        raw = re.compile(r'b?r(#*)"').match(text, i) if rust else None
        if raw:
            end = text.find('"' + raw[1], raw.end())
            if end < 0:
                raise bad("string without an end", i)
            i = end + 1 + len(raw[1])
            out.append(Token("str", text[raw.end() : end], lines.line(start), start))
        elif c == "`":
            i = template(i) if script else quoted(i, "`")
            out.append(Token("tpl" if script else "str", text[start:i], lines.line(start), start))
        elif c == '"' or c == "'" and script:
            i = quoted(i, c)
            out.append(Token("str", text[start:i], lines.line(start), start))
        elif c == "'":
            char = re.compile(r"'(\\.[^']*|[^'\\\n])'").match(text, i)
            life = re.compile(r"'[A-Za-z_]\w*").match(text, i)
            if char:
                i = char.end()
                out.append(Token("char", text[start:i], lines.line(start), start))
            elif life and rust:
                i = life.end()
                out.append(Token("life", text[start:i], lines.line(start), start))
            else:
                raise bad("character without an end", i)
        elif script and c == "/" and (last is None or last.text in _BEFORE_REGEX):
            k, inside = i + 1, False
            while k < n and (text[k] != "/" or inside):
                if text[k] == "\n":
                    raise bad("pattern without an end", i)
                inside = text[k] == "[" or inside and text[k] != "]"
                k += 2 if text[k] == "\\" else 1
            i = re.compile(r"\w*").match(text, min(k + 1, n)).end()
            out.append(Token("str", "", lines.line(start), start))
        elif m := _WORD.match(text, i):
            i = m.end()
            out.append(Token("id", m[0], lines.line(start), start))
        elif m := _NUMBER.match(text, i):
            i = m.end()
            out.append(Token("num", m[0], lines.line(start), start))
        else:
            m = _PUNCT.match(text, i)
            i = m.end()
            t = Token("p", m[0], lines.line(start), start)
            if t.text in "([{":
                stack.append(t)
            elif t.text in _PAIRS:
                if not stack or stack.pop().text != _PAIRS[t.text]:
                    raise bad(f"unmatched {t.text}", start)
            out.append(t)
    if stack:
        raise bad(f"unmatched {stack[-1].text}", stack[-1].at)
    return out


def closing(ts: list[Token]) -> dict[int, int]:
    """Index of each opening bracket -> index of the one that closes it, and back."""
    out, stack = {}, []
    for i, t in enumerate(ts):
        if t.kind == "p" and t.text in "([{":
            stack.append(i)
        elif t.kind == "p" and t.text in _PAIRS:
            j = stack.pop()
            out[i], out[j] = j, i
    return out
