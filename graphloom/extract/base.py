"""What an extractor collects from one file."""

from __future__ import annotations

from graphloom.extract.lex import Lines


class Found:
    """Symbols, refs and violations of a file, as rows of the schema without root and path."""

    def __init__(self, text: str):
        self.text, self.lines = text, Lines(text)
        self.symbols: list[dict] = []
        self.refs: list[dict] = []
        self.violations: list[dict] = []

    def snippet(self, at: int, most: int) -> str:
        line = self.lines.line(at)
        end = self.text.find("\n", at)
        return self.text[self.lines.starts[line - 1] : end if end >= 0 else len(self.text)].strip()[:most]

    def symbol(self, name: str, kind: str, at: int, end_line: int | None = None, parent: str | None = None, sep: str = ".", returns: str | None = None) -> None:
        line, col = self.lines.line(at), self.lines.column(at)
        self.symbols.append({"name": name, "qualified_name": f"{parent}{sep}{name}" if parent else name, "kind": kind, "start_line": line, "end_line": end_line or line, "parent": parent, "description": None, "start_col": col, "end_col": self.lines.column(at + len(name)), "return_type": returns})

    def ref(self, name: str, kind: str, at: int, enclosing: str | None, qualifier: str | None = None, module: str | None = None, rule: str | None = None, confidence: str | None = None) -> None:
        confidence = confidence or ("heuristic" if rule else "exact")
        self.refs.append({"name": name, "kind": kind, "line": self.lines.line(at), "enclosing": enclosing, "module": module, "resolved": None, "qualifier": qualifier, "confidence": confidence, "qual_name": f"{qualifier}.{name}" if qualifier else None, "rule_id": rule, "snippet": self.snippet(at, 80) if rule else None})

    def violation(self, kind: str, at: int) -> None:
        self.violations.append({"kind": kind, "line": self.lines.line(at), "snippet": self.snippet(at, 120)})


class Types:
    """Types of variables by scope: a stack of name -> type."""

    def __init__(self) -> None:
        self.stack: list[dict[str, str]] = [{}]

    def get(self, name: str) -> str | None:
        return next((s[name] for s in reversed(self.stack) if name in s), None)

    def put(self, name: str, kind: str) -> None:
        self.stack[-1][name] = kind
