"""Python files, by the interpreter's own syntax tree."""

from __future__ import annotations

import ast
import re

from graphloom.extract.base import Found
from graphloom.extract.lex import ParseError

_NAME = re.compile(r"(?:(?:async|def|class)(?:\s|\\\n)+)+")
_EXEC = ("eval", "exec", "compile")
_DYNAMIC_METHODS = ("__getattribute__", "__getattr__", "__setattr__")


def _word(node: ast.AST) -> str | None:
    """The text of a plain string literal made of letters, digits, ``_`` and ``.``."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str) and node.value and all(c.isalnum() or c in "_." for c in node.value):
        return node.value
    return None


def _leaf(node: ast.AST) -> str | None:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


class Visitor(ast.NodeVisitor):
    def __init__(self, found: Found):
        self.f = found
        self.scope: list[tuple[str, bool]] = []  # name, is it a class
        self.alias: dict[str, str] = {}
        self.hooks = "__init_subclass__" in found.text

    def at(self, node: ast.AST) -> int:
        line = self.f.lines.starts[node.lineno - 1]
        raw = self.f.text[line : self.f.lines.starts[node.lineno] if node.lineno < len(self.f.lines.starts) else None]
        return line + len(raw.encode()[: node.col_offset].decode(errors="ignore"))

    @property
    def enclosing(self) -> str | None:
        return ".".join(n for n, _ in self.scope[-2:]) if len(self.scope) > 1 and self.scope[-2][1] else self.scope[-1][0] if self.scope else None

    @property
    def bare(self) -> str | None:
        return self.scope[-1][0] if self.scope else None

    def _define(self, node, kind: str) -> None:
        parent = self.scope[-1][0] if self.scope and self.scope[-1][1] else None
        returns = _leaf(node.returns) if getattr(node, "returns", None) is not None else None
        # The node begins at its keyword; what stands between that and the name are blanks.
        place = _NAME.match(self.f.text, self.at(node)).end()
        self.f.symbol(node.name, kind, place, node.end_lineno, parent, returns=returns)

    def visit_FunctionDef(self, node) -> None:
        self._define(node, "function")
        for d in node.decorator_list:
            self.visit(d)
            if isinstance(d, ast.Call) and _leaf(d.func) == "inject":
                for a in d.args[:1]:
                    if _leaf(a):
                        self.f.ref(_leaf(a), "call", self.at(d), node.name, rule="py.di.inject")
        self.scope.append((node.name, False))
        for default in [*node.args.defaults, *[d for d in node.args.kw_defaults if d is not None]]:
            # A default is met as a parameter and again as a call.
            self._depends(default)
            self.visit(default)
        for x in [*node.args.args, *node.args.kwonlyargs, *node.args.posonlyargs]:
            if x.annotation is not None:
                self.visit(x.annotation)
        for x in node.body:
            self.visit(x)
        self.scope.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node) -> None:
        self._define(node, "class")
        own = any(isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)) and x.name == "__init_subclass__" for x in ast.walk(node))
        if self.hooks and (node.bases or node.keywords) and not own:
            self.f.ref(node.name, "call", self.at(node), None, rule="py.framework.init_subclass")
        for x in [*node.decorator_list, *node.bases, *node.keywords]:
            self.visit(x)
        self.scope.append((node.name, True))
        for x in node.body:
            if isinstance(x, ast.FunctionDef) and x.name in _DYNAMIC_METHODS:
                self.f.violation("py_dynamic_attr", self.at(x))
            self.visit(x)
        self.scope.pop()

    def visit_Import(self, node) -> None:
        for a in node.names:
            self.alias[a.asname or a.name.split(".")[0]] = a.name
            self.f.ref(a.asname or a.name.rsplit(".", 1)[-1], "import", self.at(node), self.enclosing, module=a.name)
            if a.name.split(".")[0] == "ctypes":
                self.f.violation("py_ctypes", self.at(node))
            if a.name == "builtins":
                self.f.violation("py_builtins", self.at(node))

    def visit_ImportFrom(self, node) -> None:
        module = "." * node.level + (node.module or "")
        for a in node.names:
            if a.name == "*":
                continue
            self.alias[a.asname or a.name] = f"{node.module or ''}.{a.name}"
            self.f.ref(a.name, "import", self.at(node), self.enclosing, module=module)
            if node.module == "builtins":
                self.f.violation("py_builtins", self.at(node))
        if (node.module or "").split(".")[0] == "ctypes":
            self.f.violation("py_ctypes", self.at(node))

    def _depends(self, node: ast.AST) -> None:
        if isinstance(node, ast.Call) and _leaf(node.func) in ("Depends", "Security") and node.args and _leaf(node.args[0]):
            self.f.ref(_leaf(node.args[0]), "call", self.at(node), self.bare, rule="py.di.depends")

    def visit_Assign(self, node) -> None:
        if isinstance(node.value, ast.Name) and node.value.id in ("eval", "exec"):
            self.f.violation("py_eval_alias", self.at(node))
        self.generic_visit(node)

    def visit_Subscript(self, node) -> None:
        if isinstance(node.value, ast.Call) and _leaf(node.value.func) in ("vars", "globals", "locals"):
            self.f.violation("py_vars_subscript", self.at(node))
        self.generic_visit(node)

    def visit_Call(self, node) -> None:
        at, name = self.at(node), _leaf(node.func)
        full = self.alias.get(name, name) if isinstance(node.func, ast.Name) else name
        if name:
            self.f.ref(name, "call", at, self.enclosing)
        last = (full or "").rsplit(".", 1)[-1]
        if last == "getattr" and len(node.args) > 1:
            if word := _word(node.args[1]):
                self.f.ref(word.rsplit(".", 1)[-1], "call", at, self.bare, rule="py.dynamic.getattr", confidence="dynamic_candidate")
            else:
                self.f.violation("py_getattr_dynamic", at)
        elif last == "import_module" and node.args:
            if word := _word(node.args[0]):
                self.f.ref(word.rsplit(".", 1)[-1], "call", at, self.bare, module=word, rule="py.dynamic.import_module", confidence="dynamic_candidate")
            else:
                self.f.violation("py_import_module_dynamic", at)
        elif isinstance(node.func, ast.Name) and full in _EXEC[:2]:
            self.f.violation("py_eval_exec", at)
        elif isinstance(node.func, ast.Name) and full == "__import__":
            self.f.violation("py___import__", at)
        elif isinstance(node.func, ast.Name) and full in ("setattr", "delattr"):
            self.f.violation("py_setattr", at)
        elif last in ("entry_points", "iter_entry_points", "load_entry_point"):
            group = next((_word(k.value) for k in node.keywords if k.arg == "group"), None) or next((_word(a) for a in node.args), None)
            if group:
                self.f.ref(group, "call", at, self.bare, module=group, rule="py.di.entry_points")
        self._depends(node)
        self.generic_visit(node)


def extract(text: str, language: str = "python") -> Found:
    found = Found(text)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as err:
        raise ParseError(str(err), getattr(err, "lineno", 1) or 1) from err
    v = Visitor(found)
    try:
        v.visit(tree)
    except RecursionError as err:
        raise ParseError("nested too deeply") from err
    return found
