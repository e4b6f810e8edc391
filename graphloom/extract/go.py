"""Go files."""

from __future__ import annotations

import re

from graphloom.extract.base import Found, Types
from graphloom.extract.lex import closing, string_value, tokens

_KEYWORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_BUILTINS = set("bool byte complex64 complex128 error float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr any nil".split())
_ROUTES = set("GET POST PUT DELETE PATCH Handle HandleFunc Any".split())


class Reader:
    def __init__(self, text: str):
        self.f, self.ts = Found(text), tokens(text, "go")
        self.pair = closing(self.ts)
        self.types = Types()
        self.scope: tuple[str, str | None, int] | None = None  # name, receiver, closing index
        self.imports: dict[str, str] = {}
        self.methods: dict[str, set[str]] = {}
        self.method_at: dict[tuple[str, str], int] = {}
        self.interfaces: dict[str, set[str]] = {}

    def text(self, i: int) -> str:
        return self.ts[i].text if 0 <= i < len(self.ts) else ""

    def kind(self, i: int) -> str:
        return self.ts[i].kind if 0 <= i < len(self.ts) else ""

    @property
    def enclosing(self) -> str | None:
        return None if self.scope is None else f"{self.scope[1]}.{self.scope[0]}" if self.scope[1] else self.scope[0]

    def base(self, i: int, end: int) -> str | None:
        """The type's own name: after ``*``, brackets and package."""
        name = None
        while i < end and self.text(i) in ("*", "[", "]", "...") or self.kind(i) == "num":
            i += 1
        while i < end and self.kind(i) == "id":
            name, i = self.text(i), i + 1
            if self.text(i) != ".":
                break
            i += 1
        return name if name not in ("func", "map", "chan", "struct", "interface") else None

    def params(self, open_: int) -> dict[str, str]:
        out: dict[str, str] = {}
        k, end, waiting = open_ + 1, self.pair[open_], []
        while k < end:
            stop = k
            while stop < end and self.text(stop) != ",":
                stop = (self.pair[stop] if self.text(stop) in "([{" else stop) + 1
            if self.kind(k) == "id" and stop > k + 1 and self.text(k + 1) != ".":
                kind = self.base(k + 1, stop)
                for n in [*waiting, self.text(k)]:
                    if kind:
                        out[n] = kind
                waiting = []
            elif self.kind(k) == "id":
                waiting.append(self.text(k))
            k = stop + 1
        return out

    def read(self) -> Found:
        for m in re.finditer(r"(?m)^//(go:linkname|export)\b", self.f.text):
            self.f.violation("go_cgo_linkname", m.start())
        i = 0
        while i < len(self.ts):
            if self.scope and i > self.scope[2]:
                self.scope = None
                self.types.stack = [{}]
            i = self.step(i)
        for name, have in self.methods.items():
            for face, need in self.interfaces.items():
                if need and need <= have:
                    for m in sorted(need):
                        self.f.ref(m, "call", self.method_at[name, m], name, name, module=face, rule="go.di.interface_impl_v2")
        return self.f

    def step(self, i: int) -> int:
        t, x = self.ts[i], self.text
        if t.kind != "id" or x(i - 1) == ".":
            return self.use(i) if t.kind == "id" else i + 1
        if t.text == "import":
            return self.import_(i)
        if t.text == "func" and self.scope is None:
            return self.func(i)
        if t.text == "type" and self.kind(i + 1) == "id" and self.scope is None:
            return self.type_(i)
        if t.text == "type" and x(i + 1) == "(":
            return i + 2
        if t.text == "var" and x(i + 1) == "_" and "=" in (x(i + 3), x(i + 5)):
            return self.assertion(i)
        if t.text == "map" and x(i + 1) == "[":
            self.handler_map(i)
        if t.text == "case" and self.scope:
            k = i + 1
            while x(k) not in (":", "{", "}") and self.kind(k) == "id" or x(k) in ("*", ",", "."):
                if self.kind(k) == "id" and x(k + 1) in (",", ":") and x(k) not in _BUILTINS and x(k)[:1].isupper():
                    self.f.ref(x(k), "call", self.ts[k].at, self.enclosing)
                k += 1
        if x(i + 1) == ":=" or x(i + 1) == "," and self.scope:
            self.define(i)
        return self.use(i)

    def import_(self, i: int) -> int:
        k, end = (i + 2, self.pair[i + 1]) if self.text(i + 1) == "(" else (i + 1, i + 3)
        while k < min(end, len(self.ts)):
            if self.kind(k) == "str":
                module = string_value(self.ts[k]) or ""
                alias = self.text(k - 1) if self.kind(k - 1) == "id" and self.text(k - 1) != "import" or self.text(k - 1) == "." and self.text(k - 2) != "import" else None
                name = module.rsplit("/", 1)[-1] if alias in (None, ".", "_") else alias
                self.imports[name] = module
                self.f.ref(name, "import", self.ts[k].at, None, module=module)
                if module in ("C", "unsafe", "reflect", "plugin"):
                    self.f.violation("go_cgo_linkname" if module != "plugin" else "go_dynamic_symbol", self.ts[k].at)
                if self.text(i + 1) != "(":
                    return k + 1
            k += 1
        return end + 1 if self.text(i + 1) == "(" else i + 1

    def func(self, i: int) -> int:
        k, receiver, own = i + 1, None, {}
        if self.text(k) == "(":
            own = self.params(k)
            receiver = next(iter(own.values()), None) or self.base(k + 1, self.pair[k])
            k = self.pair[k] + 1
        if self.kind(k) != "id":
            return i + 1
        name, at = self.text(k), self.ts[k].at
        k += 1
        if self.text(k) == "[":
            k = self.pair[k] + 1
        if self.text(k) != "(":
            return k
        end = self.pair[k]
        brace = end + 1
        while brace < len(self.ts) and self.text(brace) != "{" and self.ts[brace].line == self.ts[end].line:
            brace = (self.pair[brace] if self.text(brace) in "([" else brace) + 1
        has_body = self.text(brace) == "{"
        returns = self.base(end + 1, brace) if self.text(end + 1) != "(" else self.base(end + 2, self.pair[end + 1])
        self.f.symbol(name, "method" if receiver else "function", at, self.ts[self.pair[brace]].line if has_body else None, receiver, returns=returns)
        if receiver:
            self.f.ref(name, "call", at, receiver, receiver, rule="go.di.interface_impl")
            self.methods.setdefault(receiver, set()).add(name)
            self.method_at[receiver, name] = at
        if has_body:
            self.scope = (name, receiver, self.pair[brace])
            self.types.stack = [own | self.params(k)]
            return brace + 1
        return end + 1

    def type_(self, i: int) -> int:
        name, k = self.text(i + 1), i + 2
        if self.text(k) == "[":
            k = self.pair[k] + 1
        face = self.text(k) == "interface"
        brace = k + 1 if self.text(k + 1) == "{" else None
        self.f.symbol(name, "interface" if face else "struct", self.ts[i + 1].at, self.ts[self.pair[brace]].line if brace else None)
        if face and brace:
            self.interfaces[name] = {self.text(j) for j in range(brace + 1, self.pair[brace]) if self.kind(j) == "id" and self.text(j + 1) == "(" and self.ts[j].line != self.ts[j - 1].line or self.kind(j) == "id" and self.text(j + 1) == "(" and self.text(j - 1) in ("{", ";")}
            return self.pair[brace] + 1
        return i + 2

    def assertion(self, i: int) -> int:
        """``var _ I = (*T)(nil)`` or ``= T{}``: T implements I."""
        eq = next(j for j in range(i, i + 7) if self.text(j) == "=")
        face = self.text(eq - 1)
        kind = next((self.text(j) for j in range(eq + 1, min(eq + 6, len(self.ts))) if self.kind(j) == "id"), None)
        if kind:
            self.f.ref(face, "call", self.ts[i].at, kind, kind, rule="go.di.interface_assert")
        return eq + 1

    def handler_map(self, i: int) -> None:
        end = self.pair[i + 1]
        brace = next((j for j in range(end + 1, min(end + 16, len(self.ts))) if self.text(j) == "{" and self.text(j - 1) not in ("struct", "interface")), None)
        if brace is None:
            return
        value = " ".join(self.text(j) for j in range(end + 1, brace))
        if not ("func" in value or re.search(r"(Handler|Func|Hook|Command|Factory)\b", value)):
            return
        for j in range(brace + 1, self.pair[brace]):
            if self.text(j) == ":" and self.kind(j + 1) == "id" and self.text(j + 1) != "func":
                k = j + 1
                while self.text(k + 1) == "." and self.kind(k + 2) == "id":
                    k += 2
                self.f.ref(self.text(k), "call", self.ts[j].at, None, rule="go.di.handler_map")

    def define(self, i: int) -> None:
        names, k = [self.text(i)], i + 1
        while self.text(k) == "," and self.kind(k + 1) == "id":
            names.append(self.text(k + 1))
            k += 2
        if self.text(k) != ":=":
            return
        v = k + 1 + (self.text(k + 1) == "&")
        kind = self.base(v, len(self.ts))
        last = v
        while self.text(last + 1) == "." and self.kind(last + 2) == "id":
            last += 2
        if self.text(last + 1) == "{" and kind and kind[:1].isupper():
            made = kind
        elif self.text(last + 1) == "(":
            callee = self.text(last)
            for n in names:
                if n != "_":
                    self.f.ref(n, "define", self.ts[i].at, self.enclosing, module=callee)
            made = callee[3:] if callee[:3] in ("New", "new") and len(callee) > 3 else None
        else:
            return
        for n in names:
            if made and n != "_":
                self.types.put(n, made)

    def use(self, i: int) -> int:
        w, x = self.ts[i].text, self.text
        if w in _KEYWORDS:
            return i + 1
        if x(i + 1) == ".":
            root = self.imports.get(w)
            if root == "unsafe":
                self.f.violation("go_unsafe", self.ts[i].at)
            elif root == "reflect":
                self.f.violation("go_reflect", self.ts[i].at)
            elif root == "plugin" and x(i + 2) in ("Open", "Lookup"):
                self.f.violation("go_dynamic_symbol", self.ts[i].at)
        if x(i + 1) == "(" and self.scope and x(i - 1) != "func":
            qualifier = None
            if x(i - 1) == "." and self.kind(i - 2) == "id":
                qualifier = self.types.get(x(i - 2)) or x(i - 2)
            self.f.ref(w, "call", self.ts[i].at, self.enclosing, qualifier)
            if w in _ROUTES and x(i - 1) == ".":
                self.route(i)
        return i + 1

    def route(self, i: int) -> None:
        end, k, arg = self.pair[i + 1], i + 2, 0
        while k < end:
            if self.text(k) == ",":
                arg += 1
                j = k + 1
                while self.text(j + 1) == "." and self.kind(j + 2) == "id":
                    j += 2
                if arg == 1 and self.kind(j) == "id" and self.text(j) != "func":
                    self.f.ref(self.text(j), "call", self.ts[i].at, None, rule="go.di.route_register")
            k = (self.pair[k] if self.text(k) in "([{" else k) + 1


def extract(text: str, language: str = "go") -> Found:
    return Reader(text).read()
