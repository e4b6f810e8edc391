"""Rust files."""

from __future__ import annotations

from graphloom.extract.base import Found, Types
from graphloom.extract.lex import closing, tokens

_KEYWORDS = set("as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait type union unsafe use where while".split())
_PLAIN = {"Box", "Self", "Vec", "Arc", "Rc", "String"}


#: Path heads that stay in the crate, or name the inventory itself.
_OWN = ("crate", "self", "super", "inventory")


class Reader:
    def __init__(self, text: str):
        self.f, self.ts = Found(text), tokens(text, "rust")
        self.pair = closing(self.ts)
        self.types = Types()
        self.scopes: list[tuple[int, str, str, str | None]] = []  # closing index, what, name, trait
        self.pending: dict[int, tuple[str, str, str | None, dict[str, str]]] = {}
        self.dyn = {self.ts[i + 1].text for i in range(len(self.ts) - 1) if self.ts[i].text == "dyn" and self.ts[i + 1].kind == "id"}
        self.trait_methods: dict[str, list[tuple[str, str]]] = {}
        self.method_calls: list[tuple[str, int, str | None]] = []
        self.inventory = {"inventory"}
        self.submit_names: set[str] = set()

    def text(self, i: int) -> str:
        return self.ts[i].text if 0 <= i < len(self.ts) else ""

    def kind(self, i: int) -> str:
        return self.ts[i].kind if 0 <= i < len(self.ts) else ""

    def owner(self) -> str | None:
        return next((n for _, what, n, _ in reversed(self.scopes) if what in ("impl", "trait")), None)

    @property
    def parent(self) -> str | None:
        return self.scopes[-1][2] if self.scopes else None

    @property
    def enclosing(self) -> str | None:
        fn = next((n for _, what, n, _ in reversed(self.scopes) if what == "fn"), None)
        return None if fn is None else f"{self.owner()}::{fn}" if self.owner() else fn

    @property
    def bare(self) -> str | None:
        return next((n for _, what, n, _ in reversed(self.scopes) if what == "fn"), None)

    def generics(self, i: int) -> int:
        """The index after ``<...>`` at ``i``."""
        if self.text(i) != "<":
            return i
        depth, k = 0, i
        while k < len(self.ts):
            depth += {"<": 1, ">": -1}.get(self.text(k), 0)
            k += 1
            if not depth:
                break
        return k

    def path(self, i: int) -> tuple[str | None, int]:
        """The last name of a type path and the index after it."""
        name = None
        while self.text(i) in ("&", "mut", "dyn", "*", "const") or self.kind(i) == "life":
            i += 1
        while self.kind(i) == "id":
            name, i = self.text(i), self.generics(i + 1)
            if self.text(i) != "::":
                break
            i += 1
        return name, i

    def read(self) -> Found:
        i = 0
        while i < len(self.ts):
            while self.scopes and i > self.scopes[-1][0]:
                self.scopes.pop()
                self.types.stack.pop()
            if i in self.pending:
                what, name, trait, types = self.pending.pop(i)
                self.scopes.append((self.pair[i], what, name, trait))
                self.types.stack.append(types)
            i = self.step(i)
        for name, at, enclosing in self.method_calls:
            for trait in sorted(self.dyn):
                for kind, method in self.trait_methods.get(trait, []):
                    if method == name:
                        self.f.ref(name, "call", at, enclosing, kind, module=trait, rule="rs.di.dyn_trait_method")
        return self.f

    def body(self, i: int) -> int | None:
        while i < len(self.ts) and self.text(i) not in ("{", ";"):
            i = (self.pair[i] if self.text(i) in "([" else i) + 1
        return i if self.text(i) == "{" else None

    def step(self, i: int) -> int:
        t, x = self.ts[i], self.text
        if t.text == "#" and x(i + 1) in ("[", "!"):
            return self.attribute(i)
        if t.kind != "id":
            return i + 1
        w = t.text
        if w == "use" and x(i - 1) not in (".", "::"):
            return self.use(i)
        if w == "fn" and self.kind(i + 1) == "id":
            return self.function(i)
        if w in ("struct", "enum", "trait", "mod", "type") and self.kind(i + 1) == "id" and x(i - 1) not in (".", "::"):
            if w == "type" and self.scopes and self.scopes[-1][1] == "fn":
                return i + 1
            brace = self.body(i + 2) if w != "type" else None
            kind = {"mod": "module", "type": "type_alias"}.get(w, w)
            self.f.symbol(x(i + 1), kind, self.ts[i + 1].at, self.ts[self.pair[brace]].line if brace is not None else None, self.parent if self.scopes and self.scopes[-1][1] in ("module", "impl", "trait") else None, "::")
            if w == "trait" and brace is not None:
                if x(i - 1) == "unsafe":
                    self.f.violation("unsafe", t.at)
                self.pending[brace] = ("trait", x(i + 1), None, {})
            elif w == "mod" and brace is not None:
                self.pending[brace] = ("module", x(i + 1), None, {})
            return i + 2
        if w == "impl":
            return self.impl(i)
        if w == "unsafe" and (x(i + 1) == "{" or x(i + 1) in ("fn", "impl", "extern")):
            self.f.violation("unsafe", t.at)
            return i + 1
        if w in ("asm", "global_asm") and x(i + 1) == "!":
            self.f.violation("asm", t.at)
        if w in ("transmute", "transmute_copy") and x(i + 1) in ("(", "::"):
            self.f.violation("transmute", t.at)
        if w == "ptr" and x(i - 1) == "::" and x(i - 2) in ("std", "core") and x(i + 1) == "::":
            self.f.violation("std_ptr", t.at)
        if w == "let":
            k = i + 1 + (x(i + 1) == "mut")
            if self.kind(k) == "id" and x(k + 1) == ":":
                kind, _ = self.path(k + 2)
                if kind:
                    self.types.put(x(k), kind)
        if x(i + 1) == "!":
            if x(i + 2) in ("(", "[", "{") and self.submits(i):
                self.submit(i + 2)
            return i + 2
        end = self.generics(i + 2) if x(i + 1) == "::" and x(i + 2) == "<" else i + 1
        if x(end) == "(" and w not in _KEYWORDS:
            self.call(i)
        return i + 1

    def call(self, i: int) -> None:
        w, before, qualifier = self.text(i), self.text(i - 1), None
        if before == "::":
            k = i - 2
            if self.text(k) == ">":
                depth = 0
                while k >= 0:
                    depth += {">": 1, "<": -1}.get(self.text(k), 0)
                    k -= 1
                    if not depth:
                        break
                k -= self.text(k) == "::"
            qualifier = self.text(k) if self.kind(k) == "id" else None
            if qualifier == "Self":
                qualifier = self.owner() or qualifier
        elif before == ".":
            o = self.text(i - 2)
            self.method_calls.append((w, self.ts[i].at, self.bare))
            if o == "self":
                qualifier = self.owner()
            elif self.kind(i - 2) == "id" and self.text(i - 3) != ".":
                qualifier = self.types.get(o) or o
        self.f.ref(w, "call", self.ts[i].at, self.enclosing, qualifier)

    def function(self, i: int) -> int:
        name, k = self.text(i + 1), self.generics(i + 2)
        if self.text(k) != "(":
            return i + 2
        types: dict[str, str] = {}
        end = self.pair[k]
        for j in range(k + 1, end):
            if self.kind(j) == "id" and self.text(j + 1) == ":" and self.text(j - 1) in ("(", ",", "mut"):
                kind, _ = self.path(j + 2)
                if kind:
                    types[self.text(j)] = kind
        brace = self.body(end + 1)
        returns, _ = self.path(end + 2) if self.text(end + 1) == "->" else (None, 0)
        scope = self.scopes[-1] if self.scopes else None
        parent = scope[2] if scope and scope[1] in ("impl", "trait", "module") else None
        method = scope is not None and scope[1] in ("impl", "trait")
        self.f.symbol(name, "method" if method else "function", self.ts[i + 1].at, self.ts[self.pair[brace]].line if brace is not None else None, parent, "::", returns)
        if method and scope[1] == "impl" and scope[3]:
            self.f.ref(name, "call", self.ts[i + 1].at, scope[2], scope[2], module=scope[3], rule="rs.di.impl_trait")
            self.trait_methods.setdefault(scope[3], []).append((scope[2], name))
        if brace is not None:
            self.pending[brace] = ("fn", name, None, types)
        return end + 1

    def impl(self, i: int) -> int:
        first, k = self.path(self.generics(i + 1))
        trait, kind = None, first
        if self.text(k) == "for":
            trait, (kind, k) = first, self.path(k + 1)
        brace = self.body(k)
        if kind and brace is not None and self.text(i - 1) not in (":", "->", "(", ",", "&", "<", "="):
            self.pending[brace] = ("impl", kind, trait, {})
            return brace
        return i + 1

    def use(self, i: int) -> int:
        """All leaves of the tree, one row a name."""
        k, stack, seen, path, renames = i + 1, [], set(), [], set()

        def leaf(at: int) -> None:
            if not path:
                return
            if path[-2:] == ["inventory", "submit"] and all(p in _OWN for p in path[:-2]):
                if at not in renames:
                    self.submit_names.add("submit")
            name = path[-1] if path[-1] != "self" else path[-2] if len(path) > 1 else None
            if name and name != "*" and name not in seen:
                seen.add(name)
                self.f.ref(name, "import", self.ts[at].at, self.enclosing, module="::".join(path))

        while k < len(self.ts) and self.text(k) != ";":
            t = self.text(k)
            if t == "{":
                stack.append(list(path))
            elif t in (",", "}"):
                if self.text(k - 1) not in ("{", ",", "}"):
                    leaf(k - 1)
                path = list(stack[-1]) if stack else []
                if t == "}" and stack:
                    stack.pop()
            elif t == "as":
                if path[-1:] == ["inventory"] and len(path) == 1:
                    self.inventory.add(self.text(k + 1))
                if path[-2:] == ["inventory", "submit"] and all(p in _OWN for p in path[:-2]):
                    self.submit_names.add(self.text(k + 1))
                    renames.add(k + 1)
                k += 1
            elif self.kind(k) == "id" or t == "*":
                path.append(t)
            k += 1
        if self.text(k - 1) != "}":
            leaf(k - 1)
        return k + 1

    def attribute(self, i: int) -> int:
        open_ = i + 1 + (self.text(i + 1) == "!")
        if self.text(open_) != "[":
            return i + 1
        end = self.pair[open_]
        if self.text(open_ + 1) == "distributed_slice" or self.text(open_ + 3) == "distributed_slice":
            arg = next((j for j in range(open_, end) if self.text(j) == "("), None)
            names = [j for j in range(arg + 1, end) if self.kind(j) == "id"] if arg is not None else []
            if names:
                self.f.ref(self.text(names[-1]), "call", self.ts[i].at, None, rule="rs.di.linkme_distributed_slice")
                k = end + 1
                while self.text(k) in ("pub", "static", "mut", "fn"):
                    k += 1
                if self.text(k + 1) == ":":
                    kind, _ = self.path(k + 2)
                    if kind:
                        self.f.ref(kind, "call", self.ts[i].at, None, rule="rs.di.linkme_distributed_slice")
                elif self.text(k + 1) == "(":
                    self.f.ref(self.text(k), "call", self.ts[i].at, None, rule="rs.di.linkme_distributed_slice")
        return end + 1

    def submits(self, i: int) -> bool:
        """Whether the macro named at ``i`` is the inventory's ``submit``: by its path, which may
        begin in this crate but in no other, or by a name that the file imports for it."""
        path, k = [self.text(i)], i
        while self.text(k - 1) == "::" and self.kind(k - 2) == "id":
            k -= 2
            path.insert(0, self.text(k))
        if len(path) == 1:
            return path[0] in self.submit_names
        return path[-1] == "submit" and path[-2] in self.inventory and all(p in _OWN for p in path[:-2])

    def submit(self, open_: int) -> None:
        k, end, first = open_ + 1, self.pair[open_], True
        while k < end:
            if self.kind(k) == "id" and self.text(k) not in _KEYWORDS:
                if first:
                    name, _ = self.path(k)
                    j = k
                    while self.text(j + 1) == "::" and self.kind(j + 2) == "id":
                        j += 2
                    called = self.text(j + 1) == "("
                    self.f.ref((self.text(j - 2) if called and j > k else name) or name, "call", self.ts[open_].at, None, rule="rs.di.inventory_submit")
                    first, k = False, j
                elif self.text(k + 1) == "::" and self.text(k + 2) == "new" and self.text(k) not in _PLAIN:
                    self.f.ref(self.text(k), "call", self.ts[open_].at, None, rule="rs.di.inventory_submit")
            k += 1


def extract(text: str, language: str = "rust") -> Found:
    return Reader(text).read()
