"""TypeScript and JavaScript files."""

from __future__ import annotations

from graphloom.extract.base import Found, Types
from graphloom.extract.lex import Token, closing, string_value, tokens

_KEYWORDS = set("if for while switch catch return typeof instanceof new delete void in of do else try finally throw case default function class await yield super import export const let var with".split())
_PRIMITIVES = set("string number boolean any unknown void never object symbol bigint null undefined String Number Boolean Object Array Promise Map Set Date".split())
_VERBS = set("get post put delete patch options head all route use register mount handle".split())
_UPPER_VERBS = set("GET POST PUT DELETE PATCH OPTIONS HEAD".split())
_EMITS, _SUBSCRIBES = set("emit trigger publish fire".split()), set("on once subscribe addListener addEventListener".split())
_DECORATORS = set("Inject Injectable Optional forwardRef".split())
_NEST = {"providers": "ts.nest.module_providers", "controllers": "ts.nest.module_controllers", "imports": "ts.nest.module_imports", "exports": "ts.nest.module_exports"}
_PROVIDER_KEYS = set("provide useClass useExisting useFactory inject".split())


def word(t: Token) -> str | None:
    """A literal (or bare) key of letters, digits, ``_`` and ``.``."""
    v = string_value(t) if t.kind in ("str", "tpl") else t.text if t.kind in ("id", "num") else None
    return v if v and all(c.isalnum() or c in "_." for c in v) else None


class Reader:
    def __init__(self, text: str, language: str):
        self.f, self.ts = Found(text), tokens(text, language)
        self.pair = closing(self.ts)
        self.types = Types()
        self.scopes: list[tuple[int, str, bool]] = []  # closing index, name, is it a class
        self.pending: dict[int, tuple[str, bool]] = {}  # opening brace -> scope it begins

    def text(self, i: int) -> str:
        return self.ts[i].text if 0 <= i < len(self.ts) else ""

    def kind(self, i: int) -> str:
        return self.ts[i].kind if 0 <= i < len(self.ts) else ""

    @property
    def enclosing(self) -> str | None:
        if not self.scopes:
            return None
        if len(self.scopes) > 1 and self.scopes[-2][2] and not self.scopes[-1][2]:
            return f"{self.scopes[-2][1]}.{self.scopes[-1][1]}"
        return self.scopes[-1][1]

    @property
    def bare(self) -> str | None:
        return self.scopes[-1][1] if self.scopes else None

    @property
    def owner(self) -> str | None:
        return self.scopes[-1][1] if self.scopes and self.scopes[-1][2] else None

    def body_after(self, i: int) -> int | None:
        """The opening brace of the body that follows a parameter list's end ``i``."""
        k, depth = i + 1, 0
        while k < len(self.ts) and (self.text(k) not in ("{", ";", "=>", "}") or depth):
            depth += {"<": 1, ">": -1}.get(self.text(k), 0)
            k = self.pair.get(k, k) if self.text(k) in "([" else k
            k += 1
        return k if self.text(k) == "{" else None

    def begin(self, name: str, brace: int | None, is_class: bool = False) -> None:
        if brace is not None:
            self.pending[brace] = (name, is_class)

    def end_line(self, brace: int | None, i: int) -> int:
        return self.ts[self.pair[brace]].line if brace is not None and brace in self.pair else self.ts[i].line

    def parameters(self, open_: int) -> list[tuple[str, str, int]]:
        """(name, type, index of the type) of annotated parameters."""
        out, k, end = [], open_ + 1, self.pair[open_]
        while k < end:
            if self.text(k) in "([{":
                k = self.pair[k]
            elif self.kind(k) == "id" and (self.text(k + 1) == ":" or self.text(k + 1) == "?" and self.text(k + 2) == ":"):
                t = k + (2 if self.text(k + 1) == ":" else 3)
                if self.kind(t) == "id":
                    out.append((self.text(k), self.text(t), t))
                k = t
            k += 1
        return out

    def read(self) -> Found:
        i = 0
        while i < len(self.ts):
            while self.scopes and i > self.scopes[-1][0]:
                self.scopes.pop()
                self.types.stack.pop()
            if i in self.pending:
                name, is_class = self.pending.pop(i)
                self.scopes.append((self.pair[i], name, is_class))
                self.types.stack.append(getattr(self, "arrived", {}).pop(i, {}) if hasattr(self, "arrived") else {})
            i = self.step(i)
        return self.f

    def known(self, open_: int | None, brace: int | None) -> None:
        """Types of a function's parameters hold in its body."""
        if open_ is not None and brace is not None:
            if not hasattr(self, "arrived"):
                self.arrived: dict[int, dict[str, str]] = {}
            self.arrived[brace] = {n: t for n, t, _ in self.parameters(open_)}

    def step(self, i: int) -> int:
        t, x = self.ts[i], self.text
        if t.kind == "p" and t.text == "@" and self.kind(i + 1) == "id":
            return self.decorator(i)
        if t.kind == "p" and t.text == "[" and i and (self.kind(i - 1) == "id" and x(i - 1) not in _KEYWORDS or x(i - 1) in ")]"):
            self.computed(i)
        if t.kind != "id":
            return i + 1
        w, before = t.text, x(i - 1)
        if before != "." and w == "import" and x(i + 1) not in ("(", "."):
            return self.imports(i)
        if before != "." and w == "export" and x(i + 1) in ("{", "*"):
            return self.exports(i)
        if before != "." and w == "function":
            k = i + 1 + (x(i + 1) == "*")
            if self.kind(k) == "id":
                return self.function(x(k), k, next((j for j in range(k + 1, min(k + 40, len(self.ts))) if x(j) == "("), None))
            return i + 1
        if before != "." and w in ("class", "interface") and self.kind(i + 1) == "id":
            brace = next((j for j in range(i + 2, len(self.ts)) if x(j) == "{"), None)
            self.f.symbol(x(i + 1), w, self.ts[i + 1].at, self.end_line(brace, i))
            self.begin(x(i + 1), brace, True)
            return i + 2
        if before != "." and w == "type" and self.kind(i + 1) == "id" and x(i + 2) in ("=", "<"):
            self.f.symbol(x(i + 1), "type_alias", self.ts[i + 1].at)
            return i + 2
        if before != "." and w in ("const", "let", "var") and self.kind(i + 1) == "id":
            return self.variable(i)
        if w == "with" and x(i + 1) == "(" and before != ".":
            self.f.violation("with", t.at)
            return i + 1
        if self.owner and x(i + 1) == "(" and before in ("{", "}", ";", "async", "static", "public", "private", "protected", "get", "set", "override", "*", ")") and w not in ("if", "for", "while", "switch", "catch"):
            brace = self.body_after(self.pair[i + 1])
            if brace is not None:
                owner = self.owner
                self.f.symbol(w, "method", t.at, self.end_line(brace, i), owner)
                if w == "constructor":
                    for _, kind, at in self.parameters(i + 1):
                        if kind not in _PRIMITIVES:
                            self.f.ref(kind, "call", self.ts[at].at, owner, rule="ts.nest.ctor_inject")
                self.known(i + 1, brace)
                self.begin(w, brace)
                return i + 1
        if w == "new" and self.kind(i + 1) == "id":
            k = i + 1
            while x(k + 1) == "." and self.kind(k + 2) == "id":
                k += 2
            self.global_use(k, x(k), new=True)
            self.f.ref(x(k), "call", self.ts[k].at, self.enclosing)
            return k + 1
        if x(i + 1) == "(" and w not in _KEYWORDS or w == "import" and x(i + 1) == "(":
            self.call(i)
        elif w in ("Proxy", "Reflect") and before not in (".", ":", "<", "|", "&"):
            self.f.violation(w, t.at)
        elif w == "eval" and before == "=":
            self.f.violation("eval_alias", t.at)
        elif w == "prototype" and before == "." and "=" in (x(i + 1), x(i + 3)) and x(i + 4) != "=":
            self.f.violation("monkey_patch", t.at)
        return i + 1

    def function(self, name: str, i: int, open_: int | None) -> int:
        brace = self.body_after(self.pair[open_]) if open_ is not None else None
        k = self.pair[open_] if open_ is not None else i
        returns = self.text(k + 2) if self.text(k + 1) == ":" and self.kind(k + 2) == "id" else None
        self.f.symbol(name, "function", self.ts[i].at, self.end_line(brace, i), returns=returns)
        self.known(open_, brace)
        self.begin(name, brace)
        return (open_ if open_ is not None else i) + 1

    def variable(self, i: int) -> int:
        x, k = self.text, i + 2
        if x(k) == ":":
            if self.kind(k + 1) == "id":
                self.types.put(x(i + 1), x(k + 1))
            while k < len(self.ts) and x(k) not in ("=", ";", "{") and self.ts[k].line == self.ts[i].line:
                k = (self.pair.get(k, k) if x(k) in "([" else k) + 1
        if x(k) != "=":
            return i + 1
        k += 1
        k += x(k) == "async"
        if x(k) == "new" and self.kind(k + 1) == "id":
            self.types.put(x(i + 1), x(k + 1))
        elif x(k) == "function" or x(k) == "(" and x(self.pair[k] + 1) in ("=>", ":") or self.kind(k) == "id" and x(k + 1) == "=>":
            open_ = k if x(k) == "(" else next((j for j in range(k, min(k + 6, len(self.ts))) if x(j) == "("), None) if x(k) == "function" else None
            arrow = next((j for j in range((self.pair[open_] if open_ is not None else k), min(len(self.ts), (self.pair[open_] if open_ is not None else k) + 40)) if x(j) in ("=>", "{")), None)
            brace = arrow + 1 if arrow is not None and x(arrow) == "=>" and x(arrow + 1) == "{" else arrow if arrow is not None and x(arrow) == "{" else None
            if x(k) == "(" and (arrow is None or x(arrow) != "=>"):
                return i + 1
            self.f.symbol(x(i + 1), "function", self.ts[i + 1].at, self.end_line(brace, i))
            self.known(open_, brace)
            self.begin(x(i + 1), brace)
            return i + 3
        elif x(k) == "eval":
            self.f.violation("eval_alias", self.ts[k].at)
        return i + 2

    def imports(self, i: int) -> int:
        k = i + 1
        if self.kind(k) == "str":
            return k + 1
        names: list[tuple[str, int]] = []
        while k < len(self.ts) and self.text(k) not in ("from", ";") and self.kind(k) != "str":
            if self.text(k) == "{":
                end, j = self.pair[k], k + 1
                while j < end:
                    j += self.text(j) == "type" and self.kind(j + 1) == "id" and self.text(j + 1) != "as"
                    if self.kind(j) == "id":
                        names.append((self.text(j), j))
                        j += 2 if self.text(j + 1) == "as" else 0
                    j += 1
                k = end
            elif self.text(k) == "*":
                k += 2
            elif self.kind(k) == "id" and self.text(k) != "type":
                names.append((self.text(k), k))
            k += 1
        if self.text(k) == "from" and self.kind(k + 1) == "str":
            for name, at in names:
                self.f.ref(name, "import", self.ts[at].at, self.enclosing, module=string_value(self.ts[k + 1]))
            return k + 2
        return i + 1

    def exports(self, i: int) -> int:
        if self.text(i + 1) == "*":
            return i + 2
        end = self.pair[i + 1]
        module = string_value(self.ts[end + 2]) if self.text(end + 1) == "from" and self.kind(end + 2) == "str" else None
        k = i + 2
        while k < end:
            if self.kind(k) == "id":
                at = k + 2 if self.text(k + 1) == "as" else k
                self.f.symbol(self.text(at), "module", self.ts[at].at)
                self.f.ref(self.text(at), "import", self.ts[at].at, None, module=module)
                k = at
            k += 1
        return end + (3 if module is not None else 1)

    def decorator(self, i: int) -> int:
        name = self.text(i + 1)
        if self.text(i + 2) != "(":
            return i + 2
        open_, end = i + 2, self.pair[i + 2]
        if name in _DECORATORS:
            arg = next((k for k in range(open_ + 1, end) if self.kind(k) == "id"), None)
            if arg is not None:
                self.f.ref(self.text(arg), "call", self.ts[i].at, self.bare, rule="ts.di.decorator")
        elif name == "Module":
            k = open_ + 1
            while k < end:
                if self.text(k) in _NEST and self.text(k + 1) == ":" and self.text(k + 2) == "[":
                    self.nest(_NEST[self.text(k)], k + 2)
                    k = self.pair[k + 2]
                k += 1
        # The decorator itself is no call; what stands in its brackets is read like all else.
        return open_ + 1

    def nest(self, rule: str, open_: int) -> None:
        k, end = open_ + 1, self.pair[open_]
        while k < end:
            t = self.ts[k]
            if t.kind == "id" and self.text(k + 1) == ":" and t.text in _PROVIDER_KEYS:
                k += 1
            elif t.kind == "id" and t.text != "forwardRef" and self.text(k + 1) not in (":", "=>") and self.text(k - 1) != ".":
                self.f.ref(t.text, "call", t.at, self.bare, rule=rule)
            elif t.kind == "str" and word(t):
                self.f.ref(word(t), "call", t.at, self.bare, rule=rule)
            k += 1

    def computed(self, i: int) -> None:
        """``object[key]``: called with a literal key it is a finite candidate, else a violation."""
        end = self.pair[i]
        called = self.text(end + 1) == "(" or self.text(i - 2) == "new"
        key = self.ts[i + 1] if end == i + 2 else None
        w = word(key) if key is not None else None
        if called and w:
            name = w.rsplit(".", 1)[-1]
            if w in _EMITS and self.text(end + 1) == "(":
                self.event(w, end + 1, self.ts[i].at)
            self.f.ref(name, "call", self.ts[i].at, self.bare, rule="ts.dynamic.computed", confidence="dynamic_candidate")
        elif called:
            literal = key is not None and key.kind == "tpl"
            self.f.violation("template_computed_key" if literal or any(t.kind == "tpl" for t in self.ts[i + 1 : end]) else "nonliteral_computed_key", self.ts[i].at)

    def event(self, w: str, open_: int, at: int) -> None:
        key = self.ts[open_ + 1]
        name = string_value(key)
        if name:
            self.f.ref(w, "call", at, self.bare, module=name, rule="ts.event.emit", confidence="dynamic_candidate")
        elif key.text != ")":
            self.f.violation("nonliteral_event_key", at)

    def arguments(self, open_: int) -> list[tuple[int, int]]:
        """Token ranges of a call's arguments."""
        out, k, end, start = [], open_ + 1, self.pair[open_], open_ + 1
        while k < end:
            if self.text(k) == ",":
                out.append((start, k))
                start = k + 1
            k = (self.pair[k] if self.text(k) in "([{" else k) + 1
        return [*out, (start, end)] if start < end else out

    def handler(self, arg: tuple[int, int], rule: str, module: str | None, at: int) -> bool:
        """Edges to what a registration argument names: an identifier, a member, calls inside an
        inline function."""
        a, b = arg
        if self.kind(a) == "id" and self.text(a) not in ("function", "async") and self.text(a + 1) != "=>":
            k = a
            while k + 2 < b and self.text(k + 1) == "." and self.kind(k + 2) == "id":
                k += 2
            self.f.ref(self.text(k), "call", at, self.bare, module=module, rule=rule)
            return True
        inner = [k for k in range(a, b) if self.kind(k) == "id" and self.text(k + 1) == "(" and self.text(k) not in _KEYWORDS]
        if self.text(a) in ("function", "async", "(") or self.text(a + 1) == "=>":
            for k in inner:
                self.f.ref(self.text(k), "call", at, self.bare, module=module, rule=rule)
            return True
        return False

    def global_use(self, i: int, name: str, new: bool = False) -> None:
        at = self.ts[i].at
        member = self.text(i - 1) == "."
        if name == "Function" and not member:
            self.f.violation("Function", at)
        elif name == "Proxy" and new:
            self.f.violation("Proxy", at)
        elif name == "eval" and not member:
            self.f.violation("eval", at)

    def call(self, i: int) -> None:
        w, at, x = self.text(i), self.ts[i].at, self.text
        member = x(i - 1) == "."
        if w == "import":
            if self.kind(i + 2) != "str":
                self.f.violation("import_dynamic", at)
            return
        if w == "require" and not member:
            if self.kind(i + 2) != "str":
                self.f.violation("require_dynamic", at)
        self.global_use(i, w)
        if w == "super":
            return
        qualifier = None
        if member:
            o = i - 2
            if self.kind(o) == "id" and x(o) not in ("this", "self", "super"):
                qualifier = self.types.get(x(o)) or x(o)
            elif x(o) == ")" and self.kind(self.pair[o] - 1) == "id" and x(self.pair[o] - 2) == "new":
                qualifier = x(self.pair[o] - 1)
        self.f.ref(w, "call", at, self.enclosing, qualifier)
        args = self.arguments(i + 1)
        if w in _EMITS and member:
            self.event(w, i + 1, at)
        if not member or not args:
            return
        first = args[0]
        name_arg = next((x(k) for k in range(*first) if self.kind(k) == "id"), None)
        if w in _SUBSCRIBES:
            key = string_value(self.ts[first[0]])
            if key is None:
                self.f.violation("nonliteral_event_key", at)
            elif len(args) > 1 and not self.handler(args[1], "ts.event.subscribe", key, at):
                self.f.violation("unmodeled_event_handler", at)
        elif w == "register" and name_arg and self.kind(first[0]) == "id":
            self.f.ref(name_arg, "call", at, self.bare, rule="ts.di.register")
        elif w == "bind" and name_arg and self.kind(first[0]) == "id" and x(first[0]) != "this":
            self.f.ref(name_arg, "call", at, self.bare, rule="ts.di.bind")
        elif w == "to" and name_arg:
            self.f.ref(name_arg, "call", at, self.bare, rule="ts.di.to")
        if (w in _VERBS or w in _UPPER_VERBS) and not (w == "register" and self.kind(first[0]) == "id" and len(args) == 1):
            rule = "go.di.route_register" if w in _UPPER_VERBS else "ts.framework.register"
            for a in args if w in ("use", "register", "mount", "handle") else args[1:]:
                if self.kind(a[0]) == "id" and self.text(a[0]) not in ("function", "async") and self.text(a[0] + 1) not in ("=>", "("):
                    self.handler(a, rule, None, at)


def extract(text: str, language: str = "typescript") -> Found:
    return Reader(text, language).read()
