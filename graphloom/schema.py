"""The relations of a reference graph and the fixed vocabularies of its columns."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I = T.StringType(), T.LongType(), T.IntegerType()  # noqa: E741


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


FILES = _struct(root_id=S, path=S, hash=S, language=S, mtime_ns=L, size=L)
SYMBOLS = _struct(root_id=S, path=S, name=S, qualified_name=S, kind=S, start_line=I, end_line=I, parent=S, description=S, start_col=I, end_col=I, return_type=S)
#: A row is an edge enclosing -> name, cited at (root_id, path, line).
REFS = _struct(root_id=S, name=S, kind=S, path=S, line=I, enclosing=S, module=S, resolved=S, qualifier=S, confidence=S, qual_name=S, rule_id=S, snippet=S)
VIOLATIONS = _struct(root_id=S, path=S, kind=S, line=I, snippet=S)
EDGES = _struct(name=S, path=S, line=I, confidence=S, enclosing=S, root_id=S)
ALIASES = _struct(package=S, root_id=S, entry=S, barrel=S, source=S)

#: Extension -> language, longest extension first (fixed values).
LANGUAGES = (
    (".tsx", "tsx"), (".mts", "typescript"), (".cts", "typescript"), (".ts", "typescript"),
    (".jsx", "jsx"), (".mjs", "javascript"), (".cjs", "javascript"), (".js", "javascript"),
    (".pyi", "python"), (".py", "python"), (".go", "go"), (".rs", "rust"),
)
SYMBOL_KINDS = ("function", "method", "class", "interface", "type_alias", "variable", "module", "struct", "enum", "trait")
EDGE_KINDS = ("call", "import", "define")
CONFIDENCES = ("exact", "heuristic", "dynamic_candidate")
#: Confidence window -> accepted confidences.
WINDOWS = {"exact": CONFIDENCES[:1], "default": CONFIDENCES[:2], "recall": CONFIDENCES}

#: Rule identifiers by the role of their edges (fixed values).
IMPLEMENTOR_RULES = ("go.di.interface_impl", "go.di.interface_impl_v2", "go.di.interface_assert", "rs.di.impl_trait", "rs.di.dyn_trait_method")
REGISTRATION_RULES = (
    "ts.di.register", "ts.di.bind", "ts.di.to", "ts.di.decorator",
    "ts.nest.module_providers", "ts.nest.module_controllers", "ts.nest.module_imports", "ts.nest.module_exports", "ts.nest.ctor_inject",
    "ts.event.subscribe", "ts.event.dispatch", "ts.framework.register",
    "py.di.depends", "py.di.inject", "py.di.entry_points", "py.framework.init_subclass",
    "go.di.route_register", "go.di.handler_map",
    "rs.di.inventory_submit", "rs.di.linkme_distributed_slice",
)
FINITE_RULES = ("ts.dynamic.computed", "ts.event.emit", "py.dynamic.getattr", "py.dynamic.import_module")
#: Heuristic rules whose edges count as sound: all but two of the above.
UNSOUND_RULES = ("py.di.entry_points", "rs.di.dyn_trait_method")
SOUND_RULES = tuple(r for r in (*IMPLEMENTOR_RULES, *REGISTRATION_RULES) if r not in UNSOUND_RULES)

#: Names that occur everywhere (fixed values).
HIGH_FREQUENCY = (
    "fmt", "debug", "clone", "drop", "default", "eq", "hash", "new", "into", "from", "as_ref", "to_string", "get", "set", "call", "execute",
    "run", "handle",
)
HIGH_FREQUENCY_CAP = 20
#: Kinds that an enrichment describes (fixed values).
DESCRIBED_KINDS = ("function", "method", "class", "struct", "trait", "interface")

#: Directories that a source walk skips, and the largest file that it takes (fixed values).
SKIPPED_DIRS = ("node_modules", "target", "dist", "build", "vendor", ".venv", "__pycache__", ".git", "third_party", "testdata")
MAX_FILE_BYTES = 1_500_000
