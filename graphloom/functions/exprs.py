"""Scalar functions and predicates of the graph, as column expressions.

All are built-in expressions: they run inside generated code and can be pushed towards the
scan. The few string rules that a caller needs on the driver are plain functions.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom import schema as s


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def last_segment(c: Column | str) -> Column:
    """What follows the last ``.`` or ``:``."""
    return F.regexp_extract(col(c), "[^.:]*$", 0)


def directory(c: Column | str) -> Column:
    """The path before its last slash; empty for a file at the root."""
    return F.regexp_extract(col(c), "^(.*)/[^/]*$", 1)


def top_dir(c: Column | str) -> Column:
    return F.when(F.instr(col(c), "/") > 0, F.substring_index(col(c), "/", 1)).otherwise(F.lit("(root)"))


def language(path: Column | str) -> Column:
    low = F.lower(col(path))
    return reduce(lambda c, x: c.when(low.endswith(x[0]), F.lit(x[1])), s.LANGUAGES[1:], F.when(low.endswith(s.LANGUAGES[0][0]), F.lit(s.LANGUAGES[0][1])))


def import_path(c: Column | str) -> Column:
    """Slashes unified, leading ``./`` dropped, doubled slashes merged, one leading slash dropped."""
    p = F.regexp_replace(col(c), r"\\", "/")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"^(\./)+", ""), "/{2,}", "/"), "^/", "")


def repo_path(c: Column | str) -> Column:
    """Drop ``.`` and empty segments; ``..`` takes the segment before it."""
    parts = F.split(F.regexp_replace(col(c), r"\\", "/"), "/")
    none = F.array().cast("array<string>")
    step = lambda acc, x: F.when((x == "") | (x == "."), acc).when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(parts, none, step), "/")


def edge_role(confidence: Column | str = "confidence", rule: Column | str = "rule_id") -> Column:
    r = F.coalesce(col(rule), F.lit(""))
    return F.when(col(confidence) == "dynamic_candidate", F.lit("dynamic")).when(r.isin(*s.IMPLEMENTOR_RULES), F.lit("implementor")).when(r.isin(*s.REGISTRATION_RULES), F.lit("registration")).otherwise(F.lit("call"))


def is_implementor(rule: Column | str = "rule_id") -> Column:
    return F.coalesce(col(rule), F.lit("")).isin(*s.IMPLEMENTOR_RULES)


def sound_class(confidence: Column | str = "confidence", rule: Column | str = "rule_id") -> Column:
    c, r = col(confidence), F.coalesce(col(rule), F.lit(""))
    return F.when(c == "exact", F.lit("sound")).when((c == "heuristic") & r.isin(*s.SOUND_RULES), F.lit("sound")).when((c == "dynamic_candidate") & r.isin(*s.FINITE_RULES), F.lit("sound_finite_domain")).otherwise(F.lit("unsound"))


def is_sound(confidence: Column | str = "confidence", rule: Column | str = "rule_id") -> Column:
    return sound_class(confidence, rule) != "unsound"


def in_window(window: str, confidence: Column | str = "confidence") -> Column:
    """``window``: exact, default (exact and heuristic) or recall (everything)."""
    return col(confidence).isin(*s.WINDOWS[window])


def high_frequency(name: Column | str) -> Column:
    return F.lower(col(name)).isin(*s.HIGH_FREQUENCY)


def qual_name(qualifier: Column | str = "qualifier", name: Column | str = "name") -> Column:
    return F.when(F.coalesce(col(qualifier), F.lit("")) != "", F.concat(col(qualifier), F.lit("."), col(name)))


def package_of(specifier: Column | str) -> Column:
    """The package part of an import specifier: ``@scope/name``, or what precedes the first slash."""
    c = col(specifier)
    return F.when(c.startswith("@"), F.regexp_extract(c, "^(@[^/]+/[^/]+)", 1)).when(c.rlike(r"^[./]"), F.lit("")).otherwise(F.substring_index(c, "/", 1))


def specifier_prefixes(specifier: Column | str) -> Column:
    """A specifier, lower-cased, and all that precedes one of its slashes."""
    parts = F.split(F.lower(col(specifier)), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def is_external_module(module: Column | str = "module") -> Column:
    """A non-empty specifier that is neither relative nor absolute."""
    m = F.coalesce(col(module), F.lit(""))
    return (m != "") & ~m.startswith(".") & ~m.startswith("/")


#: Words of the file ranking (fixed values).
LOW_PRIORITY_DIRS = (
    "legacy", "admin", "deprecated", "demo", "demos", "mock", "mocks", "fake", "fakes", "seed", "seeds", "noise", "test", "tests",
    "__tests__", "fixture", "fixtures", "docs", "doc", "examples", "example", "benchmark", "benches", "generated",
)
HARD_DECOY_DIRS = ("legacy", "admin", "deprecated", "demo", "demos", "mock", "mocks", "fake", "fakes", "seed", "seeds", "noise")
HARD_DECOY_ROOTS = (*HARD_DECOY_DIRS, "cli", "docs")
DECOY_ROOTS = ("legacy", "admin", "cli", "docs", "demo", "mock", "noise")
COMMON_BASENAMES = (
    "util", "utils", "helper", "helpers", "common", "config", "constants", "types", "index", "logger", "log", "metrics", "metric", "cache",
    "queue", "repo", "repository", "handler", "handlers", "registry", "manager", "service", "services",
)
BARREL_STEMS = ("index", "main", "mod")
ROLE_SCORES = {"call": 12.0, "import": 12.0, "registration": 10.0, "define": 8.0, "implementor": 3.0, "dynamic": 1.0}


def segments(path: Column | str) -> Column:
    return F.filter(F.split(F.regexp_replace(col(path), r"\\", "/"), "/"), lambda x: (x != "") & (x != "."))


def base_stem(path: Column | str) -> Column:
    """The lower-cased file name without its last extension; dot-files keep their name."""
    name = F.substring_index(F.regexp_replace(col(path), r"\\", "/"), "/", -1)
    return F.lower(F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name))


def inner_dirs(path: Column | str) -> Column:
    p = segments(path)
    return F.transform(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.lower)


def path_penalty(path: Column | str) -> Column:
    low = F.size(F.filter(inner_dirs(path), lambda x: x.isin(*LOW_PRIORITY_DIRS))) * 8.0
    stem = base_stem(path)
    return low + F.when(stem.isin(*COMMON_BASENAMES), 10.0).otherwise(0.0) + F.when(stem.isin(*BARREL_STEMS), 6.0).otherwise(0.0)


def role_score(role: Column | str) -> Column:
    chain = reduce(lambda c, x: c.when(col(role) == x[0], x[1]), [*ROLE_SCORES.items()][1:], F.when(col(role) == "call", 12.0))
    return chain.otherwise(4.0)


def depth_score(depth: Column | str) -> Column:
    return F.when(col(depth) == 0, 5.0).when(col(depth) == 1, 3.0).when(col(depth) == 2, 1.5).otherwise(0.5)


def candidate_score(score="score", role="edge_role", depth="depth", path="path", root="root_id") -> Column:
    decoy = F.when(F.lower(col(root)).isin(*DECOY_ROOTS), 12.0).otherwise(0.0)
    return col(score) + role_score(role) + depth_score(depth) - path_penalty(path) - decoy


def hard_decoy(path: Column | str = "path", root: Column | str = "root_id") -> Column:
    return F.coalesce(F.lower(col(root)).isin(*HARD_DECOY_ROOTS), F.lit(False)) | F.exists(inner_dirs(path), lambda x: x.isin(*HARD_DECOY_DIRS))


def real_source_path(path: Column | str = "path") -> Column:
    return ~col(path).contains("@alias:") & ~col(path).startswith("@")


def scip_descriptor(kind: Column | str = "kind", parent: Column | str = "parent", name: Column | str = "name") -> Column:
    """Descriptor suffixes of the symbol grammar: types ``#``, methods ``().``, modules ``/``, terms ``.``."""
    n = F.regexp_replace(col(name), r"[^A-Za-z0-9_$+-]", "_")
    owner = F.when(F.coalesce(col(parent), F.lit("")) != "", F.concat(F.regexp_replace(col(parent), r"[^A-Za-z0-9_$+-]", "_"), F.lit("#"))).otherwise(F.lit(""))
    own = F.when(col(kind).isin("function", "method"), F.concat(n, F.lit("()."))).when(col(kind).isin("class", "interface", "type_alias", "struct", "enum", "trait"), F.concat(n, F.lit("#"))).when(col(kind) == "module", F.concat(n, F.lit("/"))).otherwise(F.concat(n, F.lit(".")))
    return F.concat(owner, own)


def percent_encoded(c: Column | str) -> Column:
    """Percent-encode everything but unreserved characters and slashes."""
    return F.regexp_replace(F.regexp_replace(F.url_encode(col(c)), r"\+", "%20"), "%2F", "/")


def file_uri(root: Column | str, path: Column | str) -> Column:
    return F.concat(F.lit("file:///"), percent_encoded(F.concat_ws("/", F.regexp_replace(F.regexp_replace(col(root), r"\\", "/"), "^/+|/+$", ""), col(path))))


def root_id_of(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "[^A-Za-z0-9_.-]", "-")


def short_hash(c: Column | str) -> Column:
    return F.substring(F.sha2(col(c), 256), 1, 8)


def shown_root(c: Column | str = "root_id") -> Column:
    return F.when(F.coalesce(col(c), F.lit("")) == "", F.lit("default")).otherwise(col(c))


def cited_at(path: Column | str = "path", line: Column | str = "line") -> Column:
    return F.concat(col(path), F.lit(":"), col(line).cast("string"))


def edge_key(names=("name", "path", "line", "confidence")) -> list[Column]:
    """The columns that tell edges apart; a null enclosing equals an empty one, roots do not count."""
    return [*[F.col(n) for n in names], F.coalesce(F.col("enclosing"), F.lit(""))]


def confidence_rank(c: Column | str = "confidence") -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in s.CONFIDENCES]), col(c)).cast("int")


def clipped(c: Column | str, most: int) -> Column:
    return F.substring(col(c), 1, most)


def label(c: Column | str, most: int = 22) -> Column:
    return F.when(F.length(col(c)) > most, F.concat(F.substring(col(c), 1, most), F.lit("…"))).otherwise(col(c))


def split_name(name: str) -> tuple[str, str]:
    """(bare name, dotted qualified name or ""): the last ``::`` splits, else the last ``.`` if
    what precedes it is one plain qualifier."""
    if "::" in name:
        q, n = name.rsplit("::", 1)
        return n, f"{q}.{n}"
    if "." in name:
        q, n = name.rsplit(".", 1)
        if all(c.isalnum() or c in "_:" for c in q):
            return n, name
    return name, ""


def escape_like(text: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", text)


def promise(languages: list[str], clean: bool) -> tuple[str, str]:
    """Tier and wording of what a clean gate promises."""
    if not clean:
        return "disabled", "Constructs outside the modelled subset were found; the sound walk is off."
    known = sorted(languages)
    return "ast_modeled", f"Edges over-approximate calls inside the modelled subset ({', '.join(known) or 'no files'})."
