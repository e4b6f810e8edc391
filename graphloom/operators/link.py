"""Linking: symbols, qualifiers, events, packages and import targets.

The results are derived from extracted rows and never written back into them, so a link can
not dangle and nothing has to be revoked: running the same expressions again on changed rows
is the incremental form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schema as s
from graphloom.functions import exprs as e

TYPE_KINDS = ("class", "struct", "interface", "enum", "trait")


def with_id(rows: DataFrame, out: str = "ref_id") -> DataFrame:
    """A number that depends on the row's values alone. The hash passes over nulls, so where they
    stand is hashed too."""
    values = ("root_id", "path", "name", "line", "kind", "enclosing", "qualifier", "confidence", "rule_id", "module")
    return rows.withColumn(out, F.xxhash64(*values, *[F.isnull(c) for c in values]))


def symbol_id() -> list:
    return [F.xxhash64("root_id", "path", "qualified_name", "start_line", "start_col")]


def link_symbols(refs: DataFrame, symbols: DataFrame, write_root: str = "") -> DataFrame:
    """Add symbol_root, symbol_path and symbol_name: the best definition of each ref.

    Tiers: ``qualifier.name``, then ``qualifier::name``, among qualified names; then the bare
    name, also when a qualifier found nothing. Within a tier the own (or written) root wins,
    then the own file, then the least path, root, line and qualified name.

    A first pass finds the tier of each ref, with the least place of its key: one join by
    qualifier and name, for refs that have a qualifier, and one by name. Only where keys are
    defined more than once do roots and files matter. Refs of such keys meet the best symbol of
    their key in their file, in their root and in the written root, each one row per key, so a
    name that is defined ten thousand times does not multiply its refs.
    """
    d = symbols.select("root_id", "path", "name", "qualified_name", "start_line")
    place = F.struct("path", "root_id", "start_line", "qualified_name", "name").alias("place")
    # src tells keys of the two kinds apart: qualified names and bare ones.
    keys = d.where("qualified_name IS NOT NULL").select(F.lit(0).alias("src"), F.col("qualified_name").alias("key"), "root_id", place)
    keys = keys.unionByName(d.where("name IS NOT NULL").select(F.lit(1).alias("src"), F.col("name").alias("key"), "root_id", place))

    def least(rows: DataFrame) -> DataFrame:
        return rows.groupBy("src", "key").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("defs"))

    # What a qualified name is the qualifier and the name of, by the place of the sign between.
    cuts = [f"transform(filter(sequence(2, greatest(length(key), 2)), p -> substring(key, p, {len(sign)}) = '{sign}'), p -> named_struct('qualifier', substring(key, 1, p - 1), 'name', substring(key, p + {len(sign)}), 'tier', {tier}))" for tier, sign in enumerate((".", "::"))]
    full = least(keys.where("src = 0 AND (instr(key, '.') > 1 OR instr(key, '::') > 1)")).withColumn("c", F.explode(F.concat(*[F.expr(x) for x in cuts])))
    full = full.groupBy("c.qualifier", "c.name").agg(F.min(F.struct("c.tier", "src", "key", "place", "defs")).alias("_q"))
    bare = least(keys.where("src = 1")).select(F.col("key").alias("name"), F.struct(F.lit(2).alias("tier"), "src", "key", "place", "defs").alias("_n"))
    has = F.coalesce("qualifier", F.lit("")) != ""
    none = F.lit(None).cast(full.schema["_q"].dataType)
    out = refs.where(~has).withColumn("_q", none).unionByName(refs.where(has).join(full, ["qualifier", "name"], "left").select(*refs.columns, "_q"))
    out = out.join(bare, "name", "left").select(*refs.columns, F.coalesce("_q", "_n").alias("_hit"))

    def shown(rows: DataFrame, got) -> DataFrame:
        return rows.select(*refs.columns, got["root_id"].alias("symbol_root"), got["path"].alias("symbol_path"), got["qualified_name"].alias("symbol_name"))

    several = keys.groupBy("src", "key").count().where("count > 1").select("src", "key")
    if several.isEmpty():
        return shown(out, F.col("_hit.place"))
    sole = F.coalesce(F.col("_hit.defs"), F.lit(1)) == 1
    rows, again = out.where(~sole).withColumn("src", F.col("_hit.src")).withColumn("key", F.col("_hit.key")), keys.join(several, ["src", "key"], "left_semi")
    in_file = again.groupBy("src", "key", "root_id", F.col("place.path").alias("path")).agg(F.min("place").alias("_file"))
    in_root = again.groupBy("src", "key", "root_id").agg(F.min("place").alias("_root"))
    in_written = in_root.where(F.col("root_id") == write_root).select("src", "key", F.col("_root").alias("_written"))
    rows = rows.join(in_file, ["src", "key", "root_id", "path"], "left").join(in_root, ["src", "key", "root_id"], "left").join(in_written, ["src", "key"], "left")
    # Both roots count alike; between them the place decides.
    best = F.coalesce(F.col("_file"), F.least("_root", "_written"), F.col("_hit.place"))
    return shown(out.where(sole), F.col("_hit.place")).unionByName(shown(rows, best))


def variable_types(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, variable, type: variables that one factory of the same directory types uniquely."""
    functions = symbols.where("kind = 'function'").select("name", e.directory("path").alias("dir"), "return_type")
    several = functions.groupBy("dir", "name").count().where("count > 1").select("dir", F.col("name").alias("module"), F.lit(True).alias("_several"))
    typed = functions.where("return_type IS NOT NULL AND return_type <> ''").select("dir", F.col("name").alias("module"), "return_type").groupBy("dir", "module").agg(F.min("return_type").alias("lo"), F.max("return_type").alias("hi"))
    defines = refs.where("kind = 'define' AND module IS NOT NULL").select("path", "name", "module", e.directory("path").alias("dir")).distinct()
    rows = defines.join(typed, ["dir", "module"]).join(several, ["dir", "module"], "left")
    one = rows.groupBy("path", F.col("name").alias("variable")).agg(F.min("lo").alias("type"), F.max("hi").alias("hi"), F.max(F.coalesce("_several", F.lit(False))).alias("several"))
    return one.where("type = hi AND NOT several").select("path", "variable", "type")


def upgrade_qualifiers(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls on a typed variable get its type as qualifier; ``pre_qual`` keeps the variable.

    ``refs`` hold extracted qualifiers, so a type that became ambiguous is simply not applied.
    """
    known = symbols.where(F.col("kind").isin(*TYPE_KINDS)).select(F.col("name").alias("qualifier")).distinct().withColumn("_type_name", F.lit(True))
    types = variable_types(refs, symbols).select("path", F.col("variable").alias("qualifier"), "type")
    rows = refs.join(types, ["path", "qualifier"], "left").join(known, "qualifier", "left")
    up = (F.col("kind") == "call") & F.col("type").isNotNull() & F.col("_type_name").isNull() & (F.col("type") != F.col("qualifier"))
    up = F.coalesce(up, F.lit(False))
    old = F.col("qualifier")
    got = rows.withColumn("pre_qual", F.when(up, old)).withColumn("qual_name", F.when(up, F.concat("type", F.lit("."), "name")).otherwise(F.col("qual_name"))).withColumn("qualifier", F.when(up, F.col("type")).otherwise(old))
    return got.select(*refs.columns, "pre_qual")


def dispatch(refs: DataFrame) -> DataFrame:
    """Edges from each emit to each handler of its event, within a root.

    One row for every emit row and distinct handler. Handlers are made distinct before the
    join, so repeated subscriptions do not multiply rows.
    """
    emits = refs.where("rule_id = 'ts.event.emit' AND module IS NOT NULL")
    handlers = refs.where("rule_id = 'ts.event.subscribe' AND module IS NOT NULL").select("root_id", "module", F.col("name").alias("handler")).distinct()
    rows = emits.join(handlers, ["root_id", "module"])
    values = {"name": F.col("handler"), "kind": F.lit("call"), "enclosing": F.coalesce("enclosing", F.lit("")), "confidence": F.lit("heuristic"), "rule_id": F.lit("ts.event.dispatch"), "qualifier": F.lit(None).cast("string"), "qual_name": F.lit(None).cast("string"), "resolved": F.lit(None).cast("string")}
    return rows.select(*[values.get(c, F.col(c)).alias(c) for c in refs.columns])


def with_dispatch(refs: DataFrame) -> DataFrame:
    """``refs`` with their event edges anew; those that were there before are replaced."""
    plain = refs.where("rule_id IS NULL OR rule_id <> 'ts.event.dispatch'")
    return plain.unionByName(dispatch(plain))


#: Endings that a path of an alias may lack, in order of preference (fixed values).
ALIAS_TAILS = ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.d.ts", "/index.js", "/index.jsx")


def wildcard_hits(modules: DataFrame, aliases: DataFrame) -> DataFrame:
    """module, root_id, target: the longest wildcard key that begins each module, and what its
    entry becomes with the rest of the module for its star.

    Prefixes are cut at the few lengths that the keys have; the driver sees these lengths only.
    """
    wild = aliases.where(F.col("package").endswith("*")).select(F.regexp_replace("package", r"\*+$", "").alias("_prefix"), "root_id", F.coalesce("barrel", "entry").alias("_to")).where("_prefix <> ''")
    lengths = [r[0] for r in wild.select(F.length("_prefix").alias("n")).distinct().orderBy("n").collect()]
    if not lengths:
        return modules.select("module", F.lit(None).cast("string").alias("root_id"), F.lit(None).cast("string").alias("target")).limit(0)
    relative = F.col("module").startswith(".") | F.col("module").startswith("/")
    cut = modules.where(~relative).withColumn("_prefix", F.explode(F.array(*[F.substring("module", 1, n) for n in lengths])))
    hit = cut.join(wild, "_prefix").where(F.length("module") > F.length("_prefix"))
    best = hit.groupBy("module").agg(F.max_by(F.struct("_prefix", "root_id", "_to"), F.struct(F.length("_prefix"), "root_id", "_to")).alias("w"))
    rest = F.expr("substring(module, length(w._prefix) + 1)")
    return best.select("module", F.col("w.root_id").alias("root_id"), F.replace(F.col("w._to"), F.lit("*"), rest).alias("target"))


def link_packages(refs: DataFrame, aliases: DataFrame, files: DataFrame) -> DataFrame:
    """Resolve imports of workspace packages.

    ``aliases`` (package, root_id, entry, barrel, source). A key matches its own specifier and
    those below it; the greatest key wins, so a subpath overrides its package. Where no key does,
    the longest wildcard (ending in ``*``) gives a file that its root has, or nothing. An import
    under several keys meets each of its own prefixes once, so the join is an equi-join.
    Only imports are joined, in one join, which Spark can split where a module is very common.
    """
    exact = aliases.where(~F.col("package").endswith("*"))
    target = F.coalesce("barrel", "entry", F.concat(F.lit("@alias:"), "package", F.lit("→"), "root_id"))
    exact = exact.groupBy(F.lower("package").alias("_key")).agg(F.max_by(F.struct(target.alias("t")), "package").alias("hit"), F.max("package").alias("package"))
    modules = refs.where("kind = 'import' AND module IS NOT NULL").select("module").distinct()
    found = modules.withColumn("_key", F.explode(e.specifier_prefixes("module"))).join(exact, "_key").groupBy("module").agg(F.max_by("hit", "package").alias("hit")).select("module", F.col("hit.t").alias("_exact"))
    wild = wildcard_hits(modules, aliases)
    base = e.repo_path("target")
    rows = wild.where("target IS NOT NULL").select("module", "root_id", F.posexplode(F.array(*[F.concat(base, F.lit(t)) for t in ALIAS_TAILS])).alias("pos", "file"))
    probe = rows.join(files.select("root_id", F.col("path").alias("file")), ["root_id", "file"]).groupBy("module").agg(F.min_by("file", "pos").alias("_file"))
    starred = wild.select("module", F.lit(True).alias("_w")).join(probe, "module", "left")
    targets = found.join(starred, "module", "full")
    package = F.when(F.col("_exact").isNotNull(), F.col("_exact")).when(F.col("_w"), F.col("_file")).otherwise(F.col("resolved"))
    # Other rows keep what they have. In the join, all without a module would meet in one task.
    imported = F.coalesce((F.col("kind") == "import") & F.col("module").isNotNull(), F.lit(False))
    rows = refs.where(imported).join(targets, "module", "left").withColumn("resolved", package)
    return refs.where(~imported).unionByName(rows.select(*refs.columns))


TS_TAILS = ("", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.mts", "/index.cts", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs", ".d.ts")


def ts_candidates(path="path", module="module"):
    """The files that a relative specifier may mean, in order of preference."""
    base = e.repo_path(F.concat(e.directory(path), F.lit("/"), e.col(module)))
    return F.when(e.col(module).startswith("."), F.array(*[F.concat(base, F.lit(t)) for t in TS_TAILS]))


def py_candidates(path="path", module="module"):
    """The files of a Python import: leading dots walk up from the file's directory."""
    level = F.length(F.regexp_extract(e.col(module), r"^\.*", 0))
    rest = F.regexp_replace(F.regexp_replace(e.col(module), r"^\.+", ""), r"\.", "/")
    up = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(level - 1, F.lit(0)) + 1), lambda i: F.when(i == 1, F.lit(".")).otherwise(F.lit(".."))), "/")
    base = F.when(level > 0, e.repo_path(F.concat_ws("/", e.directory(path), up, rest))).otherwise(rest)
    return F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")), F.concat(base, F.lit(".pyi")))


def rs_candidates(path="path", module="module"):
    """The files of a ``crate::``, ``self::`` or ``super::`` path; its last part may be an item of
    the file before it. A file's own module is its folder if it is mod.rs, lib.rs or main.rs."""
    p, m = e.col(path), e.col(module)
    own = F.when(p.rlike(r"(^|/)(mod|lib|main)\.rs$"), e.directory(path)).otherwise(F.regexp_replace(p, r"\.rs$", ""))
    root = F.regexp_extract(p, "^((?:.*/)?src)/", 1)
    steps = F.transform(F.split(m, "::"), lambda x: F.when(x == "super", F.lit("..")).when(x.isin("self", "crate"), F.lit(".")).otherwise(x))
    base = e.repo_path(F.concat_ws("/", F.when(m.startswith("crate::"), root).otherwise(own), F.array_join(steps, "/")))
    up = e.directory(base)
    return F.when(m.rlike("^(crate|self|super)::"), F.array(*[F.concat(b, F.lit(t)) for b in (base, up) for t in (".rs", "/mod.rs")], F.concat(up, F.lit("/lib.rs"))))


def resolve_imports(imports: DataFrame, files: DataFrame, candidates) -> DataFrame:
    """Resolve each import to the first of its candidate paths that is a file of its root.

    Candidates become rows and meet the files by an equi-join; the known paths are never sent
    to the tasks as a set.
    """
    wanted = imports.select("root_id", "path", "module").distinct().withColumn("_c", candidates)
    rows = wanted.select("root_id", "path", "module", F.posexplode("_c").alias("pos", "file"))
    hit = rows.join(files.select("root_id", F.col("path").alias("file")), ["root_id", "file"]).groupBy("root_id", "path", "module").agg(F.min_by("file", "pos").alias("_file"))
    return imports.join(hit, ["root_id", "path", "module"], "left").withColumn("resolved", F.coalesce("_file", "resolved")).drop("_file").select(*imports.columns)


def go_resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Go imports: the shortest file path whose directory is the import path or ends with it.

    The whole import path has to be there: a like last part alone is another package. Files are
    reduced to one per root and ending before they meet the imports.
    """
    dirs = files.where(F.lower("path").endswith(".go")).select("root_id", F.col("path").alias("file"), F.split(e.directory("path"), "/").alias("p"))
    tails = dirs.select("root_id", "file", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.array_join(F.slice("p", k, F.size("p")), "/"))).alias("module"))
    best = tails.groupBy("root_id", "module").agg(F.min(F.struct(F.length("file"), "file")).alias("b")).select("root_id", "module", F.col("b.file").alias("_file"))
    mine = F.substring_index("module", "/", 1).contains(".") & ~F.col("module").startswith(".")
    got = imports.join(best, ["root_id", "module"], "left")
    return got.withColumn("resolved", F.when(mine, F.coalesce("_file", "resolved")).otherwise(F.col("resolved"))).select(*imports.columns)


def unique_definition(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """The definition that an export may name: the only one of its name, or the only one that
    the ref's qualifier fits. Refs without such a definition are dropped."""
    d = symbols.select(F.col("name"), F.col("root_id").alias("symbol_root"), F.col("path").alias("symbol_path"), F.col("qualified_name").alias("symbol_name"), F.col("parent").alias("_parent"), F.col("start_line").alias("symbol_line"))
    counts = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    # Of a name that is defined once, the least of each column is its own.
    sole = d.drop("_parent").groupBy("name").agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in d.columns if c not in ("name", "_parent")]).where("_n = 1").drop("_n")
    single = refs.join(sole, "name")
    several = counts.where("_n > 1").select("name")
    if several.isEmpty():
        return single
    many = with_id(refs).where("qualifier IS NOT NULL AND qualifier <> ''").join(several, "name", "left_semi")
    q, n, full = F.col("qualifier"), F.col("name"), F.col("symbol_name")
    fits = reduce(lambda a, b: a | b, [(full == F.concat(q, F.lit(x), n)) | full.endswith(F.concat(F.lit(y), q, F.lit(x), n)) for x, y in ((".", "."), ("::", "::"))], F.coalesce(F.col("_parent") == q, F.lit(False)))
    fitted = many.join(d, "name").where(fits).drop("_parent")
    picked = fitted.groupBy("ref_id").agg(F.count_distinct("symbol_root", "symbol_path", "symbol_name", "symbol_line").alias("_n")).where("_n = 1").select("ref_id")
    return single.unionByName(fitted.join(picked, "ref_id", "left_semi").drop("ref_id"))
