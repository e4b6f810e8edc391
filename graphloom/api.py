"""The engine: an index folder and the questions that can be put to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import extract as extraction
from graphloom.operators import diff, export, gate, graphview, link, lookup, rank, recipes, sidecar, traverse
from graphloom.sources import ingest, walk, workspace


class Engine:
    """Relations under ``path``; ``roots`` limits answers to one root if exactly one is given."""

    def __init__(self, spark: SparkSession, path: str, roots: list[str] | None = None):
        self.spark, self.roots = spark, roots
        self.index = ingest.Index(spark, path)
        self._memo: dict[tuple, DataFrame] = {}

    # ---- building -------------------------------------------------------------------------

    def build(self, tree: str, root_id: str = "", force: bool = False, scope: list[str] | None = None) -> dict:
        """Index a source tree: walk, extract what changed, record what is not read."""
        walked = walk.walk(self.spark, tree, root_id)
        sources = walked.where("fate = 'source'").drop("fate")
        bad = walk.unread(walked)

        def extract(todo: DataFrame) -> dict[str, DataFrame]:
            parts = extraction.extract(todo)
            parts["refs"] = self._resolved(parts["refs"], sources)
            return parts

        done = ingest.build(self.index, sources, extract, root_id, force, scope)
        if not bad.isEmpty():
            old = self.index.read("violations")
            self.index.write({"violations": ingest.replaced(old, bad, bad.select("root_id", "path"), root_id)})
        trees = self.index.meta().get("trees", {})
        if trees.get(root_id) != tree:
            self.index.save_meta(self.index.meta() | {"trees": trees | {root_id: tree}})
        self._memo.clear()
        return done

    def lines(self) -> DataFrame:
        """The sources' lines as they are now: root_id, path, line (from 1), text. Tasks read them."""
        out = self.spark.createDataFrame([], "root_id string, path string, line int, text string")
        for root_id, tree in self.index.meta().get("trees", {}).items():
            files = self.files.where(F.col("root_id") == root_id).select("root_id", "path", F.concat(F.lit(walk.qualified(self.spark, tree)), "path").alias("uri"))
            rows = walk.with_content(files).where("content IS NOT NULL").select("root_id", "path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\r?\n")).alias("line", "text"))
            out = out.unionByName(rows.withColumn("line", F.col("line") + 1))
        return out

    def root_ids(self, filters: list[str]) -> list[str]:
        """The roots that filters name: by path, as it was recorded or as it resolves, or by id;
        what is not recorded counts by its last part."""
        import os

        recorded = self.index.meta().get("workspace_roots", [])
        real = lambda p: os.path.realpath(p).replace("\\", "/")
        out = []
        for f in filters:
            hit = next((r["id"] for r in recorded if f in (r["path"], r["id"]) or real(r["path"]) == real(f)), None)
            out.append(hit if hit is not None else real(f).rstrip("/").rsplit("/", 1)[-1])
        return out

    def _resolved(self, refs: DataFrame, files: DataFrame) -> DataFrame:
        """Resolve imports by language; other refs pass."""
        imports = refs.where("kind = 'import'").join(files.select("root_id", "path", "language"), ["root_id", "path"])
        lang = lambda *x: imports.where(F.col("language").isin(*x)).drop("language").select(*refs.columns)
        parts = [
            refs.where("kind <> 'import'"),
            link.resolve_imports(lang("typescript", "tsx", "javascript", "jsx"), files, link.ts_candidates()),
            link.resolve_imports(lang("python"), files, link.py_candidates()),
            link.go_resolve(lang("go"), files),
            link.resolve_imports(lang("rust"), files, link.rs_candidates()),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def build_workspace(self, roots: list[dict], given: dict[str, str] | None = None, force: bool = False) -> dict:
        """Index every root of a manifest and keep its package aliases."""
        done = {r["id"]: self.build(r["path"], r["id"], force) for r in roots}
        found = workspace.aliases(roots, given)
        self.index.save_meta(self.index.meta() | {"workspace_roots": roots, "workspace_package_aliases": [list(a) for a in found]})
        self._memo.clear()
        return done

    def describe(self, labels: DataFrame) -> None:
        """Store descriptions (root_id, path, qualified_name, description)."""
        old = self.index.read("symbols")
        new = labels.select("root_id", "path", "qualified_name", F.col("description").alias("_d"))
        got = old.join(new, ["root_id", "path", "qualified_name"], "left").withColumn("description", F.coalesce("_d", "description")).select(*old.columns)
        self.index.write({"symbols": got})
        self._memo.clear()

    def enrich(self, labeler, limit: int = 100) -> int:
        """Describe up to ``limit`` symbols by ``labeler`` (rows -> descriptions); without one
        nothing is asked of any service."""
        rows = [r.asDict() for r in lookup.undescribed(self.symbols, limit).collect()]
        got, failed = [], 0
        for r in rows:
            try:
                got.append((r["root_id"], r["path"], r["qualified_name"], labeler(r)))
            except Exception:  # noqa: BLE001  a labeler may fail in any way; three failures end the run
                failed += 1
                if failed >= 3:
                    break
        if got:
            self.describe(self.spark.createDataFrame(got, "root_id string, path string, qualified_name string, description string"))
        return len(got)

    # ---- relations ------------------------------------------------------------------------

    def _read(self, name: str) -> DataFrame:
        version = self.index.meta()["versions"].get(name)
        if (name, version) not in self._memo:
            self._memo[name, version] = self.index.read(name, version)
        return self._memo[name, version]

    @property
    def files(self) -> DataFrame:
        return self._read("files")

    @property
    def symbols(self) -> DataFrame:
        return self._read("symbols")

    @property
    def violations(self) -> DataFrame:
        return self._read("violations")

    @property
    def aliases(self) -> DataFrame:
        from graphloom import schema as s

        rows = [tuple(x) for x in self.index.meta().get("workspace_package_aliases", [])]
        return self.spark.createDataFrame(rows, s.ALIASES)

    @property
    def refs(self) -> DataFrame:
        """Extracted refs with typed qualifiers, event edges and package targets: views, never stored."""
        rows = link.upgrade_qualifiers(self._read("refs"), self.symbols).drop("pre_qual")
        rows = link.with_dispatch(rows)
        return link.link_packages(rows, self.aliases, self.files)

    def _names(self, *names: str) -> DataFrame:
        lookup.require_index(self.files)
        return lookup.names(self.spark, *names)

    # ---- questions ------------------------------------------------------------------------

    def find(self, name: str, limit: int = 20, fuzzy: bool = False) -> DataFrame:
        lookup.require_index(self.files)
        return lookup.find_fuzzy(self.symbols, name, limit, self.roots) if fuzzy else lookup.find(self.symbols, name, limit, self.roots)

    def callers(self, *names: str, window: str = "default", limit: int = 50, sound: bool = False, macro: bool = False, dedup: bool = True) -> DataFrame:
        q = self._names(*names)
        if sound:
            return lookup.callers_sound(self.refs, q, limit, self.roots)
        got = lookup.callers(self.refs, q, window, limit, self.roots)
        if not macro:
            return got
        return sidecar.union(got, lookup.callers(self._shown_side(), q, window, limit, self.roots), window == "exact", dedup)

    def callers_payload(self, name: str, window: str = "default", limit: int = 50, mode: str = "separate"):
        lookup.require_index(self.files)
        return lookup.callers_payload(self.refs, name, window, limit, mode, self.roots)

    def impact(self, *names: str, depth: int = 2, limit: int = 100, window: str = "default", sound: bool = False, macro: bool = False) -> DataFrame:
        """The impact walk; with ``macro`` it also follows edges that only expanded sources have."""
        if macro and not sound:
            both = self.refs.unionByName(sidecar.without_known(self.refs, self._shown_side()).select(*self.refs.columns))
            return traverse.impact(both, self.symbols, self.files, self._names(*names), depth, limit, window, self.roots)
        return traverse.impact(self.refs, self.symbols, self.files, self._names(*names), depth, limit, window, self.roots, sound)

    def related(self, *names: str, limit: int = 10) -> DataFrame:
        return rank.related_files(self.symbols, self.refs, self._names(*names), limit, self.aliases)

    def importers(self, *targets: str, limit: int = 50) -> DataFrame:
        """Importers of files or, for names that are packages of the workspace, of packages."""
        q = self._names(*targets)
        packages = q.join(self.aliases.select(F.col("package").alias("query")).distinct(), "query", "left_semi")
        files = q.join(packages, "query", "left_anti")
        by_file = lookup.external_dependency(lookup.importers_of_file(self.refs, files, limit), self.aliases)
        return by_file.unionByName(lookup.importers_of_package(self.refs, packages, self.aliases, limit), allowMissingColumns=True)

    def who_calls(self, name: str, limit: int = 50, noisy: bool = False) -> dict:
        lookup.require_index(self.files)
        return recipes.who_calls(self.files, self.refs, self.violations, name, limit, noisy, self.roots)

    def blast_radius(self, name: str, depth: int = 3, limit: int = 100) -> dict:
        lookup.require_index(self.files)
        return recipes.blast_radius(self.files, self.symbols, self.refs, self.violations, name, depth, limit, self.roots)

    def subset(self) -> dict:
        g = recipes._gate(self.files, self.violations, self.roots)
        bad = recipes.as_table(lookup.in_root(self.violations, self.roots).orderBy("root_id", "path", "line", "kind"))
        return g | {"violation_count": len(bad), "violations": bad}

    def stats(self) -> dict:
        lookup.require_index(self.files)
        return gate.stats(self.files, self.symbols, self.refs).first().asDict()

    def workspace_status(self) -> list[dict]:
        roots = self.index.meta().get("workspace_roots", [])
        recorded = self.spark.createDataFrame([(r["id"],) for r in roots], "root_id string") if roots else None
        return [r.asDict() for r in gate.roots_status(self.files, self.symbols, self.refs, self.violations, recorded).orderBy("root_id").collect()]

    def diff(self, limit: int = 100, exact_only: bool = False, baseline: str | None = None, promote: bool = False) -> dict:
        """What edges came and went since the baseline."""
        from graphloom import schema as s

        lookup.require_index(self.files)
        live = diff.edges_of(self._read("refs"))
        latest, previous = self.index.snapshots()
        old = self.spark.read.schema(s.EDGES).json(baseline) if baseline else diff.choose_baseline(live, latest, previous)
        only = lambda df: lookup.in_root(df, self.roots)
        out = diff.report(only(old), only(live), limit, exact_only, bool(self.index.meta().get("baseline_stale")))
        if promote:
            self.index.promote()
        return out

    def graph(self, name: str, direction: str = "impact", depth: int = 2, sound: bool = False, most: int = graphview.MOST_NODES) -> dict:
        """The view around a name: what it reaches (impact), its callers, or both."""
        q = self._names(name)
        parts = []
        if direction in ("impact", "both"):
            parts.append(traverse.impact(self.refs, self.symbols, self.files, q, depth, most, roots=self.roots, sound=sound))
        if direction in ("callers", "both"):
            parts.append(lookup.callers_sound(self.refs, q, most, self.roots) if sound else lookup.callers(self.refs, q, "default", most, self.roots))
        nodes, edges = graphview.merged(*[(graphview.nodes(p), graphview.edges(p)) for p in parts])
        return graphview.view(nodes, edges, name, most)

    def export(self, kind: str, out: str, project: str = "project", root: str = "", window: str = "default") -> None:
        """Write an export folder: ``scip`` (sequence of messages), ``scip-json`` or ``lsif`` lines."""
        lookup.require_index(self.files)
        if kind == "scip":
            docs = export.scip_documents(self.symbols, self.refs, self.files, project, window, self.lines())
            docs.write.parquet(out)
        elif kind == "scip-json":
            export.scip_json(self.symbols, self.refs, self.files, root, project, window, self.lines()).select("json").write.text(out)
        elif kind == "lsif":
            export.lsif(self.symbols, self.refs, self.files, root, window, self.lines()).orderBy("id").select("json").write.text(out)
        else:
            raise ValueError(f"no export is called {kind!r}")

    # ---- side dataset ---------------------------------------------------------------------

    def side(self) -> DataFrame:
        path = self.index.meta().get("sidecar")
        if not path:
            return self._read("refs").limit(0).withColumn("mapped", F.lit(None).cast("string"))
        side = ingest.Index(self.spark, path)
        pairs = self.spark.createDataFrame([tuple(p) for p in self.index.meta().get("path_map", [])], "expanded string, source string, prefix boolean")
        return sidecar.mapped_path(side.read("refs"), pairs, self.files)

    def _shown_side(self) -> DataFrame:
        """The side dataset under the paths of the sources, if the gate lets a query use it."""
        meta = self.index.meta()
        stale = meta.get("sidecar") is not None and meta.get("source_fingerprint") not in (None, sidecar.fingerprint(self.files).first()[0])
        ok, _ = sidecar.usable(bool(meta.get("sidecar")), stale, False, True, False)
        rows = self.side() if ok else self.side().limit(0)
        return rows.withColumn("path", F.coalesce("mapped", "path"))

    def build_side(self, tree: str, path: str, root: str, pairs: list[tuple[str, str, bool]] = ()) -> dict:
        """Index an expanded tree beside the sources. It may not be, or lie within, their root.
        Pairs that are not given are found by comparing the trees."""
        norm = lambda p: p.rstrip("/") + "/"
        if norm(tree).startswith(norm(root)) or norm(root).startswith(norm(tree)):
            raise ValueError("the expanded tree must lie outside the sources")
        expanded = Engine(self.spark, path)
        done = expanded.build(tree)
        given = self.spark.createDataFrame([tuple(p) for p in pairs], "expanded string, source string, prefix boolean")
        pairs = [tuple(r) for r in sidecar.discovered(expanded.files, given, self.files).collect()]
        self.index.save_meta(self.index.meta() | {"sidecar": path, "path_map": [list(p) for p in pairs], "expanded_root": tree, "source_fingerprint": sidecar.fingerprint(self.files).first()[0]})
        return done

    def side_status(self) -> dict:
        meta = self.index.meta()
        if not meta.get("sidecar"):
            return {"exists": False}
        stale = meta.get("source_fingerprint") not in (None, sidecar.fingerprint(self.files).first()[0])
        stats = sidecar.dedup_stats(self._read("refs"), self.side()).first().asDict()
        return {"exists": True, "stale": stale, "root": meta.get("expanded_root"), "dedup": stats}
