"""Code-intelligence exports: occurrences as a table, protobuf and line-JSON encodings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import exprs as e
from graphloom.operators import link

MANAGERS = {"typescript": "npm", "tsx": "npm", "javascript": "npm", "jsx": "npm", "python": "pip", "go": "gomod", "rust": "cargo"}
LANGUAGE_IDS = {"typescript": "TypeScript", "tsx": "TypeScriptReact", "javascript": "JavaScript", "jsx": "JavaScriptReact", "python": "Python", "go": "Go", "rust": "Rust"}


def pick(table: dict[str, str], c: Column, other: str) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def symbol_name(project: str) -> Column:
    """``scip-<language> <manager> <package> 0.0.0 <descriptor>``, the file in the descriptor."""
    lang = F.coalesce("language", F.lit("plaintext"))
    file = F.concat(F.lit("`"), F.regexp_replace("path", "`", "``"), F.lit("`/"))
    return F.concat(F.lit("scip-"), lang, F.lit(" "), pick(MANAGERS, lang, "."), F.lit(f" {project} 0.0.0 "), file, e.scip_descriptor())


def definitions(symbols: DataFrame, files: DataFrame, project: str = "project") -> DataFrame:
    rows = symbols.join(files.select("root_id", "path", "language"), ["root_id", "path"], "left")
    return rows.select("root_id", "path", "language", "name", "qualified_name", "start_line", symbol_name(project).alias("symbol"), (F.col("start_line") - 1).alias("line"), F.col("start_col").alias("col"), F.greatest("end_col", F.col("start_col") + 1).alias("end_col"), "description", F.lit(1).alias("roles"))


def occurrences(symbols: DataFrame, refs: DataFrame, files: DataFrame, project: str = "project", window: str = "default", lines: DataFrame | None = None) -> DataFrame:
    """Definitions (role 1) and references (role 0) with zero-based lines and UTF-16 columns.

    References without a unique definition are left out. With ``lines`` (root_id, path, line,
    text) a reference takes the columns of its n-th word on the line that no definition holds.
    """
    defs = definitions(symbols, files, project)
    picked = link.unique_definition(refs.where(e.in_window(window)), symbols)
    target = defs.select(F.col("root_id").alias("symbol_root"), F.col("path").alias("symbol_path"), F.col("qualified_name").alias("symbol_name"), F.col("start_line").alias("symbol_line"), "symbol").dropDuplicates(["symbol_root", "symbol_path", "symbol_name", "symbol_line"])
    found = picked.join(target, ["symbol_root", "symbol_path", "symbol_name", "symbol_line"])
    nth = Window.partitionBy("root_id", "path", "line", "name").orderBy("kind", "confidence", F.asc_nulls_first("rule_id"), F.asc_nulls_first("enclosing"), "symbol")
    found = found.withColumn("nth", F.row_number().over(nth))
    if lines is not None:
        taken = symbols.groupBy("root_id", "path", F.col("start_line").alias("line"), "name").agg(F.collect_set("start_col").alias("taken"))
        found = found.join(lines, ["root_id", "path", "line"], "left").join(taken, ["root_id", "path", "line", "name"], "left")
        # Places of the name as a whole word: the lengths of what lies between its occurrences.
        parts = F.split("text", F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.col("name"), F.lit(r"\E(?![\p{L}\p{N}_])")))
        units = lambda x: F.length(x) + F.length(F.regexp_replace(x, r"[^\x{10000}-\x{10FFFF}]", ""))
        starts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.aggregate(F.slice(parts, 1, k), F.lit(0), lambda a, x: a + units(x)) + (k - 1) * units(F.col("name")))
        free = F.when(F.size(parts) > 1, F.filter(starts, lambda x: ~F.coalesce(F.array_contains("taken", x), F.lit(False))))
        col = F.coalesce(F.get(free, F.col("nth") - 1), F.get(free, F.lit(0)), F.lit(0))
        found = found.withColumn("col", col).withColumn("end_col", col + units(F.col("name")))
    else:
        found = found.withColumn("col", F.lit(0)).withColumn("end_col", F.length("name"))
    out = ["root_id", "path", "symbol", "line", "col", "end_col", "roles"]
    found = found.withColumn("line", F.col("line") - 1).withColumn("roles", F.lit(0))
    return defs.select(*out).unionByName(found.select(*out))


# ---- protobuf -----------------------------------------------------------------------------


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | str | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def document_bytes(path: str, language: str, found: list[dict], described: list[dict]) -> bytes:
    """One Document message (field 2 of an Index), ready to be appended to others."""
    body = _field(4, LANGUAGE_IDS.get(language, language)) + _field(1, path)
    for o in found:
        span = b"".join(_varint(n) for n in (o["line"], o["col"], o["end_col"]))
        body += _field(2, _field(1, span) + _field(2, o["symbol"]) + (_field(3, o["roles"]) if o["roles"] else b""))
    for d in described:
        body += _field(3, _field(1, d["symbol"]) + (_field(3, d["description"]) if d["description"] else b""))
    return _field(2, body)


def head_bytes(root: str, tool: str = "graphloom", version: str = "1") -> bytes:
    return _field(1, _field(2, _field(1, tool) + _field(2, version)) + _field(3, root))


def scip_documents(symbols: DataFrame, refs: DataFrame, files: DataFrame, project: str = "project", window: str = "default", lines: DataFrame | None = None) -> DataFrame:
    """One row per file: root_id, path, message. Files are encoded by the tasks; an index is the
    head and all messages one after another."""
    import pandas as pd

    occ = occurrences(symbols, refs, files, project, window, lines).withColumn("description", F.lit(None).cast("string"))
    info = definitions(symbols, files, project).select("root_id", "path", "symbol", "line", "col", "end_col", F.lit(-1).alias("roles"), "description")
    rows = occ.unionByName(info).join(files.select("root_id", "path", "language"), ["root_id", "path"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["line", "col", "roles", "symbol"])
        all_rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
        language = all_rows[0]["language"] or "plaintext"
        message = document_bytes(all_rows[0]["path"], language, [r for r in all_rows if r["roles"] >= 0], [r for r in all_rows if r["roles"] < 0])
        return pd.DataFrame({"root_id": [all_rows[0]["root_id"]], "path": [all_rows[0]["path"]], "message": [message]})

    return rows.groupBy("root_id", "path").applyInPandas(run, "root_id string, path string, message binary")


def scip_json(symbols: DataFrame, refs: DataFrame, files: DataFrame, root: str, project: str = "project", window: str = "default", lines: DataFrame | None = None) -> DataFrame:
    """One JSON line per document."""
    occ = occurrences(symbols, refs, files, project, window, lines)
    one = F.struct(F.array("line", "col", "end_col").alias("range"), "symbol", F.col("roles").alias("symbolRoles"))
    docs = occ.groupBy("root_id", "path").agg(F.array_sort(F.collect_list(one)).alias("occurrences"))
    docs = docs.join(files.select("root_id", "path", "language"), ["root_id", "path"], "left")
    return docs.select("root_id", "path", F.to_json(F.struct(F.col("path").alias("relativePath"), pick(LANGUAGE_IDS, F.coalesce("language", F.lit("")), "plaintext").alias("language"), "occurrences")).alias("json"))


# ---- line JSON ----------------------------------------------------------------------------


def lsif(symbols: DataFrame, refs: DataFrame, files: DataFrame, root: str, window: str = "default", lines: DataFrame | None = None) -> DataFrame:
    """Vertices and edges as (id, json) in order: head, documents, ranges and results.

    Ids are dense and follow a total order, so two runs give the same lines. They come from
    ranks that deal rows over ranges of the order, not from one sorting task.
    """
    spark = symbols.sparkSession
    occ = occurrences(symbols, refs, files, "project", window, lines)
    docs = occ.select("root_id", "path").distinct().join(files.select("root_id", "path", "language"), ["root_id", "path"], "left")
    head = [("", "", -3, "", 0, 0, json.dumps({"type": "vertex", "label": "metaData", "version": "0.4.3", "projectRoot": root})), ("", "", -2, "", 0, 0, json.dumps({"type": "vertex", "label": "project"}))]
    order = "root_id string, path string, tier int, symbol string, line int, col int, body string"
    uri = e.file_uri(F.lit(root), "path")
    doc = docs.select("root_id", "path", F.lit(-1).alias("tier"), F.lit("").alias("symbol"), F.lit(0).alias("line"), F.lit(0).alias("col"), F.to_json(F.struct(F.lit("vertex").alias("type"), F.lit("document").alias("label"), uri.alias("uri"), F.coalesce("language", F.lit("plaintext")).alias("languageId"))).alias("body"))
    span = F.struct(F.struct(F.col("line").alias("line"), F.col("col").alias("character")).alias("start"), F.struct(F.col("line").alias("line"), F.col("end_col").alias("character")).alias("end"))
    rng = occ.select("root_id", "path", F.lit(0).alias("tier"), "symbol", "line", "col", F.to_json(F.struct(F.lit("vertex").alias("type"), F.lit("range").alias("label"), span["start"].alias("start"), span["end"].alias("end"), F.col("symbol"), F.when(F.col("roles") == 1, F.lit("definition")).otherwise(F.lit("reference")).alias("role"), F.concat_ws("/", F.nullif("root_id", F.lit("")), F.col("path")).alias("document"))).alias("body"))
    res = occ.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("root_id", "path")).alias("p")).select(F.col("p.root_id").alias("root_id"), F.col("p.path").alias("path"), F.lit(1).alias("tier"), "symbol", F.lit(0).alias("line"), F.lit(0).alias("col"), F.to_json(F.struct(F.lit("vertex").alias("type"), F.lit("referenceResult").alias("label"), "symbol", F.col("n").alias("items"))).alias("body"))
    rows = spark.createDataFrame(head, order).unionByName(doc).unionByName(rng).unionByName(res)
    inside = Window.partitionBy("root_id", "path").orderBy("tier", "line", "col", "symbol", "body")
    sizes = rows.groupBy("root_id", "path").agg(F.count(F.lit(1)).alias("n"))
    # One row a file: the offsets are a running sum over files.
    offset = sizes.withColumn("before", F.sum("n").over(Window.orderBy("root_id", "path").rowsBetween(Window.unboundedPreceding, -1))).select("root_id", "path", F.coalesce("before", F.lit(0)).alias("before"))
    numbered = rows.withColumn("r", F.row_number().over(inside)).join(offset, ["root_id", "path"])
    return numbered.select((F.col("r") + F.col("before")).alias("id"), "body").select("id", F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit(","), F.substring("body", 2, 1 << 30)).alias("json"))
