"""Source texts to symbols, refs and violations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schema as s
from graphloom.extract import go, python, rust, typescript
from graphloom.extract.lex import ParseError
from graphloom.session import cut

EXTRACTORS = {"python": python.extract, "go": go.extract, "rust": rust.extract} | {x: typescript.extract for x in ("typescript", "tsx", "javascript", "jsx")}

_FIELDS = {"symbols": s.SYMBOLS, "refs": s.REFS, "violations": s.VIOLATIONS}
_TAGGED = "relation string, root_id string, path string, " + ", ".join(f"{name} struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in kind if f.name not in ('root_id', 'path'))}>" for name, kind in _FIELDS.items())


def one_file(language: str, content: bytes | None) -> list[tuple[str, dict]]:
    """The rows of one file. What can not be read gives one ``parse_error``, never an exception."""
    if content is None:
        return [("violations", {"kind": "parse_error", "line": 1, "snippet": "not readable"})]
    if language not in EXTRACTORS:
        return []
    try:
        text = content.decode("utf-8")
        found = EXTRACTORS[language](text, language)
    except UnicodeDecodeError:
        return [("violations", {"kind": "parse_error", "line": 1, "snippet": "not UTF-8"})]
    except ParseError as err:
        return [("violations", {"kind": "parse_error", "line": err.line, "snippet": str(err)[:200]})]
    except Exception as err:  # noqa: BLE001  a reader's fault is the file's: it counts as unread
        return [("violations", {"kind": "parse_error", "line": 1, "snippet": f"{type(err).__name__}: {err}"[:200]})]
    return [(name, row) for name in _FIELDS for row in getattr(found, name)]


def extract(sources: DataFrame) -> dict[str, DataFrame]:
    """symbols, refs and violations of ``sources`` (root_id, path, language, content).

    One pass over the files; it is checkpointed, so that each relation reads rows, not texts.
    """
    rows = sources.select("root_id", "path", "language", "content")
    names = [n for n in _FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches:
            for r in batch.to_pylist():
                out = [{"relation": n, "root_id": r["root_id"], "path": r["path"], n: row} for n, row in one_file(r["language"], r["content"])]
                if out:
                    if kinds is None:
                        kinds = _arrow()
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)

    tagged = cut(rows.mapInArrow(run, _TAGGED))
    return {n: tagged.where(F.col("relation") == n).select("root_id", "path", f"{n}.*").select(*[f.name for f in _FIELDS[n]]) for n in names}


def _arrow() -> pa.Schema:
    kind = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    part = lambda t: pa.struct([(f.name, kind[f.dataType.simpleString()]) for f in t if f.name not in ("root_id", "path")])
    return pa.schema([("relation", pa.string()), ("root_id", pa.string()), ("path", pa.string()), *[(n, part(t)) for n, t in _FIELDS.items()]])
