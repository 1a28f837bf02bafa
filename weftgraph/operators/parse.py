"""Python sources to nested rows: the one place where Python code is unavoidable, since it takes Python's own parser."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from .. import vocab
from ..schemas import PARSED, PIECES
from ..storage import cut

_CALLS = frozenset(vocab.BUILTIN_CALLS)
#: Letters of a piece: a syntax tree takes some hundred times the memory of its text.
PIECE = 1 << 16
_DEFINED = r"(?:async[ \t]+def|def|class)[ \t]"
_TOP = re.compile(rf"^(?:@[^\n]*\n)*{_DEFINED}", re.MULTILINE)
_CLASS_HEAD = re.compile(r"(?:@[^\n]*\n)*class[ \t]")
_CLASS_END = re.compile(r"^[^\s#)\]}]", re.MULTILINE)
_INNER = re.compile(rf"^([ \t]+)(?:@[^\n]*\n\1)*{_DEFINED}", re.MULTILINE)
_SPLIT = "file_path string, piece int, before int, owner string, bases array<string>, alone boolean, text string"


def _reference(node: ast.expr) -> str:
    """A name or dotted chain as text."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{_reference(node.value)}.{node.attr}"
    try:
        return ast.unparse(node)
    except Exception:
        return "<unknown>"


def _decorators(node) -> list[dict]:
    return [{"name": _reference(d.func if isinstance(d, ast.Call) else d), "is_call": isinstance(d, ast.Call)} for d in node.decorator_list]


def _called(node) -> list[str]:
    """Names called anywhere below a definition: its decorators, defaults and inner definitions included."""
    names = {c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute))}
    return sorted(names - _CALLS)


def _function(node, before: int = 0) -> dict:
    return {
        "name": node.name, "line_number": node.lineno + before, "arguments": [a.arg for a in node.args.args], "return_type": ast.unparse(node.returns) if node.returns else None,
        "docstring": ast.get_docstring(node), "calls": _called(node), "instantiates": [], "decorators": _decorators(node),
    }


def _bases(node: ast.ClassDef) -> list[str]:
    return [b.id if isinstance(b, ast.Name) else b.attr if isinstance(b, ast.Attribute) else ast.unparse(b) for b in node.bases]


def _class(node: ast.ClassDef, before: int = 0) -> dict:
    methods = [_function(m, before) for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
    return {"name": node.name, "line_number": node.lineno + before, "inherits_from": _bases(node), "docstring": ast.get_docstring(node), "methods": methods, "decorators": _decorators(node)}


def _imports(tree: ast.Module) -> list[str]:
    found = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            found |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
            found.add(node.module)
    return sorted(found)


def parse_source(path: str, content: bytes | None) -> dict:
    """One PARSED row. Bytes that are no UTF-8 are replaced; a source that doesn't parse has its error instead."""
    row = {"file_path": path, "imports": [], "classes": [], "functions": [], "parse_error": None}
    try:
        tree = ast.parse((content or b"").decode("utf-8", errors="replace"))
        row["imports"] = _imports(tree)
        row["classes"] = [_class(n) for n in tree.body if isinstance(n, ast.ClassDef)]
        row["functions"] = [_function(n) for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    except (SyntaxError, ValueError, RecursionError) as error:
        row |= {"imports": [], "classes": [], "functions": [], "parse_error": f"{type(error).__name__}: {error}"}
    return row


def _packed(starts: list[int], end: int, first: int = 1) -> list[tuple[int, int]]:
    """Ranges of about PIECE letters that begin at ``starts``; the first range holds ``first`` of them at least."""
    out, begin = [], starts[0]
    for k, (here, there) in enumerate(zip(starts, [*starts[1:], end], strict=True)):
        if k >= first and here > begin and there - begin > PIECE:
            out.append((begin, here))
            begin = here
    return [*out, (begin, end)]


def _class_pieces(unit: str) -> list[tuple[int, str | None, list[str] | None, str]] | None:
    """(offset, owner, bases, text) of a class cut between its methods; None if it can't be."""
    end = next((m.start() for m in _CLASS_END.finditer(unit, _CLASS_HEAD.match(unit).end())), len(unit))
    first = _INNER.search(unit, 0, end)
    if first is None:
        return None
    indent = first[1]
    starts = [0, *[m.start() for m in _INNER.finditer(unit, 0, end) if m[1] == indent]]
    try:
        head = ast.parse(f"{unit[: starts[1]]}{indent}pass\n").body
    except (SyntaxError, ValueError, RecursionError):
        return None
    if len(head) != 1 or not isinstance(head[0], ast.ClassDef) or any(s.col_offset != len(indent) for s in head[0].body):
        return None  # what is indented so is not the body of the class
    pieces = [(a, head[0].name if a else None, _bases(head[0]) if a else None, unit[a:b]) for a, b in _packed(starts, end, 2)]
    return pieces + ([(end, None, None, unit[end:])] if end < len(unit) else [])


def split(text: str) -> list[dict]:
    """Pieces of a source: before (lines before it), owner and bases (of a class that it continues), alone (it must be one statement), text.

    Cuts are made where definitions seem to begin.  A piece that can be parsed
    ends outside of strings, brackets and statements, so that if all can, they
    hold the statements of the whole; if one can't, the source is parsed whole.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n")  # as the parser reads line ends
    cuts = [(0, None, None, False, text)]
    if len(text) > PIECE:
        cuts = []
        for a, b in _packed([0, *[m.start() for m in _TOP.finditer(text) if m.start()]], len(text)):
            inner = _class_pieces(text[a:b]) if b - a > PIECE and _CLASS_HEAD.match(text, a) else None
            cuts += [(a + at, owner, bases, len(inner) > 1 and k == 0, t) for k, (at, owner, bases, t) in enumerate(inner)] if inner else [(a, None, None, False, text[a:b])]
    out, lines, at = [], 0, 0
    for offset, owner, bases, alone, t in cuts:
        lines, at = lines + text.count("\n", at, offset), offset
        out.append({"before": lines, "owner": owner, "bases": bases, "alone": alone, "text": t})
    return out


def parse_piece(path: str, piece: dict, whole: bool) -> dict:
    """One PIECES row; the error of a source in one piece is its parse_error, that of a piece says that it failed."""
    row = {"file_path": path, "imports": [], "classes": [], "functions": [], "parse_error": None, "piece": piece["piece"], "continued": piece["owner"] is not None, "failed": False}
    before, text = piece["before"], piece["text"]
    if row["continued"]:
        before, text = before - 1, f"class _:\n{text}"
    try:
        tree = ast.parse(text)
        if (piece["alone"] or row["continued"]) and len(tree.body) != 1:
            return row | {"failed": True}
        found = {"imports": _imports(tree), "classes": [_class(n, before) for n in tree.body if isinstance(n, ast.ClassDef)], "functions": [_function(n, before) for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]}
    except (SyntaxError, ValueError, RecursionError) as error:
        return row | ({"parse_error": f"{type(error).__name__}: {error}"} if whole else {"failed": True})
    if row["continued"]:
        found["classes"] = [found["classes"][0] | {"name": piece["owner"], "inherits_from": piece["bases"], "line_number": None, "docstring": None}]
    return row | found


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(_parse_datatype_string(schema))


def parse(sources: DataFrame) -> DataFrame:
    """``sources`` (rel_path, content) to PARSED rows, one a file; a file is parsed in one go."""
    schema = _arrow(PARSED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["rel_path"], batch["content"], strict=True):
                yield pa.RecordBatch.from_pylist([parse_source(path.as_py(), content.as_py())], schema=schema)

    return sources.select("rel_path", "content").mapInArrow(run, PARSED)


def pieces(sources: DataFrame) -> DataFrame:
    """``sources`` (rel_path, content) to PIECES rows: large files are cut, and their pieces dealt to all tasks, so that neither time nor memory of a task follows a file's size."""
    spark, parts, cut_up = sources.sparkSession, _arrow(_SPLIT), _arrow(PIECES)

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["rel_path"], batch["content"], strict=True):
                found = split((content.as_py() or b"").decode("utf-8", errors="replace"))
                for k in range(0, len(found), 16):
                    yield pa.RecordBatch.from_pylist([x | {"file_path": path.as_py(), "piece": k + j if len(found) > 1 else -1} for j, x in enumerate(found[k : k + 16])], schema=parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4):
                rows = [parse_piece(x["file_path"], x, x["piece"] < 0) for x in batch.slice(k, 4).to_pylist()]
                yield pa.RecordBatch.from_pylist(rows, schema=cut_up)

    tasks = 4 * spark.sparkContext.defaultParallelism
    divided = sources.select("rel_path", "content").repartition(tasks, "rel_path").mapInArrow(divide, _SPLIT).repartition(tasks, "file_path", "piece")
    out = cut(divided.mapInArrow(run, PIECES))
    failed = out.filter("failed").select("file_path").distinct()
    if failed.isEmpty():
        return out
    again = parse(sources.join(failed.withColumnRenamed("file_path", "rel_path"), "rel_path", "left_semi"))
    none = F.lit(False)
    return cut(out.join(failed, "file_path", "left_anti").unionByName(again.select("*", F.lit(-1).alias("piece"), none.alias("continued"), none.alias("failed"))))


def symbols(parsed: DataFrame) -> DataFrame:
    """One row a class, method or function of PARSED or PIECES rows: file_path, kind, owner, ord (file order within), and the definition's columns."""
    if "piece" not in parsed.columns:
        parsed = parsed.withColumns({"piece": F.lit(-1), "continued": F.lit(False)})
    ok = parsed.filter("parse_error IS NULL")
    classes = ok.select("file_path", "piece", "continued", F.posexplode("classes").alias("pos", "c"))
    as_class = classes.filter("NOT continued").select("file_path", F.lit("Class").alias("kind"), F.lit(None).cast("string").alias("owner"), F.array("piece", "pos", F.lit(-1)).alias("ord"), *_columns("c", "inherits_from"))
    methods = classes.select("file_path", "piece", "pos", F.col("c.name").alias("owner"), F.col("c.inherits_from").alias("bases"), F.posexplode("c.methods").alias("mpos", "m"))
    as_method = methods.select("file_path", F.lit("Method").alias("kind"), "owner", F.array("piece", "pos", "mpos").alias("ord"), *_columns("m", None, F.col("bases")))
    functions = ok.select("file_path", "piece", F.posexplode("functions").alias("pos", "f"))
    as_function = functions.select("file_path", F.lit("Function").alias("kind"), F.lit(None).cast("string").alias("owner"), F.array(F.lit(1 << 30), F.col("piece"), F.col("pos")).alias("ord"), *_columns("f", None))
    return as_class.unionByName(as_method).unionByName(as_function)


def by_file(parsed: DataFrame) -> DataFrame:
    """(file_path, imports, classes, methods, functions, broken) of PIECES rows: one row a file, its imports in order and how much it defines."""
    own = F.when(F.col("continued"), 0).otherwise(F.size("classes"))
    methods = F.aggregate("classes", F.lit(0).cast("long"), lambda a, c: a + F.size(c["methods"]))
    counts = [F.sum(c).cast("long").alias(n) for n, c in (("classes", own), ("methods", methods), ("functions", F.size("functions")))]
    return parsed.groupBy("file_path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("imports")))).alias("imports"), *counts, F.max(F.col("parse_error").isNotNull()).alias("broken"))


def _columns(s: str, bases: str | None, given: Column | None = None) -> list[Column]:
    of = F.col(f"{s}.{bases}") if bases else given if given is not None else F.array().cast("array<string>")
    calls = F.array().cast("array<string>") if bases else F.col(f"{s}.calls")
    return [F.col(f"{s}.name").alias("name"), F.col(f"{s}.line_number").alias("line_number"), F.col(f"{s}.docstring").alias("docstring"), of.alias("bases"), calls.alias("calls"), F.col(f"{s}.decorators").alias("decorators")]
