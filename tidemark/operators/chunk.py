"""Chunkers: a line heuristic for any text, syntax for seven languages."""

from __future__ import annotations

import ast
import re
import signal
import threading
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import model
from tidemark.functions import scalar, syntax
from tidemark.functions.batches import by_rows

SOFT_BYTES, HARD_BYTES = 1500, 6000
PARSE_SECONDS = 5.0


def _item(text: str, first: int, last: int, kind: str, status: str, trail: str = "") -> dict:
    return {"text": text, "breadcrumb": trail, "start_line": first, "end_line": last, "kind": kind, "parse_status": status}


def heuristic(source: str) -> list[dict]:
    """Blocks of lines. A block starts at a line that isn't blank; it ends with the line that makes
    it HARD_BYTES long, or at which no brace is open and the line is blank or the block SOFT_BYTES
    long, unless that is its first line. Blank lines at its end don't belong to it."""
    out: list[dict] = []
    block: list[str] = []
    first = depth = size = 0

    def close() -> None:
        nonlocal block, depth, size
        while block and not block[-1].strip():
            block.pop()
        out.append(_item("\n".join(block), first, first + len(block) - 1, "heuristic_block", "heuristic_fallback"))
        block, depth, size = [], 0, 0

    for number, line in enumerate(re.sub("\r\n?", "\n", source).split("\n"), 1):
        blank = not line.strip()
        if not block:
            if blank:
                continue
            first = number
        depth += line.count("{") - line.count("}")
        size += len(line.encode("utf-8", "surrogatepass")) + 1
        ends = depth <= 0 and (blank or size >= SOFT_BYTES) and bool(block)
        block.append(line)
        if ends or size >= HARD_BYTES:
            close()
        depth = max(depth, 0)
    if block:
        close()
    return out


def python_ast(source: str) -> list[dict]:
    """The innermost functions and classes of a Python text, with "Outer > inner" trails; decorators
    aren't part of a chunk."""
    lines = re.sub("\r\n?", "\n", source).split("\n")
    kinds = {ast.FunctionDef: "function_definition", ast.AsyncFunctionDef: "function_definition", ast.ClassDef: "class_definition"}
    out: list[dict] = []

    def visit(node: ast.AST, trail: tuple[str, ...]) -> bool:
        found = False
        for child in ast.iter_child_nodes(node):
            if type(child) in kinds:
                found = True
                inner = (*trail, child.name)
                if not visit(child, inner):
                    rows = lines[child.lineno - 1 : child.end_lineno]
                    rows[-1] = rows[-1].encode()[: child.end_col_offset].decode("utf-8", "replace")
                    rows[0] = rows[0].encode()[child.col_offset :].decode("utf-8", "replace")
                    out.append(_item("\n".join(rows), child.lineno, child.end_lineno, kinds[type(child)], "ok", " > ".join(inner)))
            else:
                found = visit(child, trail) or found
        return found

    visit(ast.parse("\n".join(lines)), ())
    return out


def scanned(language: str) -> Callable[[str], list[dict]]:
    """The chunker of a language that syntax.definitions scans."""

    def run(source: str) -> list[dict]:
        text = re.sub("\r\n?", "\n", source)
        line = lambda at: text.count("\n", 0, at) + 1
        return [_item(text[d.start : d.end], line(d.start), line(d.end - 1), d.kind, "ok", " > ".join(trail)) for d, trail in syntax.definitions(text, language)]

    return run


#: Syntax chunkers by language; languages without one go to the heuristic.
CHUNKERS: dict[str, Callable[[str], list[dict]]] = {"python": python_ast} | {x: scanned(x) for x in syntax.LANGUAGES}


@contextmanager
def time_limit(seconds: float):
    """TimeoutError in the block after so many seconds. Only a main thread can be interrupted (a
    Python worker's is); elsewhere the block runs unlimited."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_: object) -> None:
        raise TimeoutError("parsing took too long")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def chunk(source: str | None, language: str | None, reason: str | None) -> tuple[list[dict], str, str]:
    """(chunks, parse_status, quality) of one content whose preflight gave `reason`. A text that a
    syntax chunker can't parse, finds nothing in or takes PARSE_SECONDS for falls back to the
    heuristic. quality says "syntax" where a syntax chunker cut."""
    if source is None or reason in ("too_large", "binary"):
        return [], "ok", "skipped"
    if reason is None and language in CHUNKERS:
        try:
            with time_limit(PARSE_SECONDS):
                found = CHUNKERS[language](source)
            if found:
                return found, "ok", "syntax"
        except (SyntaxError, ValueError, RecursionError, MemoryError, TimeoutError):
            return heuristic(source), "crashed_fallback", "heuristic_fallback"
    return heuristic(source), "heuristic_fallback", "heuristic_fallback"


CHUNKED = T.StructType([T.StructField("items", T.ArrayType(model.CHUNK_ITEM)), T.StructField("parse_status", T.StringType()), T.StructField("quality", T.StringType())])


chunk_udf = by_rows(lambda source, language, reason: dict(zip(CHUNKED.names, chunk(source, language, reason))), CHUNKED)
heuristic_udf = by_rows(lambda source: heuristic(source) if source is not None else [], T.ArrayType(model.CHUNK_ITEM))


def chunk_rows(scrubbed: DataFrame) -> DataFrame:
    """Chunk rows of scrubbed raw rows: keys, hashes, breadcrumbs and provenance; cancelled rows and
    rows without chunks give none."""
    live = scrubbed.filter("scrub.cancel_reason is null")
    text = F.col("scrub.redacted_content")
    cut = live.withColumn("_c", chunk_udf(text, F.col("lang"), scalar.preflight(F.col("lang"), text)))
    flat = cut.select("*", F.posexplode("_c.items").alias("chunk_index", "_i"))
    prefix = F.coalesce(F.col("metadata")["path"], F.col("natural_key"))
    return flat.select(
        "source_id", "source_type", "repo", "lang", scalar.chunk_key(F.col("natural_key"), F.col("chunk_index"), F.col("_i.breadcrumb")).alias("chunk_key"), F.sha2("_i.text", 256).alias("content_hash"),
        F.col("_i.text").alias("content"), scalar.breadcrumb(prefix, F.col("_i.breadcrumb")).alias("context_breadcrumb"), "metadata", F.col("_c.parse_status").alias("parse_status"),
        F.col("scrub.secrets_status").alias("secrets_status"), "chunk_index", F.col("_i.start_line").alias("start_line"), F.col("_i.end_line").alias("end_line"), F.col("_c.quality").alias("quality"),
    )


def register(spark) -> None:
    """SQL functions: table function heuristic_chunks(text)."""

    class HeuristicChunks:
        def eval(self, source: str):
            for i, c in enumerate(heuristic(source or "")):
                yield i, c["text"], c["start_line"], c["end_line"]

    spark.udtf.register("heuristic_chunks", F.udtf(HeuristicChunks, returnType="chunk_index int, text string, start_line int, end_line int"))
