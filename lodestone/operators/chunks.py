"""Chunks of source files: one for each symbol, one for the file, windows of lines, or symbols with windows in their gaps."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.functions.semantic import semantic_text
from lodestone.parsing.symbols import symbols
from lodestone.session import ship

WINDOW, OVERLAP, GAP = 64, 16, 5
#: Characters kept of a file for its own chunk, and of any chunk in the index.
MODULE_CHARS, RAW_CHARS = 2000, 4000
STRATEGIES = ("ast", "sliding", "hybrid")
_ENDS = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
_ROW = "id string, file_path string, language string, chunk_type string, name string, raw_content string, start_line int, end_line int, parent_name string, doc string"


def make_id(path: str, name: str, row: int) -> str:
    return hashlib.sha256(f"{path}::{name}::{row}".encode("utf-8", "surrogatepass")).hexdigest()[:16]


def stem(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


def lines_of(text: str) -> list[str]:
    """Lines with their ends."""
    cut = [0, *(m.end() for m in _ENDS.finditer(text))]
    return [text[a:b] for a, b in zip(cut, [*cut[1:], len(text)], strict=True) if a < b]


def windows(lines: list[str], first: int, last: int, size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, content) of windows over lines first to last (from 1), up to the one that reaches the end."""
    at, stride = first, max(1, size - overlap)
    while at <= last:
        end = min(at + size - 1, last)
        yield at, end, "".join(lines[at - 1 : end])
        if end == last:
            return
        at += stride


def chunks_of(path: str, language: str, text: str, strategy: str = "ast", size: int = WINDOW, overlap: int = OVERLAP) -> list[tuple]:
    """Rows of a file's chunks, without sentences."""
    out: list[tuple] = []
    found = symbols(text, language) if strategy != "sliding" else []
    line = 1
    at = 0
    covered: list[tuple[int, int]] = []
    if found:
        out.append((make_id(path, "__module__", 0), path, language, "module", stem(path), text[:MODULE_CHARS], 1, text.count("\n") + 1, None, None))
    for s in found:
        line += text.count("\n", at, s.start)
        at = s.start
        end = line + text.count("\n", s.start, s.end)
        out.append((make_id(path, s.name, line - 1), path, language, s.kind, s.name, text[s.start : s.end], line, end, s.parent, s.doc))
        covered.append((line, end))
    if strategy == "ast" or (strategy == "hybrid" and not text):
        return out
    lines = lines_of(text)
    if not found:
        for a, b, said in windows(lines, 1, len(lines), size, overlap):
            out.append((make_id(path, f"__window_{a - 1}__", a - 1), path, language, "window", f"{stem(path)}:{a}-{b}", said, a, b, None, None))
        return out
    free = 1
    for a, b in [*sorted(covered), (len(lines) + 1, len(lines) + 1)]:
        if a - free >= GAP:
            for x, y, said in windows(lines, free, a - 1, size, overlap):
                out.append((make_id(path, f"__gap_{x}__", x), path, language, "window", f"{stem(path)}:{x}-{y}", said, x, y, None, None))
        free = max(free, b + 1)
    return out


def chunk_files(files: DataFrame, strategy: str = "ast", size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of files (file_path, language, text): their fields and semantic_text. Other columns are not looked at.

    A file that can't be taken apart gives one row of chunk_type "error" that holds the message. No shuffle; one file's
    chunks are in memory. Null texts and languages without a parser give no symbols.
    """
    if strategy not in STRATEGIES:
        strategy = "ast"
    ship(files.sparkSession)
    schema = to_arrow_schema(T._parse_datatype_string(_ROW))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, language, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    rows = chunks_of(path, language, text or "", strategy, size, overlap)
                except Exception as e:
                    rows = [(make_id(path, "__error__", 0), path, language, "error", "", f"{type(e).__name__}: {e}", 0, 0, None, None)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    got = files.filter("language IS NOT NULL AND file_path IS NOT NULL").select("file_path", "language", "text").mapInArrow(run, _ROW)
    said = semantic_text(*(F.col(c) for c in ("chunk_type", "name", "language", "file_path", "raw_content", "parent_name", "doc", "start_line", "end_line")))
    got = got.withColumn("semantic_text", F.when(F.col("chunk_type") != "error", said))
    return got.withColumn("raw_content", F.substring("raw_content", 1, RAW_CHARS)).withColumn("parent_name", F.coalesce("parent_name", F.lit(""))).drop("doc")
