"""Chunking by lines and of configuration files, in DataFrame expressions; JSON by a scanner.

Chunkers take files with columns (file_id, content) and return (file_id, ord,
content, symbol, symbol_kind, start_line, end_line); lines count from 1,
inclusive. Null or blank contents give no chunks.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import is_blank, lines, trimmed

WINDOW, OVERLAP = 60, 5
Line = Callable[[Column], Column]
CHUNK_COLUMNS = ["file_id", "ord", "content", "symbol", "symbol_kind", "start_line", "end_line"]
CHUNK_SCHEMA = "file_id long, ord int, content string, symbol string, symbol_kind string, start_line int, end_line int"


def _null() -> Column:
    return F.lit(None).cast("string")


def chunk_by_lines(files: DataFrame, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Windows of lines, each overlapping the one before; the last ends with the file; blank windows are dropped."""
    stride = window - overlap
    rows = files.select("file_id", lines(F.col("content")).alias("_lines")).where(F.size("_lines") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_lines") - overlap - 1), F.lit(stride))
    rows = rows.select("file_id", "_lines", F.posexplode(starts).alias("ord", "_s"))
    content = F.array_join(F.slice("_lines", F.col("_s") + 1, window), "\n")
    out = rows.select("file_id", "ord", content.alias("content"), _null().alias("symbol"), _null().alias("symbol_kind"), (F.col("_s") + 1).alias("start_line"), F.least(F.col("_s") + window, F.size("_lines")).alias("end_line"))
    return out.where(~is_blank(F.col("content")))


def chunk_env(files: DataFrame) -> DataFrame:
    """A chunk per line that is neither blank nor a comment; the symbol is the trimmed text before the first =."""
    rows = files.select("file_id", F.posexplode(lines(F.col("content"))).alias("ord", "content"))
    rows = rows.where(~is_blank(F.col("content")) & ~trimmed(F.col("content")).startswith("#"))
    line = (F.col("ord") + 1).cast("int")
    return rows.select("file_id", "ord", "content", trimmed(F.substring_index("content", "=", 1)).alias("symbol"), F.lit("env_var").alias("symbol_kind"), line.alias("start_line"), line.alias("end_line"))


def _blocks(files: DataFrame, header: Line, symbol: Line, kind: str, keep_preamble: bool) -> DataFrame:
    """Blocks of lines from one header line to the next: a fold over the lines of each file, no shuffle.

    header tells whether a line begins a block, symbol names it.
    """
    rows = files.where(~is_blank(F.col("content"))).select("file_id", lines(F.col("content")).alias("_lines"))
    heads = F.array_compact(F.transform("_lines", lambda l, i: F.when(header(l), i + 1)))  # noqa: E741
    rows = rows.withColumn("_heads", heads)
    first = F.when(F.size("_heads") == 0, F.lit(None)).otherwise(F.try_element_at("_heads", F.lit(1)))
    starts = F.when(F.size("_heads") == 0, F.array(F.lit(1))).when(first == 1, F.col("_heads")).otherwise(F.concat(F.array(F.lit(1)), F.col("_heads"))) if keep_preamble else F.col("_heads")
    rows = rows.withColumn("_starts", starts).where(F.size("_starts") > 0)
    rows = rows.select("file_id", "_lines", "_heads", "_starts", F.posexplode("_starts").alias("ord", "start_line"))
    rows = rows.withColumn("end_line", F.coalesce(F.try_element_at("_starts", F.col("ord") + 2) - 1, F.size("_lines")))
    content = F.array_join(F.slice("_lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    at_head = F.array_contains("_heads", F.col("start_line"))
    named = F.when(at_head, symbol(F.try_element_at("_lines", F.col("start_line"))))
    if keep_preamble:  # a preamble before a section has an empty name, a file without sections none
        named = F.when(at_head, named).when(F.size("_heads") > 0, F.lit(""))
    out = rows.select("file_id", "ord", content.alias("content"), named.alias("symbol"), F.lit(kind).alias("symbol_kind"), F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"))
    return out.where(~is_blank(F.col("content")))


def chunk_toml(files: DataFrame) -> DataFrame:
    """Sections by their [headers]; text before the first is a chunk of its own."""
    header = lambda l: trimmed(l).startswith("[") & F.contains(l, F.lit("]"))  # noqa: E731,E741
    symbol = lambda l: F.substring_index(F.regexp_replace(trimmed(l), r"^\[+", ""), "]", 1)  # noqa: E731,E741
    return _blocks(files, header, symbol, "section", keep_preamble=True)


def chunk_yaml(files: DataFrame) -> DataFrame:
    """Blocks of top-level keys with what is nested below them."""
    header = lambda l: (F.length(l) > 0) & ~l.rlike(r"^([ \t#]|---|\.\.\.)")  # noqa: E731,E741
    symbol = lambda l: F.nullif(trimmed(F.substring_index(l, ":", 1)), F.lit(""))  # noqa: E731,E741
    return _blocks(files, header, symbol, "key", keep_preamble=False)


def scan_json(text: str) -> list[tuple[str | None, str, int, int]]:
    """(key, content, first line, last line) of each top-level entry; a text that is no object, or an empty one, is one entry without key."""
    total = max(1, len(text.splitlines()))
    whole = [(None, text, 1, total)]
    i, n = 0, len(text)
    while i < n and text[i].isspace():
        i += 1
    if i == n or text[i] != "{":
        return whole
    i += 1
    out: list[tuple[str | None, str, int, int]] = []
    line_at = lambda k: text.count("\n", 0, k) + 1
    while True:
        while i < n and text[i] != '"' and text[i] != "}":
            i += 1
        if i >= n or text[i] == "}":
            break
        start, key = i, []
        i += 1
        while i < n and text[i] != '"':
            if text[i] == "\\" and i + 1 < n:
                i += 1
            key.append(text[i])
            i += 1
        i += 1
        while i < n and text[i] != ":":
            i += 1
        i += 1
        while i < n and text[i].isspace():
            i += 1
        a, depth, quoted = i, 0, False
        while i < n:
            c = text[i]
            if quoted:
                if c == "\\":
                    i += 1
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c in "{[":
                depth += 1
            elif c in "}]":
                if not depth:
                    break
                depth -= 1
            elif c == "," and not depth:
                break
            i += 1
        value = text[a:i].strip()
        name = "".join(key)
        out.append((name, f'"{name}": {value}', line_at(start), line_at(max(a, a + len(text[a:i].rstrip()) - 1))))
        if i < n and text[i] == ",":
            i += 1
    return out or whole


def chunk_json(files: DataFrame) -> DataFrame:
    """A chunk per top-level key, in order, with its raw value."""

    def run(batches):
        for pdf in batches:
            rows = []
            for file_id, content in zip(pdf["file_id"], pdf["content"]):
                if content is not None and content.strip():
                    rows += [(file_id, k, c, key, "key" if key is not None else None, a, z) for k, (key, c, a, z) in enumerate(scan_json(content))]
            yield pd.DataFrame(rows, columns=CHUNK_COLUMNS)

    return files.select(F.col("file_id").cast("long"), "content").mapInPandas(run, CHUNK_SCHEMA)


def enrich(path: Column, content: Column, symbol: Column, kind: Column, language: Column) -> Column:
    """The text that is embedded: file, symbol and language lines, a blank one, the content."""
    both = symbol.isNotNull() & kind.isNotNull()
    head = F.concat(
        F.concat(F.lit("File: "), path, F.lit("\n")),
        F.when(both, F.concat(kind, F.lit(": "), symbol, F.lit("\n"))).otherwise(""),
        F.when(language != "unknown", F.concat(F.lit("Language: "), language, F.lit("\n"))).otherwise(""),
    )
    return F.concat(head, F.lit("\n"), content)


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    """chunk_id from the file and the chunk's place in it: the same for every run, and no global sort. A file of over 2^20 chunks raises."""
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("ord", "start_line"))
    place = F.when(place <= 1 << 20, place - 1).otherwise(F.raise_error(F.lit("a file has more than 2^20 chunks")).cast("int"))
    return chunks.withColumn("chunk_id", F.col("file_id") * F.lit(1 << 20) + place)
