"""Reading SQL dump files into statements and rows, with a ledger of files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.sources.scratch import save

KINDS = ("INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER")
_QUOTED = r"'(?:[^'\\]|\\.|'')*(?:'|\Z)|\"(?:[^\"\\]|\\.|\"\")*(?:\"|\Z)|`(?:[^`]|``)*(?:`|\Z)"
_SPECIAL = re.compile(r"['\"`;#]|--(?=\s|\Z)|/\*")
_IN_QUOTE = {"'": re.compile(r"[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+", re.S), '"': re.compile(r"[^\"\\]*+(?:(?:\\.|\"\")[^\"\\]*+)*+", re.S), "`": re.compile(r"[^`]*+(?:``[^`]*+)*+")}
#: What a text may start in: plain SQL, one of the quotes, a block comment.
MODES = ("", "'", '"', "`", "*")
_INSERT = re.compile(rf"^\s*(?:INSERT|REPLACE)\s+(?:\w+\s+)*?INTO\s+(`[^`]+`|[\w.]+)\s*(?:\(([^)]*)\))?\s*VALUES\s*", re.I | re.S)
_VALUE = re.compile(rf"(?P<quoted>{_QUOTED})|(?P<mark>[(),])|(?P<plain>[^'\"`(),]+)", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a"}


def _lex(text: str, mode: str) -> Iterator[tuple[str | None, str]]:
    """(kept text, mode after it) pieces of a text that starts in ``mode``; None for the end of a statement. Comments are left out."""
    at, n = 0, len(text)
    while at < n:
        if mode == "*":
            end = text.find("*/", at)
            if end < 0:
                yield "", mode
                return
            at, mode = end + 2, ""
        elif mode:
            end = _IN_QUOTE[mode].match(text, at).end()
            if end >= n:
                yield text[at:], mode
                return
            piece, at, mode = text[at : end + 1], end + 1, ""
            yield piece, mode
        else:
            found = _SPECIAL.search(text, at)
            if not found:
                yield text[at:], mode
                return
            mark, start = found.group(), found.start()
            if mark in ("#", "--"):
                end = text.find("\n", start)
                yield text[at:start], mode
                at = n if end < 0 else end
            elif mark == ";":
                yield text[at:start], mode
                yield None, mode
                at = start + 1
            elif mark == "/*":
                mode = "*"
                yield text[at:start], mode
                at = start + 2
            else:
                mode = mark
                yield text[at : start + 1], mode
                at = start + 1


def _typed(sql: str) -> str:
    word = sql.split(None, 1)[0].upper()
    return word if word in KINDS else "OTHER"


def split_statements(text: str) -> Iterator[tuple[str, str]]:
    """(type, statement): quotes and comments are respected, a tail without a semicolon is OTHER."""
    kept: list[str] = []
    for piece, _ in _lex(text, ""):
        if piece is not None:
            kept.append(piece)
        elif sql := "".join(kept).strip():
            yield _typed(sql), sql
            kept.clear()
        else:
            kept.clear()
    if sql := "".join(kept).strip():
        yield "OTHER", sql


def _unquote(s: str) -> str:
    q = s[0]
    body = s[1:-1] if len(s) > 1 and s[-1] == q else s[1:]
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), body.replace(q * 2, q), flags=re.S)


def split_tuples(sql: str) -> tuple[str, list[str], list[list[str | None]]] | None:
    """(table, columns, tuples) of a multi-row INSERT; None for another statement. NULL becomes None."""
    head = _INSERT.match(sql)
    if not head:
        return None
    rows, row, value, depth, quoted = [], [], "", 0, False
    for m in _VALUE.finditer(sql, head.end()):
        part = m.group()
        if m.lastgroup == "mark" and part == "(":
            depth += 1
            if depth == 1:
                row, value, quoted = [], "", False
                continue
        if m.lastgroup == "mark" and depth == 1 and part in ",)":
            row.append(value if quoted else None if value.strip().upper() == "NULL" else value.strip())
            value, quoted = "", False
            if part == ")":
                depth = 0
                rows.append(row)
            continue
        if part == ")":
            depth -= 1
        if depth >= 1:
            if m.lastgroup == "quoted" and depth == 1:
                value, quoted = _unquote(part), True
            elif not quoted:
                value += part
    columns = [c.strip().strip("`") for c in (head[2] or "").split(",") if c.strip()]
    return head[1].strip("`"), columns, rows


@dataclass
class _Effect:
    """What a text does to the statement that is open before it: where it leaves the lexer, and which statements aren't blank."""

    mode: str
    ends: bool = False  # a statement ends in it
    head: bool = False  # text before the first end, or in all of it
    between: int = 0  # statements with text between the first and the last end
    tail: bool = False  # text after the last end

    def then(self, pieces: Iterator[tuple[str | None, str]]) -> None:
        for piece, mode in pieces:
            self.mode = mode
            if piece is None:
                self.between += self.ends and self.tail
                self.ends, self.tail = True, False
            elif piece.strip():
                if self.ends:
                    self.tail = True
                else:
                    self.head = True


#: Lines that are lexed at once; what is made of them takes several times their room.
_LINES = 256


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, str, bool]]:
    """(first row, text, whether a chunk of a file begins here) of the rows that follow each other in one chunk."""
    last = None
    for pdf in batches:
        key = list(zip(pdf["path"], pdf["block"]))
        cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
        for begin, end in zip(cuts, cuts[1:]):
            for a in range(begin, end, _LINES):
                yield pdf.iloc[a], "\n".join(pdf["value"].iloc[a : min(a + _LINES, end)]) + "\n", key[a] != last
                last = key[a]


def _effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each chunk what it does from each mode."""
    names = ["path", "block", "start", "mode", "ends", "head", "between", "tail"]
    row, effects = None, {}
    out = lambda: pd.DataFrame([(row["path"], row["block"], m, e.mode, e.ends, e.head, e.between, e.tail) for m, e in effects.items()], columns=names)
    for first, text, begins in _chunks(batches):
        if begins:
            if row is not None:
                yield out()
            row, effects = first, {m: _Effect(m) for m in MODES}
        by_mode: dict[str, list[_Effect]] = {}
        for e in effects.values():
            by_mode.setdefault(e.mode, []).append(e)
        for now, alike in by_mode.items():
            pieces = list(_lex(text, now))
            for e in alike:
                e.then(iter(pieces))
    if row is not None:
        yield out()


def _starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where each chunk of one file starts: the mode, whether the open statement has text, and its number."""
    mode, filled, number, rows = "", False, 0, []
    for block, part in pdf.sort_values("block").groupby("block"):
        e = part[part["start"] == mode].iloc[0]
        rows.append((pdf["path"].iloc[0], block, mode, filled, number))
        if e["ends"]:
            number += int(filled or e["head"]) + int(e["between"])
            filled = bool(e["tail"])
        else:
            filled = bool(filled or e["head"])
        mode = e["mode"]
    return pd.DataFrame(rows, columns=["path", "block", "mode", "filled", "number"])


def _fragments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, block, stmt_no, ended, whole, sql): whole statements of a chunk, and the parts of those that it shares with others."""
    rows, kept, row = [], [], None
    mode, filled, number, inside = "", False, 0, False

    def take(ended: bool) -> None:
        nonlocal filled, number, inside
        sql = "".join(kept)
        if sql.strip() or filled:
            rows.append((row["path"], row["block"], number, ended, inside and ended, sql))
        if ended:
            number += bool(sql.strip() or filled)
            filled, inside = False, True
        kept.clear()

    def out() -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=["path", "block", "stmt_no", "ended", "whole", "sql"])
        rows.clear()
        return made

    for first, text, begins in _chunks(batches):
        if begins:
            if row is not None:
                take(False)
            row, mode, filled, number, inside = first, first["mode"], bool(first["filled"]), int(first["number"]), False
        for piece, mode in _lex(text, mode):
            if piece is None:
                take(True)
            else:
                kept.append(piece)
        yield out()
    if row is not None:
        take(False)
        yield out()


#: Hashes of lines are the digits of a number in this base, modulo a prime, so that those of chunks give that of the file.
_BASE, _PRIME = int.from_bytes(hashlib.sha256(b"lines").digest()[:15], "big"), (1 << 127) - 1


def _chunk_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[tuple[str, int], tuple[int, int]] = {}  # of the few chunks of one task
    for pdf in batches:
        for path, block, line in zip(pdf["path"], pdf["block"], pdf["value"]):
            value, n = held.get((path, block), (0, 0))
            digest = int.from_bytes(hashlib.md5(line.encode(), usedforsecurity=False).digest(), "big")
            held[path, block] = (value * _BASE + digest) % _PRIME, n + 1
    yield pd.DataFrame([(path, block, n, f"{value:x}") for (path, block), (value, n) in held.items()], columns=["path", "block", "n", "hash"])


@F.pandas_udf(T.StringType())
def _joined_hash(chunks: pd.Series) -> pd.Series:
    """The hash of a file from the (block, n, hash) of its chunks in order."""

    def one(parts) -> str:
        value = lines = 0
        for part in parts:
            n = int(part["n"])
            value, lines = (value * pow(_BASE, n, _PRIME) + int(part["hash"], 16)) % _PRIME, lines + n
        return hashlib.md5(f"{lines}:{value:x}".encode(), usedforsecurity=False).hexdigest()

    return chunks.map(one)


def file_hashes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, file, hash): a hash of the lines of files of any size, made of those of the chunks that Spark reads; the same however Spark cuts them.

    Spark cuts by the sizes of all files that are read together, so a file may come in other chunks each time.
    """
    lines = spark.read.text(paths, lineSep="\n").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    chunks = lines.mapInPandas(_chunk_hashes, "path string, block long, n long, hash string")
    each = chunks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block", "n", "hash"))).alias("chunks"))  # one entry a chunk
    return each.select("path", F.regexp_extract("path", "[^/]+$", 0).alias("file"), _joined_hash("chunks").alias("hash"))


def read_sql_dump(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, stmt_no, stmt_type, sql), one row per statement. Files of any size are read in chunks, side by side.

    A first pass finds what each chunk does to the lexer from each mode it may start in, a chain over the chunks of a file
    gives the mode in which each does start, and a second pass cuts it. Parts of statements that go over chunks are glued,
    so only a statement, not a file, must fit a row. Lines end with a line feed.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    effects = lines.mapInPandas(_effects, "path string, block long, start string, mode string, ends boolean, head boolean, between long, tail boolean")
    starts = save(effects.groupBy("path").applyInPandas(_starts, "path string, block long, mode string, filled boolean, number long"), "starts")
    placed = lines.join(F.broadcast(starts), ["path", "block"])  # one row for each chunk that Spark reads
    parts = save(placed.mapInPandas(_fragments, "path string, block long, stmt_no long, ended boolean, whole boolean, sql string"), "parts")
    glued = parts.where("not whole").groupBy("path", "stmt_no").agg(F.max("ended").alias("ended"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "sql"))), lambda p: p["sql"]), "").alias("sql"))
    every = parts.where("whole").select("path", "stmt_no", "ended", "sql").unionByName(glued.select("path", "stmt_no", "ended", "sql"))
    text = F.regexp_replace("sql", r"(?U)^\s++|(?<!\s)\s++$", "")
    word = F.upper(F.regexp_extract(F.col("text"), r"(?U)^\S+", 0))
    kind = F.when(F.col("ended") & word.isin(list(KINDS)), word).otherwise("OTHER")
    return every.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "stmt_no", "ended", text.alias("text")).where("text <> ''").select("file", "stmt_no", kind.alias("stmt_type"), F.col("text").alias("sql"))


#: Rows taken out of an Arrow batch at once, and about how many characters of tuples are handed on at once.
_ROWS, _CHARACTERS = 16, 1_000_000
_TUPLE = pa.schema([("file", pa.string()), ("stmt_no", pa.int64()), ("tuple_no", pa.int64()), ("batch_no", pa.int64()), ("table", pa.string()), ("columns", pa.list_(pa.string())), ("values", pa.list_(pa.string()))])
_TUPLE_DDL = "file string, stmt_no long, tuple_no long, batch_no long, table string, columns array<string>, values array<string>"


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches, of which only a few are Python objects at a time."""
    for batch in batches:
        for at in range(0, len(batch), _ROWS):
            yield from zip(*[c.to_pylist() for c in batch.slice(at, _ROWS).columns])


def _tuples(inserts: Iterator[tuple[str, int, str]], batch: int) -> Iterator[pa.RecordBatch]:
    """The tuples of (file, stmt_no, sql) statements, handed on as soon as they have about ``_CHARACTERS`` characters."""
    rows, held = [], 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _TUPLE)], schema=_TUPLE)
    for file, no, sql in inserts:
        if found := split_tuples(sql):
            table, columns, values = found
            for i, row in enumerate(values):
                rows.append((file, no, i + 1, i // batch, table, columns, row))
                held += 100 + sum(len(v) for v in row if v is not None)
                if held >= _CHARACTERS:
                    yield out()
                    rows, held = [], 0
    if rows:
        yield out()


def insert_rows(statements: DataFrame, batch: int = 1000) -> DataFrame:
    """(file, stmt_no, tuple_no, batch_no, table, columns, values) of the INSERT statements, one row per tuple."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _tuples(_few(batches), batch)

    inserts = statements.where(F.col("stmt_type") == "INSERT").select("file", F.col("stmt_no").cast("long"), "sql")
    return inserts.mapInArrow(split, _TUPLE_DDL)


def text_rows(texts: DataFrame, batch: int = 1000) -> DataFrame:
    """``insert_rows`` of dumps that are a row each, (file, value): a text's statements and their tuples are cut in the same worker, one after the other."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inserts = ((file, no, sql) for file, text in _few(batches) for no, (kind, sql) in enumerate(split_statements(text)) if kind == "INSERT")
        return _tuples(inserts, batch)

    return texts.select("file", "value").where("value is not null").mapInArrow(split, _TUPLE_DDL)


def typed_rows(rows: DataFrame, schema: str, columns: list[str]) -> DataFrame:
    """The tuples as columns of ``schema``; a value that doesn't fit is null and ``ok`` is false."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    at = {c: i for i, c in enumerate(columns)}
    raw = lambda f: F.get("values", F.lit(at[f.name])) if f.name in at else F.lit(None).cast("string")
    good = F.size("values") == len(columns)
    for f in fields:
        good &= raw(f).isNull() | raw(f).try_cast(f.dataType).isNotNull()
    return rows.select("file", "stmt_no", "tuple_no", good.alias("ok"), *[raw(f).try_cast(f.dataType).alias(f.name) for f in fields])


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, hash, file_size_mb) of the files of a path, by content."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.md5("content").alias("hash"), F.round(F.col("length") / 1048576, 2).alias("file_size_mb"))


def new_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose latest ledger row, if any, has another hash - whether that row succeeded or not."""
    latest = Window.partitionBy("file").orderBy(F.col("processed_at").desc(), F.col("hash"))
    last = ledger.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").select("file", "hash")
    return files.join(last, ["file", "hash"], "left_anti")


def import_outcome(statements: DataFrame, max_error_share: float = 0.1) -> DataFrame:
    """(file, ok) -> per file the counts and success: no errors, or fewer than a tenth as many as successes."""
    counts = statements.groupBy("file").agg(F.count_if(F.col("ok")).alias("success_count"), F.count_if(~F.col("ok")).alias("error_count"))
    good = (F.col("error_count") == 0) | (F.col("error_count") < max_error_share * F.col("success_count"))
    return counts.withColumn("success", good)


def statement_stats(statements: DataFrame, most_errors: int = 10, sql_width: int = 200, error_width: int = 500) -> DataFrame:
    """(file, stmt_no, stmt_type, ok, sql, error) -> counts by file and type, with the first errors cut short.

    Counts are summed where the rows are. Only failed statements are ranked, of which Spark keeps the first few a task.
    """
    counts = statements.groupBy("file", "stmt_type").agg(F.count(F.lit(1)).alias("statements"), F.count_if(F.col("ok")).alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))
    first = Window.partitionBy("file", "stmt_type").orderBy("stmt_no")
    bad = statements.where(~F.col("ok")).select("file", "stmt_type", "stmt_no", F.substring("sql", 1, sql_width).alias("sql"), F.substring("error", 1, error_width).alias("error"))
    few = bad.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= most_errors)
    errors = few.groupBy("file", "stmt_type").agg(F.array_sort(F.collect_list(F.struct("stmt_no", "sql", "error"))).alias("errors"))
    none = F.array().cast("array<struct<stmt_no: bigint, sql: string, error: string>>")
    return counts.join(errors, ["file", "stmt_type"], "left").withColumn("errors", F.coalesce("errors", none))
