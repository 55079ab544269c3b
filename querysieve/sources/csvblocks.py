"""CSV files whose quoted fields may hold line breaks, read by many tasks.

A line alone doesn't tell whether it begins a record or goes on within a quoted field.  So each block of a file is first
taken as a function: of the state it is entered in (between records, or within a quoted field), the state it is left in.
Functions of blocks are chained in file order, which gives every block its true state; then all blocks are cut into records
side by side.  A record that crosses blocks is put together from its pieces.

Quotes count as RFC 4180 has them: a field is quoted if it begins with one, a doubled one stands for itself, and one within
an unquoted field is a character like others.  What follows a closing quote up to the comma belongs to the field.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querysieve.operators.held import held

SUMMARY = "file string, block long, after_open boolean, after_quoted boolean, opens boolean, header string"
RECORD = "file string, block long, row long, fields array<string>"
PIECE = "file string, owner long, block long, row long, text string"

_FIELD = re.compile(r'"((?:[^"]++|"")*+)("?)([^,]*+)|([^,]*+)')
_CLOSES = re.compile(r'(?:[^"]++|"")*+"')


def ends_quoted(line: str, quoted: bool) -> bool:
    """Whether a quoted field is open after the line, from whether one was before it."""
    at = 0
    if quoted:
        closed = _CLOSES.match(line)
        if not closed:
            return True
        at = line.find(",", closed.end())
        if at < 0:
            return False
        at += 1
    elif '"' not in line:
        return False
    while True:
        field = _FIELD.match(line, at)
        if field[4] is None and not field[2]:
            return True
        at = field.end() + 1
        if at > len(line):
            return False


def fields_of(record: str) -> list[str | None]:
    """An empty field without quotes is null."""
    record = record.removesuffix("\r")
    if '"' not in record:
        return [f or None for f in record.split(",")]
    out, at = [], 0
    while at <= len(record):
        field = _FIELD.match(record, at)
        out.append((field[4] or None) if field[4] is not None else field[1].replace('""', '"') + field[3])
        at = field.end() + 1
    return out


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, block: a block's lines come in order, from one task."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """(file, block) and its lines; each block's must be used up before the next is asked for."""

    def rows() -> Iterator[tuple[tuple[str, int], str]]:
        for batch in batches:
            for value, file, block in zip(*(batch[c].to_pylist() for c in ("value", "file", "block"))):
                yield (file, block), value.removeprefix("﻿") if not block else value

    source = rows()
    ahead = next(source, None)
    while ahead is not None:
        key = ahead[0]

        def own() -> Iterator[str]:
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                value = ahead[1]
                ahead = next(source, None)
                yield value

        yield key, own()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (file, block), own in _by_block(batches):
        states, opens, header, ready = [False, True], False, [], False
        for value in own:
            if not block and not ready and (header or value.rstrip("\r")):
                header.append(value)
            opens |= not states[1]  # entered within a field, a record begins here all the same
            states = [ends_quoted(value, s) for s in states] if '"' in value else states
            ready |= bool(header) and not states[0]
        row = [file, block, *states, opens, "\n".join(header) if header else None]
        types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=[c.split()[0] for c in SUMMARY.split(", ")])


@dataclass(frozen=True)
class Entry:
    """How a block is entered: within a quoted field or not, and in which block the record began that goes on in it."""

    quoted: bool
    owner: int | None


def entries(found: list) -> tuple[dict[tuple[str, int], Entry], bool]:
    """Summaries -> every block's entry, and whether any record crosses blocks."""
    out, crosses, file = {}, False, None
    for r in sorted(found, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, quoted, owner = r["file"], False, None
        out[file, r["block"]] = Entry(quoted, owner if quoted else None)
        begins = r["opens"] if quoted else True
        quoted = r["after_quoted"] if quoted else r["after_open"]
        owner = r["block"] if begins else owner
        crosses |= quoted
    return out, crosses


def _records(own: Iterator[str], quoted: bool) -> Iterator[tuple[str, bool, bool]]:
    """Records and pieces of a block: text, whether it begins before the block, and whether it goes on after it."""
    held_lines: list[str] = []
    before = quoted
    for value in own:
        if not held_lines and not quoted and not value.rstrip("\r"):
            continue  # a blank line between records
        held_lines.append(value)
        quoted = ends_quoted(value, quoted) if quoted or '"' in value else False
        if not quoted:
            yield "\n".join(held_lines), before, False
            held_lines, before = [], False
    if held_lines:
        yield "\n".join(held_lines), before, True


def read_records(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """The header's names, and file, block, row (rising within a block) and fields of all other records.

    The files' headers must agree.  A row per block of the files, tens of megabytes each, comes to the driver.
    """
    rows = lines(spark, path)
    found = rows.mapInArrow(_summaries, SUMMARY).collect()
    known, crosses = entries(found)
    headers = {tuple(fields_of(r["header"])) for r in found if r["header"] is not None}
    if len(headers) > 1:
        raise ValueError(f"files with different headers: {sorted(map(str, headers))[:3]}")
    sent = spark.sparkContext.broadcast(known)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), own in _by_block(batches):
            out: list[list[str | None]] = []
            first = True
            rows_of: list[int] = []
            for n, (text, before, after) in enumerate(_records(own, sent.value[file, block].quoted)):
                if first and not block:
                    first = False  # the header
                    continue
                if not before and not after:
                    out.append(fields_of(text))
                    rows_of.append(n)
                if len(out) >= 10_000:
                    yield made(file, block, rows_of, out)
                    out, rows_of = [], []
            if out:
                yield made(file, block, rows_of, out)

    def made(file: str, block: int, rows_of: list[int], out: list[list[str | None]]) -> pa.RecordBatch:
        columns = [pa.array([file] * len(out), pa.string()), pa.array([block] * len(out), pa.int64()), pa.array(rows_of, pa.int64()), pa.array(out, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["file", "block", "row", "fields"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), own in _by_block(batches):
            entry, out = sent.value[file, block], []
            for n, (text, before, after) in enumerate(_records(own, entry.quoted)):
                if (before or after) and not (n == 0 and not block and not before):
                    out.append((file, entry.owner if before else block, block, n, text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[c.split()[0] for c in PIECE.split(", ")])

    records = rows.mapInArrow(whole, RECORD)
    if crosses:
        # Few: at most two a block.  Pieces of one record follow each other in order of blocks.
        parts = held(rows.mapInArrow(pieces, PIECE))
        joined = parts.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "row", "text"))).alias("parts"))

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = ["\n".join(p["text"] for p in own) for own in batch["parts"].to_pylist()]
                first = [own[0]["row"] for own in batch["parts"].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch["file"], batch["owner"], pa.array(first, pa.int64()), pa.array([fields_of(t) for t in texts], pa.list_(pa.string()))], names=["file", "block", "row", "fields"])

        records = records.unionByName(joined.mapInArrow(put, RECORD))
    return list(next(iter(headers), ())), records
