"""Delimited files of detections: records read whole from files, headers held to a contract, and what is refused told with its place.

A file is one response of a service, limited in size; it is read by one task, and files by many. Each is an RFC 4180 text: records may go over
several lines within quotes. Lenient reading takes each line for a record and lets quotes toggle anywhere.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most bytes of a file, and the columns that files must have.
MOST_BYTES = 2_000_000
STRICT = "latitude longitude bright_ti4 scan track acq_date acq_time satellite instrument confidence version bright_ti5 frp daynight".split()
LENIENT = "latitude longitude acq_date acq_time confidence".split()

SCHEMA = "file string, row int, line int, fields map<string,string>, reason string"


def strict_records(text: str) -> list[tuple[int, list[str]]] | None:
    """The records of a text with the lines they begin on, blank ones left out; None if the text breaks the rules of quotes."""
    out, record, line, begins = [], [], 1, 1
    at, n = 0, len(text)
    while at < n:
        if text[at] == '"':
            parts, from_ = [], at + 1
            while True:
                end = text.find('"', from_)
                if end < 0:
                    return None
                parts.append(text[from_:end])
                if text[end + 1 : end + 2] != '"':
                    break
                from_ = end + 2
            value, at = '"'.join(parts), end + 1
            line += len(value.replace("\r\n", "\n").replace("\r", "\n").split("\n")) - 1
            if at < n and text[at] not in ",\r\n":
                return None
        else:
            ends = [e for e in (text.find(c, at) for c in ",\r\n") if e >= 0]
            end = min(ends, default=n)
            value, at = text[at:end], end
            if '"' in value:
                return None
        record.append(value)
        if at < n and text[at] == ",":
            at += 1
            if at < n:
                continue
            record.append("")
        else:
            at += 2 if text[at : at + 2] == "\r\n" else 1
            line += 1
        if record != [value] or value.strip():
            out.append((begins, record))
        record, begins = [], line
    return out


def lenient_records(text: str) -> list[tuple[int, list[str]]]:
    """Each line that isn't blank as a record: a quote begins or ends quoting wherever it stands, two within quotes are one."""
    out = []
    for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
        if line.strip():
            fields, value, quoted, k = [], [], False, 0
            while k < len(line):
                c = line[k]
                if c == '"':
                    if quoted and line[k + 1 : k + 2] == '"':
                        value.append(c)
                        k += 1
                    else:
                        quoted = not quoted
                elif c == "," and not quoted:
                    fields.append("".join(value))
                    value = []
                else:
                    value.append(c)
                k += 1
            out.append((i + 1, [*fields, "".join(value)]))
    return out


def _read(content: bytes | None, strict: bool) -> Iterator[tuple[int, int, dict[str, str] | None, str | None]]:
    """row, line, fields, reason of a file's records; a row 0 with a reason if the file as a whole is refused, and without one if it has no records."""
    if content is None:
        yield 0, 0, None, "response-too-large"
        return
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        yield 0, 0, None, "invalid-encoding"
        return
    records = strict_records(text) if strict else lenient_records(text)
    if not records:
        yield 0, 0, None, "invalid-csv" if records is None else "invalid-header"
        return
    header = records[0][1] if strict else [h.strip().lower() for h in records[0][1]]
    if header != STRICT if strict else not set(LENIENT) <= set(header):
        yield 0, records[0][0], None, "invalid-header"
        return
    if len(records) == 1:
        yield 0, records[0][0], None, None
    for row, (line, values) in enumerate(records[1:], 1):
        if strict and len(values) != len(header):
            yield row, line, None, "column-count-mismatch"
        else:
            yield row, line, dict(zip(header, [*(v if strict else v.strip() for v in values), *[""] * len(header)], strict=False)), None


def read_records(spark: SparkSession, path: str, strict: bool = True, most_bytes: int = MOST_BYTES) -> DataFrame:
    """file (its path), row (from 1; 0 stands for the file), line, fields by header, reason (null for what is accepted) of all records of the files at path.

    Files of more than most_bytes are refused, unread. Files without a byte are none: Spark does not list them."""
    content = F.when(F.col("length") <= most_bytes, F.col("content"))
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), content.alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string()]
        for b in batches:
            for file, content in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                rows = [(file, row, line, fields and list(fields.items()), reason) for row, line, fields, reason in _read(content, strict)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "row", "line", "fields", "reason"])

    return files.mapInArrow(run, SCHEMA)


def quoted(fields: list[str]) -> str:
    """One record as RFC 4180 writes it."""
    out = io.StringIO()
    csv.writer(out, lineterminator="\r\n").writerow(fields)
    return out.getvalue()
