"""Records of files and canonical JSON on literals."""

from __future__ import annotations

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from brightline.functions.canonical import canonical, json_hash
from brightline.plans import catalogue
from brightline.plans.records import _PLAIN
from brightline.sources.records import STRICT, lenient_records, quoted, read_records, strict_records
from brightline.streaming import harvest
from brightline.streaming.sources import stream_of


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ('{"b":1.0,"a":[1e21,1E-7,-0,100000000000000000000,0.000001,123456789012345680000,1.5e300,5e-324,9007199254740993]}', '{"a":[1e+21,1e-7,0,100000000000000000000,0.000001,123456789012345680000,1.5e+300,5e-324,9007199254740992],"b":1}'),
        (' { "\\u0061" : "\\u00e9\\/\\u0007\\n\\"\\\\" } ', '{"a":"é/\\u0007\\n\\"\\\\"}'), ('{"ｚ":0,"\\ud835\\udcd0":1,"z":2}', '{"z":2,"\U0001d4d0":1,"ｚ":0}'), ('{"a":1,"a":{}}', '{"a":{}}'),
        ('"\\ud800"', '"\\ud800"'), ("[]", "[]"), ("null", "null"), ("true", "true"), ("12.50", "12.5"), ("-1e-6", "-0.000001"), ("1e400", None), ("NaN", None), ("Infinity", None), ("{", None), ("", None), (None, None),
        ("[" * 100000, None), ("0.1", "0.1"), ("120e-1", "12"), ("4.35", "4.35"), ("1e20", "100000000000000000000"),
    ],
)
def test_canonical_form(said, want):
    assert canonical(said) == want


def test_json_hash_is_that_of_any_spelling(spark):
    df = spark.createDataFrame([('{"a":1,"b":[2]}',), (' {"b":[2.0],\n"a":1e0}',), ("{",), (None,)], "t string")
    got = [r.h for r in df.select(json_hash(F.col("t")).alias("h")).collect()]
    assert got[0] == got[1] and len(got[0]) == 64 and got[2:] == [None, None]


def test_strict_records():
    assert strict_records('a,b\r\n1,"x ""y"",\n z"\r\n\r\n  \n3,\r4,5') == [(1, ["a", "b"]), (2, ["1", 'x "y",\n z']), (6, ["3", ""]), (7, ["4", "5"])]
    assert strict_records("") == [] and strict_records("\n \n") == [] and strict_records('""') == [] and strict_records(",") == [(1, ["", ""])]
    for bad in ('a"b', '"a" b', '"a', 'x,"y\n', '"a""'):
        assert strict_records(bad) is None
    values = ["plain", 'q"uote', "com,ma", "two\r\nlines", "", " space ", '"', "é"]
    assert strict_records(quoted(values)) == [(1, values)]


def test_lenient_records():
    assert lenient_records('a, b\r\n\n x"y,"z,w\n"q""r",\n "open,end') == [(1, ["a", " b"]), (3, [" xy,z", "w"]), (4, ['q"r', ""]), (5, [" open,end"])]


def test_what_files_are_refused(spark, tmp_path):
    head = ",".join(STRICT)
    row = ",".join("1" for _ in STRICT)
    files = {"ok": f"{head}\n{row}\n{row},9\n", "none": head, "bom": f"﻿{head}\r\n{row}", "header": head.replace("frp", "x"), "quote": f'{head}\n"1"2,', "large": head + "\n" * 400, "empty": "\r\n"}
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    (tmp_path / "bytes.csv").write_bytes(b"\xff\xfe")
    got = {(r.file.rsplit("/", 1)[1][:-4], r.row, r.line, r.reason) for r in read_records(spark, f"{tmp_path}/*.csv", most_bytes=400).collect()}
    assert got == {
        ("ok", 1, 2, None), ("ok", 2, 3, "column-count-mismatch"), ("none", 0, 1, None), ("bom", 1, 2, None), ("header", 0, 1, "invalid-header"), ("quote", 0, 0, "invalid-csv"),
        ("large", 0, 0, "response-too-large"), ("empty", 0, 0, "invalid-header"), ("bytes", 0, 0, "invalid-encoding"),
    }


def test_harvest_in_any_order_and_again_gives_one_table(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i % 20:02} 0{i % 10}:00:00", "a" if i % 4 else "b", sent) for sent in (0, 1) for i in range(sent * 30, 60 + sent * 30)] + [(5, "2024-01-06 05:00:00", "changed", 2), (None, "2024-01-06 05:00:00", "a", 2)]
    parts = [rows[:50], rows[50:100], rows[100:]]
    tables = []
    for name, order in (("forward", [0, 1, 2]), ("backward", [2, 1, 0]), ("again", [0, 1, 2, 1, 0, 2])):
        at, path = tmp_path / name, f"{tmp_path}/{name}-table"
        for i, k in enumerate(order):
            spark.createDataFrame(parts[k], "id long, at string, kind string, sent int").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"{at}/events.parquet")
            if i != 1:  # two files in one batch now and then
                harvest.harvest(stream_of(spark, str(at), "events", 1 + i % 2), path, ["id"], ["kind"], "at")
        harvest.harvest(stream_of(spark, str(at), "events"), path, ["id"], ["kind"], "at")
        found = harvest.revisions(harvest.table(spark, path, spark.createDataFrame([], "id long, at timestamp, kind string, sent int, content_hash string, day string, batch long")), ["id"], ["at"])
        tables.append(sorted(((r.id, r.kind, r.version) for r in found.collect()), key=repr))
    assert tables[0] == tables[1] == tables[2] and len(tables[0]) == len({(r[0], r[2]) for r in rows})


def test_canonical_form_as_sql_spells_it():
    c = duckdb.connect()
    plain = _PLAIN.format("{}::DOUBLE")
    for x in [n * 1e21 for n in (19, 21, 18944, 19456, 21504, 23552, 38912, 77824, 128657)] + [n / 1e12 for n in (7, 128657, 10**6, 34 * 10**6)] + [128657 / 8]:
        assert canonical(repr(x), in_sql=True) == c.execute(f"SELECT {plain.format(repr(x))}").fetchall()[0][0]
    for t in ["\x0b\x1f\n", "\\u001b", "\\\x1b\x1bab"]:
        assert canonical(json.dumps(t), in_sql=True) == c.execute("SELECT to_json(?::VARCHAR)", [t]).fetchall()[0][0]
    assert canonical("19456E+21") == "1.9456e+25"


def test_nested_digest_of_lengths_halfway_between_doubles(spark, tmp_path):
    rows = [(i, "a\x1bb", "en", n) for i, n in enumerate((19, 19456, 23552, 10**6))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {(x.doc_id, x.id) for x in catalogue.queries()["hash_canonical_nested"](spark, str(tmp_path)).collect()}
    assert got == set(c.execute(catalogue.oracle_sql()["hash_canonical_nested"]).fetchall())
