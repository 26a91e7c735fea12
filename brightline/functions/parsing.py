"""Small parsers of single values, as Arrow-batched functions: what SQL functions can't express."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F

# The named entities of XML, and the blank that HTML adds.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0"}
_ENTITY = re.compile(r"&(?:#(\d+)|#[xX]([0-9a-fA-F]+)|([A-Za-z]\w*));")
_CDATA = re.compile(r"<!\[CDATA\[(.*?)\]\]>", re.S)


def decoded(text: str | None) -> str | None:
    """Text with entities decoded: no scalar value becomes U+FFFD, an unknown name nothing."""
    if text is None:
        return None

    def one(m: re.Match) -> str:
        if m[3]:
            return ENTITIES.get(m[3], "")
        code = int(m[1]) if m[1] else int(m[2], 16)
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"

    return _ENTITY.sub(one, _CDATA.sub(r"\1", text))


_FIELD = re.compile(r'"((?:[^"]|"")*)"(?=,|\Z)|([^",]*)(?=,|\Z)')


def strict_fields(line: str | None) -> list[str] | None:
    """Fields of one line of RFC 4180 text; null where a quote stands in a bare field or text after a closing one."""
    if line is None:
        return None
    fields, at = [], 0
    while m := _FIELD.match(line, at):
        fields.append(m[2] if m[1] is None else m[1].replace('""', '"'))
        if m.end() == len(line):
            return fields
        at = m.end() + 1
    return None


def article_headline(text: str | None) -> str | None:
    """The headline of the first object, depth first, whose @type names an article."""
    try:
        waiting = [json.loads(text or "null")]
    except ValueError:
        return None
    while waiting:
        x = waiting.pop()
        if isinstance(x, dict):
            if "article" in str(x.get("@type", "")).lower():
                return x.get("headline")
            waiting.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            waiting.extend(reversed(x))
    return None


def arrow(f, kind: str):
    """f over a column of texts."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(f)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)
