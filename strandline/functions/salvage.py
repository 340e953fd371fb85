"""JSON in model replies: as it is, within fences, or from its longest prefix that closes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What may be missing behind a closed object, in the order of trying.
TAILS = ("]}", "}]}", '"}]}')
_FENCED = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
#: Open brackets, and whether a string is open, that each tail closes.
_CLOSES = {"]}": ("{[", False), "}]}": ("{[{", False), '"}]}': ("{[{", True)}


def _loaded(text: str) -> tuple[bool, object]:
    try:
        return True, json.loads(text)
    except ValueError:
        return False, None


def _cuts(text: str, start: int) -> Iterator[tuple[int, str]]:
    """(end, tail) of prefixes that end in a brace behind ``start`` and that a tail would close, longest first, found in one scan."""
    stack, quoted, skip, found = [], False, False, []
    for i, c in enumerate(text):
        if quoted and skip:
            skip = False
        elif quoted and c == "\\":
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{[":
            stack.append(c)
        elif not quoted and c in "}]" and stack:
            stack.pop()
        if c == "}" and i > start and len(stack) <= 3:
            found += [(i + 1, tail) for tail in reversed(TAILS) if _CLOSES[tail] == ("".join(stack), quoted)]
    return reversed(found)


def reply_json(text: str | None) -> tuple[str | None, str]:
    """Canonical JSON and how it was had: ok, salvaged, unparseable or empty."""
    if not text:
        return None, "empty"
    body = text.strip()
    fenced = _FENCED.search(body)
    if fenced:
        body = fenced[1].strip()
    body = body[max(0, body.find("{")) :]
    fine, value = _loaded(body)
    if fine:
        return _canonical(value), "ok"
    start = body.find('"segments"')
    for end, tail in _cuts(body, start) if start >= 0 else ():
        fine, value = _loaded(body[:end] + tail)
        if fine:
            return _canonical(value), "salvaged"
    return None, "unparseable"


def _canonical(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def salvage(text: str | None) -> str | None:
    return reply_json(text)[0]


def loose_json(text: str | None, closing: bool = False) -> str | None:
    """JSON within the first fences or from the first brace; ``closing`` rather takes the whole text, and tries the tails behind its last brace."""
    if not text:
        return None
    if not closing:
        fenced = _FENCED.search(text)
        body = fenced[1] if fenced else text
        fine, value = _loaded(body[max(0, body.find("{")) :])
        return _canonical(value) if fine else None
    mark = "```json" if "```json" in text else "```"
    body = text.split(mark)[1].split("```")[0] if mark in text else text
    last = body.rfind("}") + 1
    for attempt in (body.strip(), *(body[:last].strip() + tail for tail in ("", *TAILS) if last > 1)):
        fine, value = _loaded(attempt)
        if fine:
            return _canonical(value)
    return None


@F.pandas_udf(T.StructType([T.StructField("json", T.StringType()), T.StructField("note", T.StringType())]))
def _replies(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if t is None else reply_json(t) for t in texts], columns=["json", "note"])


@F.pandas_udf(T.StringType())
def _loose(texts: pd.Series) -> pd.Series:
    return texts.map(loose_json)


@F.pandas_udf(T.StringType())
def _closed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: loose_json(t, True))


def with_reply_json(df: DataFrame, text: str, json: str = "json", note: str = "note") -> DataFrame:
    """Adds the reply's JSON and how it was had. Only rows that don't parse as they are go to Python."""
    plain = F.try_parse_json(F.col(text))
    whole = F.coalesce(F.schema_of_variant(plain).startswith("OBJECT"), F.lit(False))
    found = _replies(F.when(~whole, F.coalesce(F.col(text), F.lit(""))))
    return df.select("*", whole.alias("_whole"), found.alias("_found")).select(
        *df.columns, F.when(F.col("_whole"), F.col(text)).otherwise(F.col("_found.json")).alias(json), F.when(F.col("_whole"), "ok").otherwise(F.col("_found.note")).alias(note)
    )


def loosely_parsed(text: Column, closing: bool = False) -> Column:
    """The reply's JSON as a string, or null; Python sees only texts that don't parse as they are."""
    plain = F.try_parse_json(text)
    return F.when(plain.isNotNull(), text).otherwise((_closed if closing else _loose)(F.when(plain.isNull(), text)))
