"""Functions that the JVM has no counterpart for, on Arrow batches."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F, types as Y

def record(**fields: Y.DataType) -> Y.StructType:
    return Y.StructType([Y.StructField(k, v) for k, v in fields.items()])


TEXT = Y.StringType()
DEEPEST = 100
BOMS = ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"), (b"\xef\xbb\xbf", "utf-8-sig"))


def decode(raw: bytes) -> tuple[str, str, str | None]:
    """Text, encoding and a warning if the encoding is a guess. A byte order mark decides; then strict UTF-8, gb18030, cp1252."""
    for mark, name in BOMS:
        if raw.startswith(mark):
            return raw.decode(name), name, None
    for name in ("utf-8", "gb18030", "cp1252"):
        try:
            return raw.decode(name), name, None if name == "utf-8" else f"encoding guessed as {name}"
        except UnicodeDecodeError:
            continue
    raise ValueError("no known encoding")


@F.pandas_udf(record(text=TEXT, encoding=TEXT, warning=TEXT, error=TEXT))
def decode_text(content: pd.Series) -> pd.DataFrame:
    rows = []
    for raw in content:
        try:
            rows.append((*decode(bytes(raw)), None) if raw is not None else (None, None, None, "no content"))
        except ValueError as error:
            rows.append((None, None, None, str(error)))
    return pd.DataFrame(rows, columns=["text", "encoding", "warning", "error"])


def normalize(value: str) -> str:
    return unicodedata.normalize("NFKC", value).replace("­", "")


@F.pandas_udf(TEXT)
def normalized_text(value: pd.Series) -> pd.Series:
    return value.map(normalize, na_action="ignore")


def strict_json(text: str):
    """Like json.loads, but repeated keys, NaN and infinities are errors."""

    def pairs(items):
        out = dict(items)
        if len(out) < len(items):
            raise ValueError("a key occurs twice")
        return out

    def constant(name):
        raise ValueError(f"{name} is not a number")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)


def leaves(value, path: str = "$", depth: int = 0):
    """(path, text) of every value that isn't null, a list or an object."""
    if depth > DEEPEST:
        raise ValueError(f"nested deeper than {DEEPEST}")
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, f"{path}[{json.dumps(k, ensure_ascii=False)}]", depth + 1)
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from leaves(v, f"{path}[{k}]", depth + 1)
    elif value is not None:
        yield path, json.dumps(value) if isinstance(value, (bool, int, float)) else value


@F.pandas_udf(record(leaves=Y.ArrayType(record(path=TEXT, value=TEXT)), error=TEXT))
def json_leaves(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        try:
            rows.append(([{"path": p, "value": v} for p, v in leaves(strict_json(t))], None) if t is not None else ([], None))
        except (ValueError, RecursionError) as error:
            rows.append(([], str(error)))
    return pd.DataFrame(rows, columns=["leaves", "error"])


TOKEN = re.compile(r"\{\{|\}\}|\{([^{}]*)\}|[{}]")


def expand(template: str, values: dict[str, str]) -> str:
    """Named tokens in braces become their values, doubled braces single ones. Unknown and unused names are errors."""
    if not template.strip():
        raise ValueError("the template is empty")
    used: set[str] = set()

    def one(m: re.Match) -> str:
        if m[0] in ("{{", "}}"):
            return m[0][0]
        name = m[1]
        if name is None or not re.fullmatch(r"[a-z][a-z0-9_]*", name):
            raise ValueError("only named tokens such as {count} are supported")
        used.add(name)
        if name not in values:
            raise ValueError(f"unknown token {{{name}}}")
        return values[name]

    out = TOKEN.sub(one, template)
    if unused := set(values) - used:
        raise ValueError(f"unused reference {min(unused)}")
    return out


@F.pandas_udf(record(value=TEXT, error=TEXT))
def render_template(template: pd.Series, values: pd.Series) -> pd.DataFrame:
    rows = []
    for t, v in zip(template, values, strict=True):
        try:
            rows.append((expand(t or "", dict(v or {})), None))
        except ValueError as error:
            rows.append((None, str(error)))
    return pd.DataFrame(rows, columns=["value", "error"])


@F.pandas_udf(TEXT)
def canonical_json(text: pd.Series) -> pd.Series:
    """Sorted keys, no blanks, non-ASCII as it is: what digests are taken of."""
    return text.map(lambda t: json.dumps(strict_json(t), ensure_ascii=False, sort_keys=True, separators=(",", ":")), na_action="ignore")
