"""Splitting of compound shell commands."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktrail.functions.text import as_col

#: A quoted span (to its unescaped end or the end of the text), a separator, or one other character.
_LEXEME = re.compile(r"'(?:[^']|(?<=\\)')*(?:'|\Z)|\"(?:[^\"]|(?<=\\)\")*(?:\"|\Z)|(&&|\|\||;|\n)|.", re.DOTALL)


def subcommands(command: str | None) -> list[str]:
    """Parts between ``&&``, ``||``, ``;`` and line feeds outside quotes, trimmed, without empty ones."""
    parts, at = [], 0
    for m in _LEXEME.finditer(command or ""):
        if m.group(1):
            parts.append(command[at : m.start()])
            at = m.end()
    parts.append((command or "")[at:])
    return [p.strip() for p in parts if p.strip()]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split(commands: pd.Series) -> pd.Series:
    return commands.map(subcommands)


def split_subcommands(command: Column | str) -> Column:
    """The sub-commands of a command; an empty array for null."""
    command = as_col(command)
    # a command without separators and quotes needs no parsing
    plain = F.when(F.trim(F.coalesce(command, F.lit(""))) == "", F.array().cast("array<string>")).when(~command.rlike("[;\n'\"]|&&|\\|\\|"), F.array(F.regexp_replace(command, r"^\s+|\s+$", "")))
    return F.coalesce(plain, _split(command))
