"""Policies that deny tool calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparktrail.functions.text import blank, holds, is_regex, regex


def denied_by(policy: dict) -> Column:
    """What denies an action: ``tool``, ``command`` (of shell calls) or ``path``, the first that does; null if nothing.

    A policy has any of ``denied_tools`` (names), ``denied_commands`` and ``denied_paths`` (patterns); bad patterns
    deny nothing.
    """

    def any_of(column: str, patterns: list[str]) -> Column:
        good = [p for p in patterns if is_regex(p)]
        return blank(column).rlike(regex("|".join(f"(?:{p})" for p in good))) if good else F.lit(False)

    tools = policy.get("denied_tools") or []
    by_tool = F.col("tool").isin(*tools) | F.col("raw_tool").isin(*tools) if tools else F.lit(False)
    by_command = (F.col("tool") == "shell") & any_of("command", policy.get("denied_commands") or [])
    return F.when(holds(by_tool), "tool").when(holds(by_command), "command").when(any_of("path", policy.get("denied_paths") or []), "path")
