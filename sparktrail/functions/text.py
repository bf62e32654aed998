"""Column expressions over strings: patterns, paths and working directories."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column | str) -> Column:
    """Null as the empty string."""
    return F.coalesce(as_col(c), F.lit(""))


def filled(c: Column | str) -> Column:
    """The empty string as null."""
    return F.nullif(as_col(c), F.lit(""))


def first_filled(*columns: Column | str) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*(filled(c) for c in columns))


def holds(predicate: Column) -> Column:
    """Unknown as false."""
    return F.coalesce(predicate, F.lit(False))


def regex(pattern: str) -> str:
    """A Python pattern for Java: dot stops at line feeds only, classes are Unicode, named groups spelled alike."""
    return "(?dU)" + pattern.replace("(?P<", "(?<").replace("(?P=", r"\k<")


def is_regex(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except (re.error, TypeError):
        return False
    return True


def glob_regex(glob: str) -> str:
    """A shell glob as an unanchored pattern."""
    return "".join({"*": ".*", "?": "."}.get(ch) or re.escape(ch) for ch in glob)


def glob_expression(glob: Column | str) -> Column:
    """A column of shell globs as patterns for one path segment: a star stops at slashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(as_col(glob), r"([^\w*?])", r"\\$1"), r"\*", "[^/]*"), r"\?", ".")


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(as_col(path), "/"), -1)


def dirname(path: Column | str) -> Column:
    """What stands before the last slash; a root slash stays."""
    path = as_col(path)
    head = F.regexp_extract(path, r"(?s)^(.*/)?[^/]*$", 1)
    return F.when(head.rlike("^/+$"), head).otherwise(F.regexp_replace(head, "/+$", ""))


def normal_path(path: Column | str) -> Column:
    """A POSIX path without ``.``, ``..`` and doubled slashes; the empty path is ``.``, two leading slashes stay two."""
    path = as_col(path)
    lead = F.when(path.rlike("^//(?!/)"), F.lit("//")).when(path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")
    step = lambda done, p: (
        F.when(p != "..", F.concat(done, F.array(p)))
        .when((F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("")), done), -1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(lead != "", done)
        .otherwise(F.concat(done, F.array(p)))
    )
    joined = F.concat(lead, F.array_join(F.aggregate(parts, empty, step), "/"))
    return F.when(path.isNull(), None).when(joined == "", F.lit(".")).otherwise(joined)


def resolved_path(path: Column | str, cwd: Column | str) -> Column:
    """A path, relative ones taken from ``cwd`` where there is one, in normal form; null and empty stay as they are."""
    path, cwd = as_col(path), as_col(cwd)
    full = F.when(path.startswith("/") | filled(cwd).isNull(), path).otherwise(F.concat(F.regexp_replace(cwd, "/$", ""), F.lit("/"), path))
    return F.when(filled(path).isNull(), path).otherwise(normal_path(full))


def changed_dir(cwd: Column | str, target: Column | str) -> Column:
    """The directory after ``cd target``; null where the text does not tell (no target, ``-``, ``~``, variables)."""
    cwd = as_col(cwd)
    target = F.regexp_replace(F.trim(as_col(target)), "^[\"']+|[\"']+$", "")
    open_end = (target == "") | (target == "-") | target.rlike(r"[$`*?]") | target.startswith("~")
    joined = F.when(target.startswith("/"), normal_path(target)).when(filled(cwd).isNotNull(), normal_path(F.concat(cwd, F.lit("/"), target)))
    return F.when(holds(open_end), None).otherwise(joined)


def command_dir(subcommands: Column | str) -> Column:
    """The directory that the ``cd`` sub-commands of a command lead to, one after another; null where unknown."""
    moves = F.filter(as_col(subcommands), lambda s: (s == "cd") | s.startswith("cd "))
    quoted = lambda rest: F.coalesce(filled(F.regexp_extract(rest, "^'([^']*)", 1)), filled(F.regexp_extract(rest, '^"([^"]*)', 1)))

    def target(s: Column) -> Column:
        rest = F.trim(F.substr(s, F.lit(4)))
        return F.when(rest.rlike("^[\"']"), F.coalesce(quoted(rest), F.lit(""))).otherwise(F.regexp_extract(rest, r"^\S*", 0))

    return F.aggregate(moves, F.lit(None).cast("string"), lambda wd, s: changed_dir(wd, target(s)))


def utc_instant(ts: Column | str) -> Column:
    """A timestamp without time zone, read as UTC, as an instant; whatever the session's time zone is."""
    since = as_col(ts) - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    days, hours, minutes = (F.extract(F.lit(u), since).cast("long") for u in ("DAY", "HOUR", "MINUTE"))
    seconds = F.extract(F.lit("SECOND"), since)
    return F.timestamp_micros(((days * 24 + hours) * 60 + minutes) * 60_000_000 + (seconds * 1_000_000).cast("long"))


def utc_clock(ts: Column | str) -> Column:
    """An instant as the UTC clock shows it, without time zone."""
    return F.convert_timezone(None, F.lit("UTC"), as_col(ts).cast("timestamp_ntz"))
