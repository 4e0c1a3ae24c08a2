"""Predicates and classifications of evidence as column expressions: ordered cases, first match wins, null stays unknown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import glob


def selector_matches(selector: Column, path: Column, line: Column, name: Column) -> Column:
    """PATH, PATH:LINE or PATH[ID]."""
    return (selector == path) | (selector == F.concat(path, F.lit(":"), line.cast("string"))) | (selector == F.concat(path, F.lit("["), name, F.lit("]")))


def drop_read(proven: Column, kind: Column, before: Column) -> Column:
    """A read goes only with a proven own create or replace before it."""
    return F.coalesce(proven & kind.isin("create", "replace") & before, F.lit(False))


def change_kind(old_mode: Column, new_mode: Column) -> Column:
    none = "000000"
    return F.when((old_mode == none) & (new_mode != none), "add").when((old_mode != none) & (new_mode == none), "delete").when((old_mode != none) & (new_mode != none), "modify")


def test_class_path(path: Column) -> Column:
    """The class suffix of a test: *Test or *Tests before the extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "").rlike("Tests?$")


def in_scope(path: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """An include glob matches and no exclude glob does; globs become one regular expression each side."""
    either = lambda globs: F.lit(False) if not globs else path.rlike("|".join(f"(?:{glob(g)})" for g in globs))
    return either(include) & ~either(exclude)


def entry_covers(entry: Column, pattern: str | None, path: Column) -> Column:
    return entry == path if pattern is None else path.rlike(glob(pattern))


def heading_or_status(line: Column) -> Column:
    """The cheap necessary condition of a heading or a status line."""
    return line.startswith("#") | F.contains(F.lower(line), F.lit("status"))


def status_of_entry(proposed: Column, ignored: Column, stale: Column, proven: Column) -> Column:
    return F.when(proposed, "proposed").when(ignored, "ignored").when(stale, "stale").when(~F.coalesce(proven, F.lit(False)), "unproven").otherwise("proven")


def listing_can_change(status: Column) -> Column:
    return status != "modified"


def query_intent(terms: Column, tooling: Sequence[str], operations: Sequence[str]) -> Column:
    """agent-tooling or project-operations with two of their terms, else repository."""
    shared = lambda words: F.size(F.array_intersect(terms, F.array(*map(F.lit, words)))) >= 2
    return F.when(shared(tooling), "agent-tooling").when(shared(operations), "project-operations").otherwise("repository")


def relative(root: Column, path: Column) -> Column:
    return F.when(path.startswith(F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)


def file_of(identifier: Column, sep: str = "::") -> Column:
    return F.substring_index(identifier, sep, 1)


def granularity(identifier: Column, sep: str = "::") -> Column:
    return F.when(F.contains(identifier, F.lit(sep)), "test").when(F.substring_index(identifier, "/", -1).contains("."), "file").otherwise("package")


def unit_parent(unit: Column) -> Column:
    """The directory of what stands behind the first colon."""
    path = F.regexp_replace(unit, "^[^:]*:", "")
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def check_query(task: str, most: int = 8000) -> str:
    """A task text, refused if empty, not UTF-8 or too long: on the driver, before any plan."""
    if not task.strip() or len(task) > most:
        raise ValueError(f"a task has 1 to {most} characters")
    task.encode()
    return task


def check_choices(chosen: Sequence[str], known: Sequence[str], most: int) -> None:
    """Bounded arguments of a closed list, without repeats."""
    if len(chosen) > most or len(set(chosen)) != len(chosen) or not set(chosen) <= set(known):
        raise ValueError(f"choose up to {most} of {', '.join(known)}, each once")


def remedy(reason: Column, candidates: Column) -> Column:
    """What would settle an unknown: one candidate is to be declared, several are to be chosen from, none is uncertainty."""
    n = F.coalesce(F.size(candidates), F.lit(0))
    return F.when(reason.isNull(), F.lit(None).cast("string")).when(n == 1, F.concat(F.lit("declare "), F.get(candidates, F.lit(0)))).when(n > 1, F.concat(F.lit("choose of "), n.cast("string"))).otherwise(F.concat(F.lit("uncertain: "), reason))


def as_of_problem(kind: Column, value: Column, source: Column) -> Column:
    """Null for a valid as-of point, else the rule that it breaks."""
    control = source.rlike("[\\x00-\\x1F\\x7F-\\x9F]")
    stamp = value.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$") & F.try_to_timestamp(value).isNotNull()
    number = value.rlike("^(0|[1-9][0-9]*)$") & (value.try_cast("decimal(38,0)") <= F.lit("18446744073709551615").cast("decimal(38,0)"))
    known = kind.isin("timestamp", "sha256", "sequence")
    return (
        F.when((F.coalesce(F.octet_length(source), F.lit(0)) == 0) | (F.octet_length(source) > 128) | control, "source")
        .when(~F.coalesce(known, F.lit(False)), "kind")
        .when((kind == "timestamp") & ~F.coalesce(stamp, F.lit(False)), "timestamp")
        .when((kind == "sha256") & ~F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False)), "sha256")
        .when((kind == "sequence") & ~F.coalesce(number, F.lit(False)), "sequence")
    )


def as_of_lag(kind: Column, pinned: Column, live: Column) -> tuple[Column, Column]:
    """(state, lag) of a pinned point against a live one: fresh, stale or unknown; entries or seconds where they can be told."""
    number = lambda c: F.when(c.rlike("^(0|[1-9][0-9]*)$"), c.try_cast("decimal(20,0)"))
    ahead = F.when(kind == "sequence", number(live) - number(pinned)).when(kind == "timestamp", F.unix_seconds(F.try_to_timestamp(live)) - F.unix_seconds(F.try_to_timestamp(pinned)))
    state = F.when((kind == "sha256") & live.isNotNull(), F.when(live == pinned, "fresh").otherwise("stale")).when(ahead.isNull(), "unknown").when(ahead > 0, "stale").when((ahead == 0) | (kind == "timestamp"), "fresh").otherwise("unknown")
    return state, F.when((state == "stale") & (kind != "sha256"), ahead.cast("long"))


def inventory_state(provided: Column, receipt: Column, bound: Column, head: Column, differences: Column) -> Column:
    """What is known of an inventory that may be absent, late or partial: a state, never a dropped row."""
    return (
        F.when(~F.coalesce(provided, F.lit(False)), "ABSENT")
        .when(receipt.isNull(), "COMPLETE")
        .when(bound.isNull(), "UNVERIFIED")
        .when(bound != head, "STALE")
        .when(F.coalesce(differences, F.lit(0)) > 0, "PARTIAL")
        .otherwise("COMPLETE")
    )
