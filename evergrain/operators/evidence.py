"""Joins and folds over test evidence that abstain instead of guessing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import sweep
from .graph import _cut
from .joins import ancestors
from .sequence import numbered


def strength(outcome: Column, outside: Column) -> Column:
    """An aggregate: any survived, else outside assertions are not measured, else all killed, else incomplete."""
    return F.when(F.bool_or(outcome == "survived"), "survived").when(F.bool_or(outside), "not measured").when(F.bool_and(F.coalesce(outcome == "killed", F.lit(False))), "killed").otherwise("incomplete")


def hygiene(findings: DataFrame, key: str, order: str) -> DataFrame:
    """(key, state, reason, anchors): the first invalid finding, else the first abstained; anchors in first-seen order."""
    first = lambda s: F.min(F.when(F.col("state") == s, F.struct(order, "reason")))
    got = findings.groupBy(key).agg(first("invalid").alias("i"), first("abstained").alias("a"), F.array_sort(F.collect_list(F.struct(order, "anchor"))).alias("x"))
    state = F.when(F.col("i").isNotNull(), "invalid").when(F.col("a").isNotNull(), "abstained").otherwise("valid")
    return got.select(key, state.alias("state"), F.coalesce("i.reason", "a.reason").alias("reason"), F.array_distinct(F.transform("x", lambda s: s["anchor"])).alias("anchors"))


def merge_max(a: Column, b: Column) -> Column:
    """Element by element the greater of two arrays; the longer one's rest stays."""
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def line_states(units: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A line ran if any of its units that is not blank ran."""
    return units.filter(~F.col("blank")).groupBy(*keys).agg(F.bool_or("ran").alias("ran"))


def innermost(points: DataFrame, bodies: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    """Points with the narrowest body (open, close) strictly around [low, high]; the lines high and low beside an insertion (low = high + 1)
    may be its edges."""
    return points.join(sweep.around(points, bodies, keys, low, high), [*keys, low, high])


def line_tests(changed: DataFrame, lines: DataFrame, body_tests: DataFrame, body: str, line: str) -> DataFrame:
    """(body, test): tests of the changed lines; where a line is not instrumented, all of the body's."""
    hit = changed.join(lines, [body, line], "left")
    open_bodies = hit.groupBy(body).agg(F.bool_or(F.col("test").isNull()).alias("widen"))
    exact = hit.filter(F.col("test").isNotNull()).select(body, "test")
    wide = open_bodies.filter("widen").join(body_tests, body).select(body, "test")
    return exact.unionByName(wide).distinct()


def require_all(selections: DataFrame, rows: DataFrame, selector: str) -> DataFrame:
    """rows ⋈ selections, with the ids that select each row; one selection without a row fails the query."""
    joined = selections.join(rows.select(selector).distinct().withColumn("_in", F.lit(True)), selector, "left")
    checked = joined.select(F.when(F.col("_in").isNull(), F.raise_error(F.concat(F.lit("no row for selector "), F.col(selector)))).otherwise(F.col(selector)).alias(selector), "id")
    ids = checked.groupBy(selector).agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return rows.join(ids, selector, "left")


def environment_changes(base: DataFrame, head: DataFrame, uses: DataFrame) -> DataFrame:
    """(name, before, after, dependents): variables whose value differs, or that one side lacks."""
    both = base.select("name", F.col("value").alias("before")).join(head.select("name", F.col("value").alias("after")), "name", "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
    by = uses.groupBy("name").agg(F.array_sort(F.collect_set("user")).alias("dependents"))
    return both.join(by, "name", "left").withColumn("dependents", F.coalesce("dependents", F.array().cast("array<string>")))


def resolve(asked: DataFrame, listing: DataFrame) -> DataFrame:
    """(id, selection, target): a listed id is a test, a repeated one its file, an absent one a dangling file, none all."""
    held = listing.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    file = F.substring_index("id", "::", 1)
    kind = F.when(F.col("id").isNull() | (F.col("id") == ""), "all").when(F.col("n") == 1, "test").when(F.col("n") > 1, "file").otherwise("dangling")
    return asked.select("id").distinct().join(held, "id", "left").select("id", kind.alias("selection"), F.when(kind == "test", F.col("id")).when(kind != "all", file).alias("target"))


def attribute(records: DataFrame, tests: str, marked: str) -> DataFrame:
    """A record to its marked test, or to each of its tests."""
    return records.withColumn("test", F.explode(F.when(F.col(marked).isNotNull(), F.array(marked)).otherwise(F.col(tests)))).drop(tests, marked)


def first_pattern(paths: DataFrame, patterns: DataFrame, path: str) -> DataFrame:
    """Every path with the first pattern (place, regex) that matches it; patterns are a declared, bounded list."""
    listed = patterns.agg(F.array_sort(F.collect_list(F.struct("place", "regex"))).alias("_p"))
    hit = F.get(F.filter("_p", lambda p: F.regexp_like(F.col(path), p["regex"])), F.lit(0))
    return paths.crossJoin(F.broadcast(listed)).withColumn("pattern", hit.getField("regex")).drop("_p")


def nearest_package(units: DataFrame, packages: DataFrame, path: str) -> DataFrame:
    """The nearest ancestor directory that is a known package."""
    ups = units.select(path, F.posexplode(ancestors(F.col(path))).alias("_up", "package")).filter("_up > 0")
    best = ups.join(packages.select("package").distinct(), "package").groupBy(path).agg(F.min_by("package", "_up").alias("package"))
    return units.join(best, path, "left")


def dictionary(values: DataFrame, key: str) -> DataFrame:
    """(key, id): dense numbers of sorted distinct keys, from 0."""
    return numbered(values.select(key).distinct(), F.col(key), [], "id").withColumn("id", F.col("id") - 1)


def lineage(parents: DataFrame, node: str, parent: str, depth: int = 16) -> DataFrame:
    """(node, chain, state): the way up; cycles and chains past depth are named, not followed.

    A way is doubled each round by that of the node it leads to. Ways that have ended are set aside: they would meet under one null key."""
    ways = parents.select(node, F.array(node).alias("chain"), F.col(parent).alias("_at"))
    have = 1
    while have <= depth:
        ways = _cut(ways)
        take = min(have, depth + 1 - have)  # the last round needs a part alone
        on = ways.select(F.col(node).alias("_at"), F.slice("chain", 1, take).alias("_more"), F.when(F.size("chain") > take, F.get("chain", F.lit(take))).otherwise(F.col("_at")).alias("_on"), F.lit(True).alias("_in"))
        open_ = ways.filter("_at is not null").join(on, "_at", "left")
        moved = open_.select(node, F.concat("chain", F.when(F.col("_in"), F.col("_more")).otherwise(F.array("_at"))).alias("chain"), F.col("_on").alias("_at"))
        ways = moved.unionByName(ways.filter("_at is null"))
        have += take
    # the first place whose node stands before it
    again = F.array_position(F.transform("chain", lambda x, k: F.array_position("chain", x) <= k), True)
    ways = ways.withColumn("_again", again)
    state = F.when(F.col("_again") > 0, "cycle").when(F.col("_at").isNull(), "root").otherwise("too deep")
    return ways.select(node, F.when(F.col("_again") > 0, F.slice("chain", F.lit(1), (F.col("_again") - 1).cast("int"))).otherwise(F.col("chain")).alias("chain"), state.alias("state"))


def relocate(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """anchors (id, path, line, width, digest) against files (path, text): live where the digest still stands, moved if
    it stands elsewhere in the file, changed if the file has none, gone without the file."""
    lines = F.split("text", "\n")
    asked = anchors.join(files, "path", "left")
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size(lines) - F.col("width") + 1, F.lit(1))), lambda n: F.sha2(F.array_join(F.slice(lines, n, F.col("width")), "\n"), 256))
    place = asked.withColumn("_w", windows)
    here = F.try_element_at("_w", F.col("line")) == F.col("digest")
    state = F.when(F.col("text").isNull(), "gone").when(here, "live").when(F.array_contains("_w", F.col("digest")), "moved").otherwise("changed")
    return place.select("id", state.alias("state"), F.when(state == "moved", F.array_position("_w", F.col("digest"))).alias("moved_to"))
