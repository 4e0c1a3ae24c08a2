"""Points of extension: registries of functions by name or suffix, and sources behind small interfaces."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .operators import reachability
from .operators.graph import _cut
from .operators.joins import ancestors


@dataclass(frozen=True)
class Dialect:
    """Hooks of one language: column functions over a source text. What a dialect lacks stays None."""

    name: str
    suffixes: Sequence[str]
    mask: Callable[[Column], Column] | None = None
    imports: Callable[[Column], Column] | None = None
    is_test: Callable[[Column], Column] | None = None


class Dialects:
    """Dialects by suffix; a suffix or name that is taken is refused."""

    def __init__(self, *sets: Dialect):
        self._by: dict[str, Dialect] = {}
        for d in sets:
            self.add(d)

    def add(self, dialect: Dialect) -> None:
        taken = [s for s in dialect.suffixes if s in self._by]
        if taken or any(d.name == dialect.name for d in self._by.values()):
            raise ValueError(f"already registered: {dialect.name} {taken}")
        self._by |= dict.fromkeys(dialect.suffixes, dialect)

    def name_of(self, path: Column) -> Column:
        """The dialect of a path by its longest registered suffix; null for none."""
        out = F.lit(None).cast("string")
        for s in sorted(self._by, key=len):
            out = F.when(path.endswith(s), F.lit(self._by[s].name)).otherwise(out)
        return out

    def apply(self, hook: str, path: Column, text: Column, default: Column) -> Column:
        """A hook by each row's dialect; default where there is none."""
        name, out = self.name_of(path), default
        for d in {d.name: d for d in self._by.values()}.values():
            f = getattr(d, hook)
            if f is not None:
                out = F.when(name == d.name, f(text)).otherwise(out)
        return out


class Overlays:
    """Named sources of facts over a base table; each gives rows (key, value) and a later one wins over those before it."""

    def __init__(self) -> None:
        self._by: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def add(self, name: str, source: Callable[[SparkSession], DataFrame]) -> None:
        if name in self._by:
            raise ValueError(f"already registered: {name}")
        self._by[name] = source

    def over(self, base: DataFrame, key: str, value: str) -> DataFrame:
        """key, value, overlay: the name of the source that a value came from; null for the base's own."""
        out = base.select(key, value, F.lit(None).cast("string").alias("overlay"))
        for name, source in self._by.items():
            new = source(base.sparkSession).select(key, F.col(value).alias("_v"), F.lit(name).alias("_o"))
            joined = out.join(new, key, "full_outer")
            out = joined.select(key, F.when(F.col("_o").isNotNull(), F.col("_v")).otherwise(F.col(value)).alias(value), F.coalesce("_o", "overlay").alias("overlay"))
        return out


class Repository:
    """Blobs and trees of pinned revisions, as views over tables (revision, path, mode, oid) and (oid, body)."""

    def __init__(self, trees: DataFrame, blobs: DataFrame):
        self.trees, self.blobs = trees, blobs

    def tree(self, revision: str) -> DataFrame:
        return self.trees.filter(F.col("revision") == revision).drop("revision")

    def blob(self, revision: str, path: str) -> DataFrame:
        return self.tree(revision).filter(F.col("path") == path).join(self.blobs, "oid")

    def base_blobs(self, paths: DataFrame, revision: str) -> DataFrame:
        """path, oid, body for each path; a path that the revision lacks stays, with nulls."""
        return paths.join(self.tree(revision), "path", "left").join(self.blobs, "oid", "left").select("path", "oid", "body")


class History:
    """Commits (child, parent, and nth if parents are ordered): resolution of prefixes, ancestry, distances, changed paths. Histories of any depth: answers come
    from an index of chains, which is built once. changes: (commit, path) of what each commit touched; trees, if given:
    (commit, path, oid), so that a path that was changed and changed back is unchanged."""

    def __init__(self, parents: DataFrame, changes: DataFrame, trees: DataFrame | None = None):
        self.parents, self.changes, self.trees = parents, changes, trees

    @cached_property
    def edges(self) -> DataFrame:
        return _cut(self.parents)

    @cached_property
    def index(self) -> DataFrame:
        return reachability.chains(self.edges)

    def resolve(self, prefix: str) -> DataFrame:
        """(commit, state): one match is resolved, several are ambiguous, none is unknown."""
        found = self.index.select("commit").filter(F.col("commit").startswith(prefix))
        n = F.count(F.lit(1))
        return found.agg(F.when(n == 1, F.min("commit")).alias("commit"), F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unknown").alias("state"))

    def _pairs(self, older: str, newer: str) -> DataFrame:
        kind = self.index.schema["commit"].dataType
        one = self.parents.sparkSession.createDataFrame([(older, newer)], "older string, newer string")
        return one.select(F.col("older").cast(kind).alias("older"), F.col("newer").cast(kind).alias("newer"))

    def places(self, pairs: DataFrame) -> DataFrame:
        """How far each chain is reached from either side of the pairs."""
        starts = pairs.select(F.col("older").alias("start")).union(pairs.select("newer"))
        return reachability.ancestor_places(self.edges, self.index, starts)

    def ancestors(self, commit: str) -> DataFrame:
        """(node): the commit and all its ancestors."""
        far = self.places(self._pairs(commit, commit)).select("chain", F.col("place").alias("_far"))
        return self.index.join(far, "chain").filter("place <= _far").select(F.col("commit").alias("node"))

    def facts(self, pairs: DataFrame, places: DataFrame | None = None) -> DataFrame:
        """(older, newer, ancestor, distance): whether older is newer or an ancestor of it, and how many commits newer has that
        older has not; null where a commit is unknown."""
        far = self.places(pairs) if places is None else places
        # the index is read once, for the commits that are asked for
        asked = pairs.select(F.col("older").alias("commit")).union(pairs.select("newer")).distinct()
        mine = _cut(self.index.join(asked, "commit", "left_semi"))
        at = mine.select(F.col("commit").alias("older"), "chain", "place")
        found = pairs.select("older", "newer").distinct().join(at, "older", "left")
        known = mine.select(F.col("commit").alias("newer"), F.lit(True).alias("_known"))
        found = found.join(far.select(F.col("start").alias("newer"), "chain", F.col("place").alias("_far")), ["newer", "chain"], "left").join(known, "newer", "left")
        sure = F.col("place").isNotNull() & F.col("_known").isNotNull()
        gained = reachability.ranges(pairs, far, far).groupBy("older", "newer").agg(F.sum(F.col("high") - F.col("low")).alias("_n"))
        answer = F.when(sure, F.coalesce(F.col("place") <= F.col("_far"), F.lit(False)))
        return found.join(gained, ["older", "newer"], "left").select("older", "newer", answer.alias("ancestor"), F.when(sure, F.coalesce("_n", F.lit(0).cast("long"))).alias("distance"))

    def changes_between(self, pairs: DataFrame, places: DataFrame | None = None) -> DataFrame:
        """(older, newer, path): paths that differ between the trees of both, or without trees those that commits of newer, but not of
        older, touched."""
        if self.trees is not None:
            side = lambda name: pairs.select("older", "newer").distinct().join(self.trees.select(F.col("commit").alias(name), "path", F.col("oid").alias(name + "_oid")), name)
            both = side("older").join(side("newer"), ["older", "newer", "path"], "full_outer")
            return both.filter(~F.col("older_oid").eqNullSafe(F.col("newer_oid"))).select("older", "newer", "path")
        far = self.places(pairs) if places is None else places
        # written, so that they are planned by their true size: few ranges, or few commits, meet a long table where it lies
        inside = _cut(reachability.ranges(pairs, far, far)).join(self.index, "chain").filter("place > low and place <= high")
        inside = _cut(inside.select("older", "newer", "commit"))
        return inside.join(self.changes, "commit").select("older", "newer", "path").distinct()

    def is_ancestor(self, old: str, new: str) -> bool:
        return bool(self.facts(self._pairs(old, new)).first().ancestor)

    def distance(self, old: str, new: str) -> int | None:
        return self.facts(self._pairs(old, new)).first().distance

    def changed(self, old: str, new: str) -> DataFrame:
        return self.changes_between(self._pairs(old, new)).select("path")

    def states(self, records: DataFrame, at: Column, retire_after: int = 0) -> DataFrame:
        """(id, state, reason, distance, changed): each record (id, revision, path; a row a linked path, null for none) at a
        commit. current: no linked path, nor any file under one, changed since; retired: one did, more than ``retire_after``
        commits ago (0 retires none); stale otherwise; UNKNOWN, with a reason, where nothing can be said."""
        rows = _cut(records.select("id", F.col("revision").alias("older"), "path", at.alias("newer")))
        outside = F.col("path").startswith("@")
        whole = rows.groupBy("id", "older", "newer").agg(F.count("path").alias("_paths"), F.coalesce(F.bool_or(outside), F.lit(False)).alias("_outside"))
        pairs = _cut(rows.select("older", "newer").distinct())
        places = self.places(pairs)
        facts = self.facts(pairs, places)
        touched = self.changes_between(pairs, places).select("older", "newer", F.explode(ancestors(F.col("path"))).alias("path")).distinct()
        asked = rows.withColumn("_linked", F.col("path")).withColumn("path", F.regexp_replace("path", "/$", ""))
        hit = asked.join(touched, ["older", "newer", "path"]).groupBy("id", "older", "newer").agg(F.array_sort(F.collect_set("_linked")).alias("changed"))
        got = whole.join(facts, ["older", "newer"], "left").join(hit, ["id", "older", "newer"], "left")
        reason = (
            F.when(F.col("_paths") == 0, "no-linked-paths")
            .when(F.col("_outside"), "linked-path-outside-root")
            .when(F.col("ancestor").isNull(), "revision-unresolved")
            .when(~F.col("ancestor"), "not-ancestor")
        )
        old = F.lit(retire_after > 0) & (F.col("distance") > retire_after)
        state = F.when(reason.isNotNull(), "UNKNOWN").when(F.col("changed").isNull(), "current").when(old, "retired").otherwise("stale")
        none = F.array().cast("array<string>")
        return got.select("id", state.alias("state"), reason.alias("reason"), F.when(reason.isNull(), F.col("distance")).alias("distance"), F.when(reason.isNull(), F.coalesce("changed", none)).otherwise(none).alias("changed"))


class CommandReader(DataSourceReader):
    def __init__(self, argv: list[str], seconds: float, most: int):
        self.argv, self.seconds, self.most = argv, seconds, most

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition):
        done = subprocess.run(self.argv, capture_output=True, timeout=self.seconds, check=False)
        if done.returncode or len(done.stdout) > self.most:
            raise RuntimeError(f"the provider failed ({done.returncode}) or gave {len(done.stdout)} bytes of {self.most}")
        json.loads(done.stdout)
        yield (done.stdout.decode(),)


class CommandSource(DataSource):
    """``evidence_command``: one record, as JSON, of a bounded child process. Options: argv (a JSON list), seconds, most_bytes."""

    @classmethod
    def name(cls) -> str:
        return "evidence_command"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema) -> CommandReader:
        return CommandReader(json.loads(self.options["argv"]), float(self.options.get("seconds", "10")), int(self.options.get("most_bytes", "4194304")))


@dataclass
class Runner:
    """A test runner: how its command line is built, and how its report, as lines (path, line, value), becomes rows."""

    name: str
    build: Callable[[Sequence[str]], list[str]]
    parse: Callable[[DataFrame], DataFrame]


@dataclass
class Runners:
    by: dict[str, Runner] = field(default_factory=dict)

    def add(self, runner: Runner) -> None:
        if runner.name in self.by:
            raise ValueError(f"already registered: {runner.name}")
        self.by[runner.name] = runner

    def invocation(self, name: str, tests: Sequence[str]) -> list[str]:
        if not tests or any(t.startswith("-") for t in tests):
            raise ValueError("tests are names, one at least")
        return self.by[name].build(tests)

    def observe(self, name: str, report: DataFrame) -> DataFrame:
        return self.by[name].parse(report).withColumn("runner", F.lit(name))
