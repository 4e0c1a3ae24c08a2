"""Queries over whole tables. Each is one function; SQL holds what DuckDB runs against the same files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digest, exact, text
from ..operators import coverage, graph, intervals, joins, report, search, selection, sequence
from ..sources.tables import micros, table
from ..streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""
    WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 5),
    r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events)
    SELECT c.event_type, c.n, string_agg(CAST(r.event_id AS VARCHAR), ',' ORDER BY r.k) AS examples
    FROM c JOIN r ON c.event_type = r.event_type AND r.k <= 3 GROUP BY c.event_type, c.n
""")
def top_reasons(spark, d):
    return report.top_groups(table(spark, d, "events"), ["event_type"], "event_id", ["ts", "event_id"])


@query("""
    SELECT n.n_name, CASE WHEN count(c.c_custkey) = 0 THEN NULL ELSE count(c.c_custkey) END AS customers,
        CASE WHEN count(c.c_custkey) = 0 THEN NULL ELSE count(CASE WHEN c.c_acctbal > 0 THEN 1 END) END AS reached,
        CASE WHEN count(c.c_custkey) = 0 THEN 'undeclared' WHEN count(CASE WHEN c.c_acctbal > 0 THEN 1 END) = count(*) THEN 'full' ELSE 'partial' END AS state
    FROM nation n LEFT JOIN customer c ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name
""")
def module_coverage(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.count(F.when(F.col("c_acctbal") > 0, 1)).alias("reached"))
    state = F.when(F.col("customers").isNull(), "undeclared").when(F.col("reached") == F.col("customers"), "full").otherwise("partial")
    return table(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", "customers", "reached", state.alias("state"))


@query("""
    SELECT o_orderpriority, count(*) AS n, round(100.0 * count(CASE WHEN o_orderstatus = 'F' THEN 1 END) / count(*), 6) AS resolved FROM orders GROUP BY o_orderpriority
""")
def resolved_percent(spark, d):
    n = F.count(F.lit(1))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(n.alias("n"), report.percent(F.count(F.when(F.col("o_orderstatus") == "F", 1)), n).alias("resolved"))


@query("""
    SELECT CASE WHEN l_quantity < 10 THEN 0 WHEN l_discount > 0.05 THEN 1 ELSE 2 END AS tier, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1
""")
def tier_counts(spark, d):
    tier = F.when(F.col("l_quantity") < 10, 0).when(F.col("l_discount") > 0.05, 1).otherwise(2)
    return table(spark, d, "lineitem").groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("""
    SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS most, count(*) AS n FROM events GROUP BY event_type
""")
def wall_percentiles(spark, d):
    e = table(spark, d, "events")
    ranks = report.nearest_ranks(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95}).drop("n")
    return e.groupBy("event_type").agg(F.max("value").alias("most"), F.count(F.lit(1)).alias("n")).join(ranks, "event_type", "left")


@query("""
    WITH o AS (SELECT l_orderkey, CASE WHEN bool_or(l_discount < 0.01) THEN NULL ELSE CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS DOUBLE) / sum(l_quantity) END AS ratio FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderpriority, CASE WHEN bool_and(ratio IS NOT NULL) THEN round(median(ratio), 6) END AS strict_median, count(ratio) AS complete, count(*) AS n, round(median(ratio), 6) AS loose_median
    FROM o JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority
""")
def strict_median_ratio(spark, d):
    part = F.when(F.col("l_discount") >= 0.01, F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0))
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(report.poisoned_ratio(part, F.col("l_quantity")).alias("ratio"))
    j = o.join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    counts = j.groupBy("o_orderpriority").agg(F.count("ratio").alias("complete"), F.count(F.lit(1)).alias("n"))
    got = counts.join(report.medians(j, ["o_orderpriority"], "ratio", "m").drop("n"), "o_orderpriority", "left")
    return got.select("o_orderpriority", F.when(F.col("complete") == F.col("n"), F.round("m", 6)).alias("strict_median"), "complete", "n", F.round("m", 6).alias("loose_median"))


@query("""
    SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS observations, count(DISTINCT CASE WHEN event_type IN ('click', 'view', 'purchase', 'error') THEN event_type END) AS statuses
    FROM events GROUP BY user_id
    HAVING count(DISTINCT CAST(ts AS DATE)) >= 2 AND count(DISTINCT CASE WHEN event_type IN ('click', 'view', 'purchase', 'error') THEN event_type END) > 1
""")
def flaky_keys(spark, d):
    status = F.when(F.col("event_type").isin("click", "view", "purchase", "error"), F.col("event_type"))
    return table(spark, d, "events").groupBy("user_id").agg(F.count_distinct(F.to_date("ts")).alias("observations"), F.count_distinct(status).alias("statuses")).filter("observations >= 2 and statuses > 1")


@query("SELECT l_orderkey, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) ELSE 'conflict' END AS outcome FROM lineitem GROUP BY l_orderkey")
def merge_outcomes(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(report.agreed(F.col("l_returnflag")).alias("outcome"))


@query("""
    SELECT source, lang, count(*) AS records_in, count(l.doc_id) AS admitted, count(*) - count(l.doc_id) AS dropped, sum(n_chars) AS chars
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY source, lang
""")
def import_parity(spark, d):
    ids = table(spark, d, "labels").select(F.col("doc_id").alias("labelled")).distinct()
    j = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars").join(ids, F.col("doc_id") == F.col("labelled"), "left")
    n, a = F.count(F.lit(1)), F.count("labelled")
    return j.groupBy("source", "lang").agg(n.alias("records_in"), a.alias("admitted"), (n - a).alias("dropped"), F.sum("n_chars").alias("chars"))


@query("""
    WITH s AS (SELECT p.p_partkey, p.p_size, bool_or(l.l_partkey IS NOT NULL) AS owned FROM part p LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45) l ON p.p_partkey = l.l_partkey GROUP BY 1, 2)
    SELECT CASE WHEN p_size > 40 THEN 'out of scope' WHEN owned THEN 'owned' ELSE 'unowned' END AS state, count(*) AS parts, min(p_partkey) AS first FROM s GROUP BY 1
""")
def ownership_gaps(spark, d):
    owned = table(spark, d, "lineitem").filter("l_quantity > 45").select("l_partkey").distinct()
    j = table(spark, d, "part").select("p_partkey", "p_size").join(owned, F.col("p_partkey") == F.col("l_partkey"), "left")
    state = F.when(F.col("p_size") > 40, "out of scope").when(F.col("l_partkey").isNotNull(), "owned").otherwise("unowned")
    return j.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("parts"), F.min("p_partkey").alias("first"))


@query("""
    WITH b AS (SELECT doc_id, lang AS m, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0),
    h AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'xx' ELSE lang END AS m, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 9 <> 0)
    SELECT coalesce(b.doc_id, h.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN h.doc_id IS NULL THEN 'deleted' WHEN b.h IS NULL OR h.h IS NULL THEN 'unknown'
        WHEN b.m IS DISTINCT FROM h.m THEN 'type-changed' WHEN b.h <> h.h THEN 'modified' ELSE 'unchanged' END AS status
    FROM b FULL OUTER JOIN h ON b.doc_id = h.doc_id
""")
def change_status(spark, d):
    docs = table(spark, d, "documents")
    base = docs.filter("doc_id % 7 <> 0").select("doc_id", F.col("lang").alias("m"), F.sha2("text", 256).alias("h"))
    new = F.when(F.col("doc_id") % 13 == 0, None).when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256))
    head = docs.filter("doc_id % 9 <> 0").select("doc_id", F.when(F.col("doc_id") % 11 == 0, "xx").otherwise(F.col("lang")).alias("m"), new.alias("h"))
    return joins.change_status(base, head, "doc_id", "m", "h")


@query("""
    WITH m AS (SELECT min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) // 2 AS mid FROM events),
    b AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS b FROM events, m WHERE epoch_us(ts) < mid GROUP BY user_id),
    h AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS h FROM events, m WHERE epoch_us(ts) >= mid GROUP BY user_id)
    SELECT coalesce(b.user_id, h.user_id) AS user_id, CASE WHEN b.b IS NULL OR h.h IS NULL THEN 'UNKNOWN' WHEN b.b = h.h THEN 'same' ELSE 'changed' END AS state,
        CASE WHEN b.b IS NOT NULL AND h.h IS NOT NULL THEN array_to_string(list_sort(list_filter(b.b, lambda x: NOT list_contains(h.h, x))), ',') END AS base_only,
        CASE WHEN b.b IS NOT NULL AND h.h IS NOT NULL THEN array_to_string(list_sort(list_filter(h.h, lambda x: NOT list_contains(b.b, x))), ',') END AS head_only,
        CASE WHEN b.b IS NOT NULL AND h.h IS NOT NULL THEN len(list_filter(b.b, lambda x: list_contains(h.h, x))) END AS shared
    FROM b FULL OUTER JOIN h ON b.user_id = h.user_id
""")
def structure_diff(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", micros("ts").alias("t"))
    mid = e.agg((F.min("t") + F.floor((F.max("t") - F.min("t")) / 2)).alias("mid"))
    e = e.crossJoin(F.broadcast(mid))
    return joins.set_difference(e.filter("t < mid"), e.filter("t >= mid"), "user_id", "event_type")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS reason FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_partkey IS NOT NULL)")
def unlinked_tests(spark, d):
    used = table(spark, d, "lineitem").filter(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(used, "p_partkey", "left_anti").select("p_partkey", F.when(F.col("p_size") > 25, "large").otherwise("small").alias("reason"))


@query("""
    SELECT DISTINCT CAST(c_custkey AS BIGINT) AS custkey, 'not discovered' AS reason FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)
    UNION ALL SELECT DISTINCT CAST(o_custkey AS BIGINT) AS custkey, 'not inventoried' AS reason FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
""")
def inventory_differences(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("long").alias("custkey"))
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("custkey"))
    return joins.one_sided(c, o, "custkey", ("not discovered", "not inventoried"))


@query("""
    SELECT 'customer' AS kind, count(DISTINCT c_custkey) AS nodes FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1
    UNION ALL SELECT 'supplier', count(DISTINCT s_suppkey) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1
    UNION ALL SELECT 'order', count(DISTINCT o_orderkey) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1
""")
def one_hop_impact(spark, d):
    n = F.broadcast(table(spark, d, "nation").filter("n_regionkey = 1").select("n_nationkey"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    one = lambda df, kind: df.agg(F.count_distinct(df.columns[0]).alias("nodes")).select(F.lit(kind).alias("kind"), "nodes")
    return one(c, "customer").unionByName(one(s, "supplier")).unionByName(one(o, "order"))


@query("SELECT n_name, count(*) AS owners, min(s_name) AS first FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%') AND s_acctbal > 0 GROUP BY n_name")
def documenting_owners(spark, d):
    r = table(spark, d, "region").filter(F.col("r_name").startswith("A")).select(F.col("r_regionkey").alias("n_regionkey"))
    n = table(spark, d, "nation").join(r, "n_regionkey", "left_semi").select("n_nationkey", "n_name")
    return table(spark, d, "supplier").filter("s_acctbal > 0").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("owners"), F.min("s_name").alias("first"))


@query("""
    SELECT c.role, d.lang, count(*) AS links, count(DISTINCT c.conv_id) AS conversations FROM conversations c JOIN documents d ON c.conv_id = d.doc_id GROUP BY c.role, d.lang
""")
def link_dictionary(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "role")
    return c.join(table(spark, d, "documents").select("doc_id", "lang"), F.col("conv_id") == F.col("doc_id")).groupBy("role", "lang").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("conv_id").alias("conversations"))


@query("""
    WITH k AS (SELECT item_id, sha256(text) AS h FROM benchmark), t AS (SELECT doc_id, sha256(text) AS h FROM documents)
    SELECT k.item_id, count(t.doc_id) AS matches, CASE count(t.doc_id) WHEN 0 THEN 'missing' WHEN 1 THEN 'associated' ELSE 'ambiguous' END AS state FROM k LEFT JOIN t ON k.h = t.h GROUP BY k.item_id
""")
def claim_association(spark, d):
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("k"))
    j = table(spark, d, "benchmark").select("item_id", F.sha2("text", 256).alias("h")).join(docs, "h", "left").groupBy("item_id").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("matches"))
    return j.select("item_id", "matches", joins.match_state(F.col("matches")).alias("state"))


@query("""
    SELECT l_orderkey, count(*) AS inside FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE epoch_us(l_shipdate) BETWEEN epoch_us(o_orderdate) AND epoch_us(o_orderdate) + 2592000000000 GROUP BY l_orderkey
""")
def blocks_at_line(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), micros("o_orderdate").alias("s")).withColumn("e", F.col("s") + 2592000000000)
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), micros("l_shipdate").alias("at"))
    return joins.containing(li, o, ["k"], "at", "at", "s", "e").groupBy(F.col("k").alias("l_orderkey")).agg(F.count(F.lit(1)).alias("inside"))


_SPANS = "SELECT o_orderkey AS k, o_custkey AS c, CAST(epoch_us(o_orderdate) // 86400000000 AS BIGINT) AS s, CAST(epoch_us(o_orderdate) // 86400000000 AS BIGINT) + CAST(o_orderkey % 40 AS BIGINT) AS e FROM orders"


def _spans(spark, d):
    day = F.floor(micros("o_orderdate") / 86400000000)
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_custkey").cast("long").alias("c"), day.alias("s"), (day + F.col("o_orderkey") % 40).alias("e"))


@query(f"""
    WITH x AS ({_SPANS}) SELECT a.c AS custkey, count(*) AS pairs FROM x a JOIN x b ON a.c = b.c AND a.k < b.k AND a.s <= b.e AND b.s <= a.e GROUP BY a.c
""")
def overlap_hunks(spark, d):
    x = _spans(spark, d)
    return joins.overlapping(x, x, 64, "s", "e").filter("c = o_c and k < o_k").groupBy(F.col("c").alias("custkey")).agg(F.count(F.lit(1)).alias("pairs"))


@query("""
    WITH hunks AS (SELECT o_custkey AS c, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) * 20 AS BIGINT) AS os, CAST(o_orderkey % 6 AS BIGINT) AS oc, CAST(o_orderkey % 9 AS BIGINT) AS nc FROM orders),
    lines AS (SELECT DISTINCT o_custkey AS c, CAST(o_orderkey % 200 + 1 AS BIGINT) AS line FROM orders),
    j AS (SELECT l.c, l.line, coalesce(sum(h.nc - h.oc), 0) AS shift, max(h.os) AS last, arg_max(h.oc, h.os) AS cnt, arg_max(h.nc - h.oc, h.os) AS own FROM lines l LEFT JOIN hunks h ON l.c = h.c AND h.os <= l.line GROUP BY l.c, l.line)
    SELECT c AS custkey, line, CAST(CASE WHEN coalesce(line < last + cnt, FALSE) THEN last + shift - own ELSE line + shift END AS BIGINT) AS mapped, NOT coalesce(line < last + cnt, FALSE) AS ok FROM j
""")
def line_mapping(spark, d):
    from pyspark.sql.window import Window

    o = table(spark, d, "orders")
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    hunks = o.select(F.col("o_custkey").alias("custkey"), (k * 20).cast("long").alias("old_start"), (F.col("o_orderkey") % 6).cast("long").alias("old_count"), (F.col("o_orderkey") % 9).cast("long").alias("new_count"))
    lines = o.select(F.col("o_custkey").alias("custkey"), (F.col("o_orderkey") % 200 + 1).cast("long").alias("line")).distinct()
    return intervals.map_lines(lines, hunks, ["custkey"], "line")


@query("""
    WITH x AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + 300000000 AS e FROM events),
    f AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM x),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM f)
    SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS members FROM g GROUP BY user_id, i
""")
def range_union(spark, d):
    x = table(spark, d, "events").select("user_id", micros("ts").alias("s")).withColumn("e", F.col("s") + 300000000)
    return intervals.union(x, ["user_id"], "s", "e")


@query("""
    WITH x AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + 3600000000 AS e, event_type FROM events),
    p AS (SELECT user_id, s AS spot, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS p, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS q FROM x
          UNION ALL SELECT user_id, e, CASE WHEN event_type = 'view' THEN -1 ELSE 0 END, CASE WHEN event_type = 'view' THEN 0 ELSE -1 END FROM x),
    g AS (SELECT user_id, spot, sum(p) AS p, sum(q) AS q FROM p GROUP BY user_id, spot),
    w AS (SELECT user_id, spot AS s, lead(spot) OVER o AS e, sum(p) OVER o AS a, sum(q) OVER o AS b FROM g WINDOW o AS (PARTITION BY user_id ORDER BY spot)),
    k AS (SELECT user_id, s, e FROM w WHERE a > 0 AND b = 0 AND e IS NOT NULL),
    f AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM k),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM f)
    SELECT user_id, min(s) AS s, max(e) AS e FROM i GROUP BY user_id, i
""")
def range_subtract(spark, d):
    x = table(spark, d, "events").select("user_id", "event_type", micros("ts").alias("s")).withColumn("e", F.col("s") + 3600000000)
    return intervals.subtract(x.filter("event_type = 'view'"), x.filter("event_type <> 'view'"), ["user_id"], "s", "e")


@query(f"""
    WITH x AS ({_SPANS}), r AS (SELECT a.k AS point, b.k AS painter, row_number() OVER (PARTITION BY a.k ORDER BY b.e - b.s, b.k DESC) AS r FROM x a JOIN x b ON a.c = b.c AND a.s BETWEEN b.s AND b.e)
    SELECT point, painter FROM r WHERE r = 1
""")
def paint_narrowest(spark, d):
    x = _spans(spark, d)
    points = x.select("c", F.col("k").alias("point"), F.col("s").alias("at"))
    return intervals.narrowest(points, x, ["c"], "at", "s", "e", "k", ["point"]).select("point", F.col("k").alias("painter"))


@query("""
    WITH f AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
    SELECT conv_id, count(*) AS n, CAST(sum(CASE WHEN p IS NOT NULL AND turn <> p + 1 THEN 1 ELSE 0 END) AS BIGINT) AS breaks, min(CASE WHEN p IS NOT NULL AND turn <> p + 1 THEN turn END) AS first_break FROM f GROUP BY conv_id
""")
def continuity(spark, d):
    return sequence.continuity(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], "turn")


@query("""
    SELECT conv_id, turn, coalesce(string_agg(role, '>') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prior,
        coalesce(string_agg(role, '>') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS later FROM conversations
""")
def prior_later_sets(spark, d):
    return sequence.around(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role").drop("role")


@query("""
    WITH r AS (SELECT l_partkey, l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount = 0, l_extendedprice, l_orderkey, l_linenumber) AS r FROM lineitem)
    SELECT l_partkey, l_suppkey, l_extendedprice FROM r WHERE r = 1
""")
def representatives(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_orderkey", "l_linenumber")
    return sequence.representative(li, ["l_partkey"], [F.col("l_discount") == 0, F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]).select("l_partkey", "l_suppkey", "l_extendedprice")


@query("""
    WITH r AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, event_id, event_type, value FROM r WHERE r = 1
""")
def latest_row(spark, d):
    return sequence.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("""
    WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 2))) AS term FROM documents)
    SELECT term, count(*) AS df FROM w GROUP BY term HAVING count(*) >= 3
""")
def document_frequency(spark, d):
    terms = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: F.length(x) >= 2)
    return search.document_frequency(table(spark, d, "documents").select("text"), terms).filter("df >= 3")


_CAMEL = "regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1-\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1-\\2', 'g')"


@query(f"""
    WITH s AS (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) >= 2)) AS t FROM documents)
    SELECT doc_id, len(t) AS terms, list_min(t) AS first, list_max(t) AS last FROM s
""")
def doc_terms(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.lexical_terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("terms"), F.array_min("t").alias("first"), F.array_max("t").alias("last"))


@query("""
    SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(regexp_replace(regexp_replace(p_name || ' ' || p_type, '([\\p{Ll}\\p{N}])(\\p{Lu})', '\\1 \\2', 'g'), '(\\p{Lu})(\\p{Lu}\\p{Ll})', '\\1 \\2', 'g'), '[\\p{L}\\p{N}]+'), lambda x: lower(x)), ' ') AS words FROM part
""")
def identifier_words(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(text.identifier_words(F.concat("p_name", F.lit(" "), "p_type")), " ").alias("words"))


_SINGULAR = "CASE WHEN length(w) > 5 AND w LIKE '%ies' THEN substr(w, 1, length(w) - 3) || 'y' WHEN length(w) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN substr(w, 1, length(w) - 1) ELSE w END"


@query(r"""
    WITH w AS (SELECT p_partkey, list_transform(regexp_extract_all(regexp_replace(regexp_replace(p_brand || 'List' || p_name || repeat(p_type || 's ', p_size // 3), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_-]', ' ', 'g'), '[A-Za-z][A-Za-z0-9]*'), lambda x: lower(x)) AS w FROM part),
    j AS (SELECT p_partkey, array_to_string(list_transform(w, lambda x: CASE WHEN length(x) > 5 AND x LIKE '%ies' THEN substr(x, 1, length(x) - 3) || 'y' WHEN length(x) > 4 AND x LIKE '%s' AND x NOT LIKE '%ss' THEN substr(x, 1, length(x) - 1) ELSE x END), '-') AS j FROM w)
    SELECT p_partkey, trim(substr(j, 1, 96), '-') AS slug FROM j
""")
def selector_slug(spark, d):
    name = F.concat("p_brand", F.lit("List"), "p_name", F.repeat(F.concat("p_type", F.lit("s ")), F.floor(F.col("p_size") / 3).cast("int")))
    return table(spark, d, "part").select("p_partkey", text.slug(name).alias("slug"))


@query(r"""
    WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name || ' ' || p_type || ' revoke set work toy'), '[a-z]+')) AS term FROM part)
    SELECT term, unnest(list_concat([term || 's', term || 'es', term || 'ed', term || 'ing'], CASE WHEN regexp_matches(term, '[aeiou][^aeiouwxy]$') THEN [term || right(term, 1) || 'ed', term || right(term, 1) || 'ing'] ELSE [] END, CASE WHEN term LIKE '%e' THEN [term || 'd', left(term, length(term) - 1) || 'ing'] ELSE [] END)) AS form
    FROM t WHERE length(term) >= 3
""")
def inflection_forms(spark, d):
    words = F.regexp_extract_all(F.lower(F.concat("p_name", F.lit(" "), "p_type", F.lit(" revoke set work toy"))), F.lit("[a-z]+"), F.lit(0))
    return table(spark, d, "part").select(F.explode(words).alias("term")).distinct().select("term", F.explode(text.inflections(F.col("term"))).alias("form"))


@query("""
    WITH q AS (SELECT unnest(['that', 'thats', 'thates', 'thated', 'thating', 'thatted', 'thatting']) AS term),
    w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM documents)
    SELECT w.doc_id, count(*) AS hits FROM w JOIN q ON w.term = q.term GROUP BY w.doc_id
""")
def inflection_search(spark, d):
    base = F.lit("that")
    wide = spark.range(1).select(F.explode(F.concat(F.array(base), text.inflections(base))).alias("term"))
    words = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term"))
    return words.join(F.broadcast(wide), "term").groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))


@query("""
    WITH p AS (SELECT item_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z]+'), ' ') || ' ' AS phrase FROM benchmark WHERE len(regexp_extract_all(lower(text), '[a-z]+')) > 0),
    t AS (SELECT DISTINCT text, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z]+'), ' ') || ' ' AS words FROM documents)
    SELECT p.item_id, count(*) AS docs FROM p JOIN t ON contains(t.words, p.phrase) GROUP BY p.item_id
""")
def phrase_match(spark, d):
    """(item_id, docs): distinct texts that hold all words of a benchmark text as one run. The first words, three at most,
    find the candidates, by a hash; the whole phrase is looked up in them."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.slice("w", i, F.lit(n))))
    docs = table(spark, d, "documents").select("text").distinct().select(F.xxhash64("text").alias("h"), words("text").alias("w"))
    asked = table(spark, d, "benchmark").select("item_id", words("text").alias("phrase")).filter(F.size("phrase") > 0)
    near = None
    for n in (1, 2, 3):
        own = asked.filter(F.size("phrase") >= 3 if n == 3 else F.size("phrase") == n).withColumn("start", F.xxhash64(F.slice("phrase", 1, n)))
        some = docs.filter(F.size("w") >= n).select("h", F.explode(F.array_distinct(grams(n))).alias("start")).join(own, "start").select("item_id", "phrase", "h")
        near = some if near is None else near.unionByName(some)
    return docs.join(near, "h").filter(text.holds_phrase(F.col("w"), F.col("phrase"))).groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"))


@query("""
    SELECT c_custkey, row_number() OVER (ORDER BY length(k), k, name, c_custkey) AS rank FROM (SELECT c_custkey, 'c00' || c_custkey || '0000000000000000000000' AS name, c_custkey || '0000000000000000000000' AS k FROM customer)
""")
def natural_sort(spark, d):
    name = F.concat(F.lit("c00"), F.col("c_custkey").cast("string"), F.lit("0" * 22))
    return sequence.numbered(table(spark, d, "customer").select("c_custkey", name.alias("name")), text.natural_key(F.col("name")), [F.col("name"), F.col("c_custkey")], "rank").select("c_custkey", "rank")


@query("""
    WITH r AS (SELECT page_id, regexp_extract_all(url || ' ' || html, '(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+') AS refs FROM pages)
    SELECT page_id, len(refs) AS n, list_min(refs) AS first FROM r
""")
def path_refs(spark, d):
    r = table(spark, d, "pages").select("page_id", text.path_references(F.concat("url", F.lit(" "), "html")).alias("r"))
    return r.select("page_id", F.size("r").cast("long").alias("n"), F.array_min("r").alias("first"))


@query("""
    WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
    f AS (SELECT doc_id, len(w) AS length, u.term, count(*) AS tf FROM t, unnest(w) AS u(term) WHERE u.term IN ('that', 'with', 'und', 'para') GROUP BY doc_id, len(w), u.term),
    g AS (SELECT term, count(*) AS df FROM f GROUP BY term)
    SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.7 + 0.3 * length / mean))), 6) AS score, count(*) AS terms
    FROM f JOIN g ON f.term = g.term, s GROUP BY doc_id ORDER BY score DESC, terms DESC, doc_id LIMIT 20
""")
def bm25_topk(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return search.bm25(table(spark, d, "documents").select("doc_id", "text"), "doc_id", words, ["that", "with", "und", "para"])


@query("""
    WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents),
    q AS (SELECT unnest(['that', 'with', 'zzyzx', 'qqq']) AS term), g AS (SELECT q.term, count(w.doc_id) AS df FROM q LEFT JOIN w ON q.term = w.term GROUP BY q.term),
    i AS (SELECT df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM g, n)
    SELECT round(sum(CASE WHEN df = 0 THEN idf ELSE 0 END) / sum(idf), 6) AS unmatched, sum(CASE WHEN df = 0 THEN idf ELSE 0 END) / sum(idf) > 0.5 AS weak FROM i
""")
def weak_search(spark, d):
    docs = table(spark, d, "documents").select("text")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    asked = ["that", "with", "zzyzx", "qqq"]
    df = search.document_frequency(docs, F.filter(words, lambda t: t.isin(*asked)))
    return search.weak_share(df, docs.count(), asked)


@query("""
    WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY length(text) - length(replace(text, 'th', '')) DESC, doc_id) AS rank FROM documents),
    u AS (SELECT * FROM a WHERE rank <= 50 UNION ALL SELECT * FROM b WHERE rank <= 50) SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM u GROUP BY doc_id
""")
def rrf_fusion(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", (F.length("text") - F.length(F.replace("text", F.lit("th"), F.lit("")))).alias("th"))
    a = search.ranked(docs, [F.desc("n_chars"), F.col("doc_id")], "doc_id", 50)
    return search.fuse([a, search.ranked(docs, [F.desc("th"), F.col("doc_id")], "doc_id", 50)], "doc_id")


@query("SELECT o_orderkey, o_totalprice, (SELECT greatest(count(*) - 150, 0) FROM orders) AS omitted FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_window(spark, d):
    return sequence.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 100, 50)


@query("""
    WITH r AS (SELECT source, doc_id, CAST(sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bytes_upto FROM documents) SELECT source, doc_id, bytes_upto FROM r WHERE bytes_upto <= 20000
""")
def byte_budget_page(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", F.octet_length("text").alias("b"))
    return sequence.byte_budget(docs, ["source"], [F.col("doc_id")], F.col("b"), 20000).drop("b")


def most_paths(commits: int) -> int:
    """The recorded cap on a commit's paths: 50 up to 50 commits, 8 from 200 on, linear between."""
    return 50 - 42 * (min(max(commits, 50), 200) - 50) // 150


@query("""
    WITH l AS (SELECT DISTINCT l_orderkey, l_partkey % 200 AS p FROM lineitem), s AS (SELECT l_orderkey FROM l GROUP BY l_orderkey HAVING count(*) <= 8),
    k AS (SELECT l.* FROM l JOIN s ON l.l_orderkey = s.l_orderkey) SELECT a.p AS a, b.p AS b, count(*) AS n FROM k a JOIN k b ON a.l_orderkey = b.l_orderkey AND a.p < b.p GROUP BY 1, 2
""")
def cochange(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 200).alias("p"))
    return coverage.cochange(li, "l_orderkey", "p", most_paths(li.agg(F.count_distinct("l_orderkey")).first()[0]))


@query("""
    WITH m AS (SELECT max(CAST(ts AS DATE)) AS now FROM events) SELECT user_id, round(sum(pow(0.5, date_diff('day', CAST(ts AS DATE), now) / 90.0)), 6) AS recency FROM events, m GROUP BY user_id
""")
def recency_score(spark, d):
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"))
    now = e.agg(F.max("day").alias("now"))
    daily = e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("k"))
    return daily.crossJoin(F.broadcast(now)).groupBy("user_id").agg(F.round(F.sum(F.col("k") * F.pow(F.lit(0.5), F.date_diff("now", "day") / 90.0)), 6).alias("recency"))


@query("""
    WITH r AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS i FROM lineitem), f AS (SELECT i, count(*) AS df FROM r GROUP BY i), s AS (SELECT o, count(*) AS n, count(*) FILTER (WHERE df = 1) AS u, string_agg(CAST(r.i AS VARCHAR), ',' ORDER BY r.i) AS k FROM r JOIN f ON r.i = f.i GROUP BY o),
    e AS (SELECT s.o, min(t.o) AS b FROM s JOIN s t ON s.k = t.k AND s.o <> t.o GROUP BY s.o),
    p AS (SELECT a.o, b.o AS w, count(*) AS c FROM r a JOIN s ON s.o = a.o AND s.u = 0 JOIN r b ON a.i = b.i AND a.o <> b.o JOIN s t ON t.o = b.o AND t.n > s.n GROUP BY a.o, b.o),
    t AS (SELECT p.o, arg_min(p.w, x.n * 100000000 + p.w) AS b FROM p JOIN s ON s.o = p.o AND p.c = s.n JOIN s x ON x.o = p.w GROUP BY p.o),
    a AS (SELECT o_orderkey AS owner, CASE WHEN s.o IS NULL THEN 'no-blocks' WHEN e.b IS NOT NULL THEN 'equal' WHEN t.b IS NOT NULL THEN 'subset' WHEN u = 0 THEN 'union' WHEN u <= 1 THEN 'low-unique' END AS kind, coalesce(e.b, t.b) AS by, coalesce(n, 0) AS size, coalesce(u, 0) AS "unique"
        FROM orders LEFT JOIN s ON s.o = o_orderkey LEFT JOIN e ON e.o = o_orderkey LEFT JOIN t ON t.o = o_orderkey)
    SELECT * FROM a WHERE kind IS NOT NULL
""")
def redundancy_kinds(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_partkey").alias("i"))
    return selection.redundancy(rows, "owner", "i", table(spark, d, "orders").select(F.col("o_orderkey").alias("owner")))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unindexed_tests(spark, d):
    return selection.unindexed(table(spark, d, "orders"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("""
    WITH s AS (SELECT l_orderkey AS o, list_sort(list_distinct(list(l_suppkey % 10))) AS i FROM lineitem GROUP BY l_orderkey) SELECT sha256(array_to_string(i, ',')) AS signature, count(*) AS owners, min(o) AS first, max(len(i)) AS blocks FROM s GROUP BY 1
""")
def equivalence_classes(spark, d):
    return coverage.classes(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), (F.col("l_suppkey") % 10).alias("i")), "o", "i")


_EDGES = "SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT 'p' || l_partkey, 'o' || l_orderkey FROM lineitem UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders"


def _edges(spark, d):
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey")
    a = li.select(tag("s", "l_suppkey").alias("src"), tag("p", "l_partkey").alias("dst"))
    b = li.select(tag("p", "l_partkey").alias("src"), tag("o", "l_orderkey").alias("dst"))
    c = table(spark, d, "orders").select(tag("o", "o_orderkey").alias("src"), tag("c", "o_custkey").alias("dst"))
    return a.unionByName(b).unionByName(c).distinct()


@query(f"""
    WITH e AS ({_EDGES}), h1 AS (SELECT DISTINCT dst AS node FROM e WHERE src IN ('s1', 's2', 's3')), h2 AS (SELECT DISTINCT e.dst AS node FROM e JOIN h1 ON e.src = h1.node), h3 AS (SELECT DISTINCT e.dst AS node FROM e JOIN h2 ON e.src = h2.node)
    SELECT substr(node, 1, 1) AS kind, hops, count(*) AS nodes FROM (SELECT unnest(['s1', 's2', 's3']) AS node, 0 AS hops UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2 UNION ALL SELECT node, 3 FROM h3) GROUP BY 1, 2
""")
def reach_frontier(spark, d):
    seeds = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "node string")
    return graph.reach(_edges(spark, d), seeds, 3).groupBy(F.substring("node", 1, 1).alias("kind"), "hops").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"""
    WITH e AS ({_EDGES}), h1 AS (SELECT dst AS node, min(src || '>' || dst) AS path FROM e WHERE src IN ('s1', 's2') GROUP BY dst), h2 AS (SELECT e.dst AS node, min(h1.path || '>' || e.dst) AS path FROM e JOIN h1 ON e.src = h1.node GROUP BY e.dst),
    h3 AS (SELECT e.dst AS node, min(h2.path || '>' || e.dst) AS path FROM e JOIN h2 ON e.src = h2.node GROUP BY e.dst)
    SELECT * FROM (SELECT unnest(['s1', 's2']) AS node, 0 AS hops, unnest(['s1', 's2']) AS path UNION ALL SELECT node, 1, path FROM h1 UNION ALL SELECT node, 2, path FROM h2 UNION ALL SELECT node, 3, path FROM h3)
""")
def shortest_path(spark, d):
    return graph.shortest_paths(_edges(spark, d), spark.createDataFrame([("s1",), ("s2",)], "node string"), 3)


@query("""
    SELECT doc_id, 'doc:' || sha256(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id || octet_length(encode(lang)) || ':' || lang || octet_length(encode(text)) || ':' || text) AS id FROM documents
""")
def digest_identity(spark, d):
    return table(spark, d, "documents").select("doc_id", digest.identity("doc", F.col("doc_id"), F.col("lang"), F.col("text")).alias("id"))


@query("""
    WITH m AS (SELECT max(CAST(o_orderdate AS DATE)) AS now FROM orders) SELECT CASE WHEN a IS NULL THEN 'unknown' WHEN a <= 90 THEN 'current' WHEN a <= 365 THEN 'stale' ELSE 'retired' END AS state, count(*) AS n, min(a) AS youngest
    FROM (SELECT date_diff('day', CAST(o_orderdate AS DATE), now) AS a FROM orders, m) GROUP BY 1
""")
def age_policy(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))
    a = o.crossJoin(F.broadcast(o.agg(F.max("day").alias("now")))).select(F.date_diff("now", "day").alias("a"))
    return a.groupBy(digest.age_state(F.col("a"), 90, 365).alias("state")).agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("youngest"))


@query("""
    WITH r AS (SELECT source, doc_id, CASE WHEN doc_id % 17 = 0 THEN 'old' ELSE sha256(text) END AS h FROM documents), s AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 29 <> 0)
    SELECT r.source, bool_and(coalesce(r.h = s.h, FALSE)) AS fresh, count(*) FILTER (WHERE s.h IS NULL) AS gone, count(*) FILTER (WHERE r.h <> s.h) AS changed FROM r LEFT JOIN s ON r.doc_id = s.doc_id GROUP BY r.source
""")
def freshness_join(spark, d):
    docs = table(spark, d, "documents")
    own = F.sha2("text", 256)
    r = docs.select("source", "doc_id", F.when(F.col("doc_id") % 17 == 0, "old").otherwise(own).alias("h"))
    s = docs.filter("doc_id % 29 <> 0").select("doc_id", own.alias("now"))
    same = F.coalesce(F.col("h") == F.col("now"), F.lit(False))
    return r.join(s, "doc_id", "left").groupBy("source").agg(F.bool_and(same).alias("fresh"), F.count(F.when(F.col("now").isNull(), 1)).alias("gone"), F.count(F.when(F.col("h") != F.col("now"), 1)).alias("changed"))


@query("SELECT c_mktsegment, c_custkey, c_mktsegment || CASE WHEN r = 1 THEN '' ELSE '#' || r END AS unique_name, n > 1 AS duplicate FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)")
def disambiguate(spark, d):
    return sequence.disambiguate(table(spark, d, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", ["c_custkey"])


@query("""
    WITH s AS (SELECT n_regionkey, list_sort(list_distinct(list(n_name))) AS i FROM nation GROUP BY n_regionkey) SELECT n_regionkey, array_to_string(list_slice(i, 1, 3), ',') AS shown, greatest(len(i) - 3, 0) AS more FROM s
""")
def first_n_remainder(spark, d):
    return sequence.first_n(table(spark, d, "nation"), ["n_regionkey"], "n_name", 3).withColumn("more", F.col("more").cast("long"))


@query("""
    WITH x AS (SELECT page_id, regexp_replace(url, '^https?://|[?#].*$', '', 'g') AS u FROM pages), p AS (SELECT page_id, string_split(u, '/') AS s FROM x)
    SELECT page_id, CASE WHEN len(s) >= 2 THEN s[1] || '/' || s[2] END AS root FROM p
""")
def longest_prefix_root(spark, d):
    u = table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"^https?://|[?#].*$", "").alias("u"))
    roots = u.filter(F.size(F.split("u", "/")) >= 2).select(F.substring_index("u", "/", 2).alias("root")).distinct()
    best = joins.longest_prefix(u.select("u").distinct(), roots, "u", "root")
    return u.join(best, "u", "left").select("page_id", "root")


@query("""
    SELECT e.event_id, coalesce(CASE WHEN e.event_id % 10 = 0 THEN 'edited' END, e.event_type) AS event_type, e.event_id % 10 = 0 AS advisory FROM events e
""")
def overlay_view(spark, d):
    base = table(spark, d, "events").select("event_id", "event_type")
    return streams.overlay(base, base.filter("event_id % 10 = 0").withColumn("event_type", F.lit("edited")), "event_id")


@query("""
    WITH f AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS i FROM f)
    SELECT user_id, min(t) AS start_us, max(t) + 1800000000 AS end_us, count(*) AS n FROM g GROUP BY user_id, i
""")
def session_windows(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    w = streams.sessions(e, "user_id", "ts", "30 minutes", "1 hour")
    return w.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("""
    SELECT event_id, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS canonical FROM events
""")
def canonical_rows(spark, d):
    e = table(spark, d, "events").select("event_id", F.to_json(F.struct("user_id", "event_type")).alias("j"))
    return e.select("event_id", exact.canonical_json("j").alias("canonical"))


@query("SELECT source, count(*) AS n, CASE WHEN bool_or(lang = 'de') THEN 'de' WHEN bool_or(lang = 'en') THEN 'en' ELSE 'other' END AS worst FROM documents GROUP BY source")
def worst_state(spark, d):
    lang = F.when(F.col("lang").isin("de", "en"), F.col("lang")).otherwise("other")
    return table(spark, d, "documents").select("source", lang.alias("s")).groupBy("source").agg(F.count(F.lit(1)).alias("n"), report.worst_of(F.col("s"), {"other": 0, "en": 1, "de": 2}).alias("worst"))


@query("""
    SELECT n_regionkey, CAST(sum(n_nationkey) AS BIGINT) AS total, count(*) AS n FROM nation GROUP BY n_regionkey
    UNION ALL SELECT NULL, CAST(sum(n_nationkey) AS BIGINT), count(*) FROM nation
""")
def grand_totals(spark, d):
    return table(spark, d, "nation").rollup("n_regionkey").agg(F.sum("n_nationkey").alias("total"), F.count(F.lit(1)).alias("n"))


@query("""
    SELECT part_no, count(*) AS n FROM (SELECT CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 2)) AS INTEGER) % 10 AS part_no FROM documents) GROUP BY part_no
""")
def split_by_hash(spark, d):
    byte = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 2), 16, 10).cast("int")
    return table(spark, d, "documents").select((byte % 10).alias("part_no")).groupBy("part_no").agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, min(value) AS v FROM events GROUP BY 1, 2), m AS (SELECT *, min(v) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM d)
    SELECT user_id, count(*) AS rounds, count(CASE WHEN best IS NULL OR v < best THEN 1 END) AS improved FROM m GROUP BY user_id
""")
def repair_rounds(spark, d):
    from pyspark.sql.window import Window

    daily = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("value").alias("v"))
    best = F.min("v").over(Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    m = daily.withColumn("best", best)
    return m.groupBy("user_id").agg(F.count(F.lit(1)).alias("rounds"), F.count(F.when(F.col("best").isNull() | (F.col("v") < F.col("best")), 1)).alias("improved"))


@query("""
    WITH o AS (SELECT o_custkey, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18, 4))) AS total FROM orders GROUP BY o_custkey) SELECT o_custkey, n, CAST(total AS DOUBLE) AS total FROM o ORDER BY total DESC, o_custkey LIMIT 3
""")
def top_contributors(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,4)")).alias("total"))
    return o.orderBy(F.desc("total"), "o_custkey").limit(3).withColumn("total", F.col("total").cast("double"))
