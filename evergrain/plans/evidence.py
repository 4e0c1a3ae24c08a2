"""Queries of the evidence operators over whole tables, each with its SQL: predicates, joins, folds, formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import diff, digest, exact, lexers, predicates, text
from ..operators import columnar, evidence, graph, intervals, joins, report, search, selection, sequence
from ..sources import archives, formats
from ..sources.tables import table
from .queries import query


def tag(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


# --- formats: lines are made of table rows, parsed, and held against the columns they were made of


@query("""
    SELECT 'src/p' || l_partkey || '.go' AS file, count(*) AS blocks, CAST(sum(l_linenumber) AS BIGINT) AS start_sum, CAST(sum(l_linenumber + l_suppkey) AS BIGINT) AS end_sum, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS hits, min(l_suppkey + 1) AS least_statements
    FROM lineitem GROUP BY l_partkey
""")
def coverprofile_blocks(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_partkey", "l_suppkey", "l_linenumber", "l_orderkey", F.col("l_quantity").cast("long").alias("q"))
    n = lambda c: F.col(c).cast("string")
    value = F.concat(tag("src/p", "l_partkey"), F.lit(".go:"), n("l_linenumber"), F.lit(".2,"), (F.col("l_linenumber") + F.col("l_suppkey")).cast("string"), F.lit(".9 "), (F.col("l_suppkey") + 1).cast("string"), F.lit(" "), n("q"))
    lines = li.select(F.col("l_returnflag").alias("path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), value.alias("value"))
    heads = li.select(F.col("l_returnflag").alias("path"), F.lit(0).cast("long").alias("line"), F.lit("mode: count").alias("value")).distinct()
    b = formats.coverprofile(lines.unionByName(heads))
    return b.groupBy("file").agg(F.count(F.lit(1)).alias("blocks"), F.sum("start").alias("start_sum"), F.sum("end").alias("end_sum"), F.sum(F.col("count").cast("long")).alias("hits"), F.min("statements").alias("least_statements"))


@query("SELECT 'o' || l_orderkey || '.js' AS file, l_linenumber + 1 AS line_no, CAST(l_quantity AS BIGINT) AS hits FROM lineitem")
def lcov_lines(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    row = lambda line, value: F.struct(F.lit(line).cast("long").alias("line") if isinstance(line, int) else line.cast("long").alias("line"), value.alias("value"))
    da = li.select(tag("r", "l_orderkey").alias("path"), (F.monotonically_increasing_id() + 2).alias("line"), F.concat(F.lit("DA:"), (F.col("l_linenumber") + 1).cast("string"), F.lit(","), F.col("l_quantity").cast("long").cast("string")).alias("value"))
    frame = li.select("l_orderkey").distinct().select(tag("r", "l_orderkey").alias("path"), F.explode(F.array(row(0, F.lit("TN:")), row(1, F.concat(tag("SF:o", "l_orderkey"), F.lit(".js"))), row(F.lit(1 << 60), F.lit("end_of_record")))).alias("x")).select("path", "x.line", "x.value")
    return formats.lcov(da.unionByName(frame))


@query("SELECT 'a/' || o_custkey AS old_file, 'a/' || o_custkey AS new_file, o_orderkey + 1 AS old_start, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_orderkey % 5 END AS old_count, o_orderkey + 2 AS new_start, o_orderkey % 4 AS new_count FROM orders")
def raw_diff_hunks(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    n = lambda c: c.cast("string")
    k = F.col("o_orderkey")
    old = F.concat(F.lit("@@ -"), n(k + 1), F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(","), n(k % 5))))
    hunk = o.select(tag("d", "o_custkey").alias("path"), (k + 1).alias("line"), F.concat(old, F.lit(" +"), n(k + 2), F.lit(","), n(k % 4), F.lit(" @@ f()")).alias("value"))
    head = o.select("o_custkey").distinct().select(tag("d", "o_custkey").alias("path"), F.lit(0).cast("long").alias("line"), F.concat(tag("diff --git a/a/", "o_custkey"), tag(" b/a/", "o_custkey")).alias("value"))
    return formats.raw_diff(hunk.unionByName(head))


@query("SELECT 'test/' || p_partkey AS selector, unnest(CASE WHEN p_size % 2 = 0 THEN ['REQ-' || p_size] ELSE ['REQ-' || p_size, 'DOC-' || p_partkey % 7] END) AS id FROM part WHERE p_partkey % 11 <> 0")
def requirement_map_rows(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    ids = F.concat(tag("REQ-", "p_size"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.concat(F.lit(" , DOC-"), (F.col("p_partkey") % 7).cast("string"))))
    value = F.when(F.col("p_partkey") % 22 == 0, "# a comment").when(F.col("p_partkey") % 11 == 0, "  ").otherwise(F.concat(tag("test/", "p_partkey"), F.lit("="), ids))
    return formats.requirement_map(p.select(F.lit("map").alias("path"), F.col("p_partkey").alias("line"), value.alias("value")))


@query("""
    SELECT 'pkg/' || user_id AS package, CASE WHEN bool_or(event_type = 'error') THEN 'fail' WHEN bool_or(event_type = 'click') THEN 'pass' ELSE 'skip' END AS outcome
    FROM events WHERE event_type IN ('error', 'click', 'view') GROUP BY user_id
""")
def test_outcomes(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    action = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "click", "pass").when(F.col("event_type") == "view", "skip").otherwise("output")
    line = F.to_json(F.struct(action.alias("Action"), tag("pkg/", "user_id").alias("Package"), tag("Test", "event_id").alias("Test")))
    return formats.test_events(e.select(F.lit("run").alias("path"), F.col("event_id").alias("line"), line.alias("value")))


@query("""
    SELECT 'u' || user_id AS path, CAST(event_id AS INTEGER) AS number, event_type || ' case' AS name, CASE WHEN event_id % 7 = 0 THEN 'skip' WHEN event_id % 11 = 0 THEN 'todo' WHEN event_type = 'error' THEN 'fail' ELSE 'pass' END AS verdict
    FROM events WHERE event_id % 13 <> 0
""")
def tap_results(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    k = F.col("event_id")
    note = F.when(k % 7 == 0, " # SKIP not here").when(k % 11 == 0, " # TODO later").otherwise("")
    line = F.concat(F.when(F.col("event_type") == "error", "not ok ").otherwise("ok "), k.cast("string"), F.lit(" - "), F.col("event_type"), F.lit(" case"), note)
    return formats.tap(e.select(tag("u", "user_id").alias("path"), k.alias("line"), F.when(k % 13 == 0, "# a remark").otherwise(line).alias("value")))


@query("""
    WITH l AS (SELECT l_orderkey, list(l_linenumber || '/' || l_partkey ORDER BY l_linenumber, l_partkey) AS p FROM lineitem GROUP BY l_orderkey)
    SELECT 'c' || o_orderkey AS "commit", 't' || o_custkey AS tree, o_orderpriority AS subject, array_to_string(coalesce(p, []), ',') AS paths FROM orders LEFT JOIN l ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'
""")
def history_records(spark, d):
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("p"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus").join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    names = F.transform("p", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit("/"), x["l_partkey"].cast("string")))
    head = F.concat_ws("\x1f", tag("c", "o_orderkey"), tag("t", "o_custkey"), F.col("o_orderpriority"), F.when(F.col("o_orderstatus") == "P", "tag: v1, grafted").otherwise("main"))
    raw = o.select(F.concat(head, F.coalesce(F.array_join(F.transform(names, lambda x: F.concat(F.lit("\0\n"), x)), ""), F.lit(""))).alias("value"), F.col("o_orderkey").alias("place"))
    return formats.history_rows(raw, None).select("commit", "tree", "subject", F.array_join("paths", ",").alias("paths"))


@query("""
    SELECT 'REQ-' || p_size AS id, 'f' || max(p_partkey) AS file, arg_max(p_name, p_partkey) AS title, 'yes' AS acceptance, arg_max(p_brand, p_partkey) AS "acceptedBy" FROM part WHERE p_partkey % 9 <> 0 GROUP BY p_size
""")
def index_last_rows(spark, d):
    p = table(spark, d, "part")
    row = F.concat_ws("\t", tag("REQ-", "p_size"), tag("f", "p_partkey"), F.col("p_name"), F.lit("yes"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_brand")))
    lines = p.select(F.lit("index").alias("path"), (F.col("p_partkey") + 2).cast("long").alias("line"), row.alias("value"))
    head = spark.createDataFrame([("index", 1, "id\tfile\ttitle\tacceptance\tacceptedBy")], "path string, line long, value string")
    return formats.index_rows(lines.unionByName(head))


@query("""
    WITH n AS (SELECT n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, n_regionkey FROM nation), s AS (SELECT s_suppkey, s_nationkey FROM supplier)
    SELECT 's' || s_suppkey AS path, n_name AS "commit", r_name AS evidence FROM s JOIN n ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def link_table_records(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    names = n.groupBy(F.col("n_regionkey").alias("g")).agg(F.array_sort(F.collect_list("n_name")).alias("commits"), F.array_distinct(F.collect_list("r_name")).alias("evidence"))
    placed = s.join(names, F.col("n_regionkey") == F.col("g")).select("g", "commits", "evidence", tag("s", "s_suppkey").alias("path"), (F.array_position("commits", F.col("n_name")) - 1).cast("int").alias("c"), (F.array_position("evidence", F.col("r_name")) - 1).cast("int").alias("e"))
    maps = placed.groupBy("g").agg(F.first("commits").alias("commits"), F.first("evidence").alias("evidence"), F.map_from_entries(F.collect_list(F.struct("path", F.array(F.struct(F.col("c").alias("commit"), F.col("e").alias("evidence")))))).alias("paths"))
    return formats.link_rows(maps.select(F.from_json(F.to_json(F.struct("commits", "evidence", "paths")), formats._LINKS).alias("x")).select("x.*"))


@query("""
    SELECT r_name AS record, 'n' || n_nationkey AS "from", 'r' || r_regionkey AS "to", 'in' AS type FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def external_relations(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    e = lambda i, k: F.struct(i.alias("id"), F.lit(k).alias("kind"))
    rel = F.struct(tag("n", "n_nationkey").alias("from"), tag("r", "r_regionkey").alias("to"), F.lit("in").alias("type"))
    raw = n.groupBy(F.col("r_name").alias("record")).agg(F.array_distinct(F.flatten(F.collect_list(F.array(e(tag("n", "n_nationkey"), "nation"), e(tag("r", "r_regionkey"), "region"))))).alias("entities"), F.collect_list(rel).alias("relations"))
    return formats.external_records(raw.select("record", F.to_json(F.struct("entities", "relations")).alias("value")), "value")[1]


@query("SELECT event_id, json_valid(CASE event_id % 4 WHEN 0 THEN props || '}' WHEN 1 THEN '[' || props || ']' ELSE props END) AS valid FROM events")
def structured_validity(spark, d):
    k = F.col("event_id") % 4
    e = table(spark, d, "events").select("event_id", F.when(k == 0, F.concat("props", F.lit("}"))).when(k == 1, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props")).alias("t"))
    return e.select("event_id", lexers.structured_problem("json")("t").isNull().alias("valid"))


@query("""SELECT p_partkey, '{"paths":{"/' || p_partkey || '":{"get":{"tags":["' || p_brand || '","x"],"deprecated":' || CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END || ',"size":' || p_size || ',"summary":"' || p_name || '"}}}}' AS json FROM part""")
def yaml_subset(spark, d):
    n = lambda c: F.col(c).cast("string")
    y = F.concat(F.lit("# spec\npaths:\n  /"), n("p_partkey"), F.lit(":\n    get:\n      tags:\n      - '"), F.col("p_brand"), F.lit("'\n      - x # second\n      deprecated: "), F.when(F.col("p_size") > 25, "true").otherwise("false"), F.lit("\n\n      size: "), n("p_size"), F.lit('\n      summary: "'), F.col("p_name"), F.lit('"\n'))
    return table(spark, d, "part").select("p_partkey", lexers.yaml_to_json(y).alias("json"))


@query("SELECT CAST(part_no AS BIGINT) AS k, 0 AS column, CAST(d AS INTEGER) AS source_line FROM (SELECT p_partkey AS part_no, p_size % 16 AS d FROM part)")
def source_map_positions(spark, d):
    # one segment, its source line as a single digit: value 2 * d in base64
    sign = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef"), F.lit(1) + (F.col("p_size") % 16) * 2, F.lit(1))
    two = F.concat(F.lit(";AA"), F.when(F.col("p_size") % 16 < 16, sign), F.lit("A"))
    got = table(spark, d, "part").select("p_partkey", F.get(exact.source_positions(two), F.lit(0)).alias("x"))
    return got.select(F.col("p_partkey").cast("long").alias("k"), F.col("x.column").alias("column"), F.col("x.source_line").alias("source_line"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def sqlite_round_trip(spark, d):
    return archives.from_sqlite(archives.to_sqlite(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c", "c_custkey"), "c", "c_custkey long, c_name string, c_mktsegment string")


@query("SELECT l_orderkey, array_to_string(list_sort(list(l_partkey)), ',') AS items FROM lineitem GROUP BY l_orderkey")
def sqlite_one_table(spark, d):
    dbs = archives.to_sqlite(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), "imports", "l_orderkey")
    got = archives.regroup(archives.from_sqlite(dbs, "imports", "l_orderkey long, l_partkey long"), "l_orderkey", "l_partkey")
    return got.select("l_orderkey", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 77")
def sqlite_one_path(spark, d):
    dbs = archives.to_sqlite(table(spark, d, "customer").select("c_custkey", "c_name"), "c", "c_custkey")
    return archives.from_sqlite(dbs, "c", "c_custkey long, c_name string", "c_custkey = ?", (77,))


@query("SELECT DISTINCT l_orderkey % 16 AS block, l_orderkey, l_partkey FROM lineitem")
def csr_round_trip(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") % 16).alias("block"), "l_orderkey", "l_partkey")
    return columnar.decode(columnar.encode(li, "block", "l_orderkey", "l_partkey"), "block", "l_orderkey", "l_partkey")


@query("SELECT lower(event_type) AS term, user_id AS source, count(*) AS tf FROM events GROUP BY 1, 2")
def term_table_view(spark, d):
    p = table(spark, d, "events").groupBy(F.lower("event_type").alias("term"), F.col("user_id").alias("source")).agg(F.count(F.lit(1)).alias("tf"))
    return columnar.view_terms(columnar.encode_terms(p.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(4))), "block"), "block")


@query("SELECT 'f' || l_suppkey AS file, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') AS tests FROM lineitem GROUP BY l_suppkey")
def tests_of_file(spark, d):
    li = table(spark, d, "lineitem")
    blocks = li.groupBy(tag("f", "l_suppkey").alias("file"), "l_partkey").agg(F.collect_set("l_linenumber").alias("tests"))
    order = li.select(F.col("l_linenumber").alias("test"), F.col("l_linenumber").alias("place")).distinct()
    return selection.tests_of_files(blocks, "file", "tests", order, "test")


@query("""
    WITH s AS (SELECT l_suppkey AS f, l_linenumber AS run, l_partkey AS pos, CAST(max(l_quantity) > 25 AS INTEGER) AS st FROM lineitem GROUP BY 1, 2, 3),
    w AS (SELECT *, lag(st) OVER (PARTITION BY f, run ORDER BY pos) AS was FROM s), c AS (SELECT DISTINCT f, pos FROM w WHERE was IS DISTINCT FROM st)
    SELECT f AS file, count(*) AS cuts, min(pos) AS first, max(pos) AS last FROM c GROUP BY f
""")
def state_cut_points(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("run"), F.col("l_partkey").alias("at")).agg((F.max("l_quantity") > 25).cast("int").alias("state"))
    return sequence.cut_points(s, ["file"], "run", "at", "state").groupBy("file").agg(F.count_distinct("start").alias("cuts"), F.min("start").alias("first"), F.max("start").alias("last"))


# --- predicates and projections


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN TRUE ELSE FALSE END AS matches FROM lineitem
""")
def selector_matches(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    path, name, k = tag("t/", "l_orderkey"), tag("n", "l_partkey"), F.col("l_partkey") % 4
    sel = F.when(k == 0, path).when(k == 1, F.concat(path, tag(":", "l_linenumber"))).when(k == 2, F.concat(path, F.lit("["), name, F.lit("]"))).otherwise(F.concat(path, F.lit("x")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", predicates.selector_matches(sel, path, F.col("l_linenumber"), name).alias("matches"))


@query("""
    SELECT event_id, value > 10 AND event_type IN ('click', 'view') AND event_id % 3 = 0 AS dropped, CASE WHEN event_id % 4 = 0 THEN 'add' WHEN event_id % 4 = 1 THEN 'delete' WHEN event_id % 4 = 2 THEN 'modify' END AS kind,
        CASE WHEN event_type = 'error' THEN FALSE ELSE TRUE END AS listing, CASE WHEN event_id % 5 = 0 THEN 'proposed' WHEN event_id % 7 = 0 THEN 'ignored' WHEN event_id % 11 = 0 THEN 'stale' WHEN event_id % 2 = 0 THEN 'proven' ELSE 'unproven' END AS entry
    FROM events
""")
def change_predicates(spark, d):
    k = F.col("event_id")
    e = table(spark, d, "events")
    write = F.when(F.col("event_type") == "click", "create").when(F.col("event_type") == "view", "replace").otherwise("append")
    none, file = F.lit("000000"), F.lit("100644")
    old, new = F.when(k % 4 == 0, none).when(k % 4 == 3, none).otherwise(file), F.when(k % 4 == 1, none).when(k % 4 == 3, none).otherwise(file)
    return e.select(
        "event_id", predicates.drop_read(F.col("value") > 10, write, k % 3 == 0).alias("dropped"), predicates.change_kind(old, new).alias("kind"),
        predicates.listing_can_change(F.when(F.col("event_type") == "error", "modified").otherwise("added")).alias("listing"),
        predicates.status_of_entry(k % 5 == 0, k % 7 == 0, k % 11 == 0, F.when(k % 2 == 0, F.lit(True))).alias("entry"),
    )


@query("""
    WITH p AS (SELECT page_id, regexp_replace(url, '^https?://|[?#].*$', '', 'g') AS u FROM pages), h AS (SELECT page_id, u, regexp_extract(u, '^[^/]+', 0) AS host FROM p)
    SELECT page_id, regexp_matches(u, '^[^/]+/en/[^/]*$') OR regexp_matches(u, '^.*/[0-9]+/?$') AND NOT regexp_matches(u, '^blog[.][^/]*/.*$') AS scoped,
        regexp_matches(u, '^[^/]+/(fr|en)/.+$') AS routed, page_id % 2 = 0 OR regexp_matches(u, '^[^/]*/en/[^/]*$') AS covered FROM h
""")
def path_scopes(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"^https?://|[?#].*$", "").alias("u"))
    scoped = predicates.in_scope(F.col("u"), ["*/en/*"], []) | (F.col("u").rlike("/[0-9]+/?$") & ~predicates.in_scope(F.col("u"), ["blog.*/**"], []))
    routed = F.col("u").rlike(text.glob("*/fr/**")) & ~F.col("u").endswith("/fr/") | F.col("u").rlike(text.glob("*/en/**")) & ~F.col("u").endswith("/en/")
    exact_ = predicates.entry_covers(F.when(F.col("page_id") % 2 == 0, F.col("u")), None, F.col("u"))
    covered = F.coalesce(exact_, F.lit(False)) | predicates.entry_covers(F.col("u"), "*/en/*", F.col("u"))
    return p.select("page_id", scoped.alias("scoped"), routed.alias("routed"), covered.alias("covered"))


@query("""
    SELECT p_partkey, p_size % 3 = 0 AS is_test, '/r/' || p_size || '/' || p_name || CASE p_size % 3 WHEN 0 THEN 'Tests.java' WHEN 1 THEN 'Testing.java' ELSE '' END AS absolute, CASE p_size % 3 WHEN 2 THEN 'test' ELSE 'test' END AS fine,
        'pkg/' || p_size || '/a.py' AS file, CASE WHEN p_size % 2 = 0 THEN 'file' ELSE 'package' END AS coarse, CASE WHEN p_size % 2 = 0 THEN 'pkg/' || p_size ELSE '.' END AS parent, p_size || '/x' AS below
    FROM part
""")
def path_projections(spark, d):
    k = F.col("p_size") % 3
    absolute = F.concat(tag("/r/", "p_size"), F.lit("/"), F.col("p_name"), F.when(k == 0, "Tests.java").when(k == 1, "Testing.java").otherwise(""))
    ident = F.concat(tag("pkg/", "p_size"), F.lit("/a.py::"), F.col("p_name"))
    even = F.col("p_size") % 2 == 0
    return table(spark, d, "part").select(
        "p_partkey", predicates.test_class_path(absolute).alias("is_test"), absolute.alias("absolute"), predicates.granularity(ident).alias("fine"), predicates.file_of(ident).alias("file"),
        predicates.granularity(F.when(even, predicates.file_of(ident)).otherwise(F.lit("pkg/plain"))).alias("coarse"),
        predicates.unit_parent(F.when(even, F.concat(F.lit("py:"), predicates.file_of(ident))).otherwise(F.lit("go:plain"))).alias("parent"),
        predicates.relative(F.lit("/r"), F.concat(tag("/r/", "p_size"), F.lit("/x"))).alias("below"),
    )


@query("""
    WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)
    SELECT doc_id, CASE WHEN len(list_filter(['the', 'and', 'of'], lambda x: list_contains(w, x))) >= 2 THEN 'agent-tooling' WHEN len(list_filter(['der', 'und', 'die'], lambda x: list_contains(w, x))) >= 2 THEN 'project-operations' ELSE 'repository' END AS intent FROM t
""")
def query_intents(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return table(spark, d, "documents").select("doc_id", predicates.query_intent(words, ["the", "and", "of"], ["der", "und", "die"]).alias("intent"))


@query(r"""
    SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: x LIKE '#%' OR contains(lower(x), 'status'))) AS lines, contains(lower(text), 'the') AS may_hold,
        array_to_string(regexp_extract_all(concat(text, ' ', upper(source), '-', doc_id, ', A1-B2-', doc_id % 7, 'x Z-', doc_id % 5, '; lower-', doc_id, ' -X-', doc_id, ' QQ-', lang, '-1'), '\b[A-Z][A-Z0-9]*(?:-[A-Z][A-Z0-9]*)*-[0-9]+\b'), ',') AS ids FROM documents
""")
def cheap_conditions(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda x: predicates.heading_or_status(x))
    may = text.holds_longest(F.col("text"), F.array(F.lit("of"), F.lit("the"), F.lit("and")))
    n = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    key = F.col("doc_id")
    named = F.concat(n(F.col("text")), F.lit(" "), n(F.upper("source")), F.lit("-"), n(key), F.lit(", A1-B2-"), n(key % 7), F.lit("x Z-"), n(key % 5), F.lit("; lower-"), n(key), F.lit(" -X-"), n(key), F.lit(" QQ-"), n(F.col("lang")), F.lit("-1"))
    return table(spark, d, "documents").select("doc_id", F.size(lines).cast("long").alias("lines"), may.alias("may_hold"), F.array_join(text.requirement_ids(named), ",").alias("ids"))


@query("""
    WITH d AS (SELECT p_name || '_' || p_brand AS name, count(DISTINCT p_type || p_size) AS n FROM part GROUP BY 1) SELECT name, n FROM d WHERE n <= 3 AND length(name) BETWEEN 4 AND 128
""")
def eligible_names(spark, d):
    p = table(spark, d, "part").select(F.concat("p_name", F.lit("_"), "p_brand").alias("name"), F.concat("p_type", F.col("p_size").cast("string")).alias("path"))
    few = p.groupBy("name").agg(F.count_distinct("path").alias("n"))
    return few.filter((F.col("n") <= 3) & F.length("name").between(4, 128))


@query("""
    SELECT DISTINCT lower(u.a) AS src, lower(u.b) AS dst, CAST(1 AS BIGINT) AS weight FROM (SELECT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) <= 50))
        UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) <= 50))) u
""")
def identifier_edges(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    name = F.concat(F.lit("partName"), F.col("l_partkey").cast("string"), F.lit("_X"))
    return graph.identifier_graph(li.select(name.alias("name"), tag("p", "l_partkey").alias("path")), li.select(name.alias("name"), tag("s", "l_suppkey").alias("path")))


@query("SELECT event_id FROM events WHERE event_type NOT IN ('click') AND user_id % 10 <> 3")
def ignored_paths(spark, d):
    from ..streaming import events as streams

    e = table(spark, d, "events").select("event_id", F.concat((F.col("user_id") % 10).cast("string"), F.lit("/"), F.col("event_type"), F.lit("/x.go")).alias("path"))
    ignored = spark.createDataFrame([("3/",), *[(f"{k}/click/",) for k in range(10)]], "entry string")
    return streams.relevant(e, ignored, "path").select("event_id")


@query("""
    SELECT l_orderkey, CASE WHEN min(l_linenumber) > 2 THEN NULL WHEN count(DISTINCT l_partkey) = 1 THEN 'declare p' || min(l_partkey) WHEN count(DISTINCT l_partkey) <= 3 THEN 'choose of ' || count(DISTINCT l_partkey) ELSE 'uncertain: many' END AS remedy FROM lineitem GROUP BY l_orderkey
""")
def unknown_remedies(spark, d):
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(tag("p", "l_partkey"))).alias("c"), F.min("l_linenumber").alias("m"))
    few = F.when(F.size("c") <= 3, F.col("c"))
    return o.select("l_orderkey", predicates.remedy(F.when(F.col("m") <= 2, F.lit("many")), few).alias("remedy"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN 'source' WHEN o_orderkey % 6 = 4 THEN 'kind' WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN 'timestamp' WHEN o_orderkey % 3 = 1 AND o_custkey % 2 = 0 THEN 'sha256' WHEN o_orderkey % 3 = 2 AND o_custkey % 2 = 0 THEN 'sequence' END AS problem,
        CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_custkey > 500 THEN 'stale' ELSE 'fresh' END WHEN o_orderkey % 3 = 1 THEN CASE WHEN o_custkey > 500 THEN 'stale' WHEN o_custkey = 500 THEN 'fresh' ELSE 'unknown' END ELSE CASE WHEN o_custkey > 500 THEN 'stale' ELSE 'fresh' END END AS state,
        CASE WHEN o_orderkey % 3 <> 2 AND o_custkey > 500 THEN o_custkey - 500 END AS lag FROM orders
""")
def as_of_points(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    bad = c % 2 == 0
    kind = F.when(k % 6 == 4, "other").when(k % 3 == 0, "timestamp").when(k % 3 == 1, "sha256").otherwise("sequence")
    value = F.when(k % 3 == 0, F.when(bad, "2024-13-01T00:00:00Z").otherwise("2024-02-29T10:00:00+01:00")).when(k % 3 == 1, F.when(bad, "AB").otherwise(F.sha2(c.cast("string"), 256))).otherwise(F.when(bad, "007").otherwise("18446744073709551615"))
    problem = predicates.as_of_problem(kind, value, F.when(k % 6 == 5, "").otherwise("db"))
    live_kind = F.when(k % 3 == 0, "timestamp").when(k % 3 == 1, "sequence").otherwise("sha256")
    stamp = lambda s: F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    pinned = F.when(k % 3 == 0, stamp(F.lit(500))).when(k % 3 == 1, "500").otherwise("same")
    live = F.when(k % 3 == 0, stamp(c)).when(k % 3 == 1, c.cast("string")).otherwise(F.when(c > 500, "other").otherwise("same"))
    state, lag = predicates.as_of_lag(live_kind, pinned, live)
    return table(spark, d, "orders").select("o_orderkey", problem.alias("problem"), state.alias("state"), lag.alias("lag"))


@query("""
    SELECT source, CASE WHEN n % 5 = 0 THEN 'ABSENT' WHEN n % 5 = 1 THEN 'COMPLETE' WHEN n % 5 = 2 THEN 'UNVERIFIED' WHEN n % 5 = 3 THEN 'STALE' WHEN m > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS state
    FROM (SELECT source, CAST(substr(source, 4) AS BIGINT) AS n, count(*) FILTER (WHERE lang = 'en') AS m FROM documents GROUP BY source)
""")
def inventory_states(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.count(F.when(F.col("lang") == "en", 1)).alias("m")).withColumn("n", F.expr("substring(source, 4)").cast("long") % 5)
    n = F.col("n")
    state = predicates.inventory_state(n != 0, F.when(n != 1, "receipt"), F.when(n == 3, "old").when(n == 4, "head"), F.lit("head"), F.col("m"))
    return g.select("source", state.alias("state"))


# --- text


@query(r"""
    SELECT p_partkey, regexp_replace(regexp_replace(s, '([a-z0-9])([A-Z])', '\1-\2', 'g'), '([A-Z])([A-Z][a-z])', '\1-\2', 'g') AS camel, array_to_string(regexp_extract_all(s, '[A-Za-z][A-Za-z0-9_-]*'), '|') AS ascii, regexp_replace(lower(s), '[^a-z0-9]', '', 'g') AS compact,
        array_to_string(list_transform(regexp_extract_all(regexp_replace(s, '([a-z])([A-Z])', '\1 \2', 'g'), '[A-Za-z0-9]+'), lambda x: lower(x)), '|') AS tokens
    FROM (SELECT p_partkey, replace(p_name, ' ', 'X') || '_' || upper(p_type) || 'List' || p_size || p_brand AS s FROM part)
""")
def name_forms(spark, d):
    s = F.concat(F.replace("p_name", F.lit(" "), F.lit("X")), F.lit("_"), F.upper("p_type"), F.lit("List"), F.col("p_size").cast("string"), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", text.camel_split(s).alias("camel"), F.array_join(text.ascii_words(s), "|").alias("ascii"), text.compact(s).alias("compact"), F.array_join(text.name_tokens(s), "|").alias("tokens"))


@query(r"""
    SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_concat(w, list_transform(w, lambda x: CASE WHEN length(x) > 5 AND x LIKE '%ies' THEN substr(x, 1, length(x) - 3) || 'y' WHEN length(x) > 4 AND x LIKE '%s' AND x NOT LIKE '%ss' THEN substr(x, 1, length(x) - 1) ELSE x END)), lambda x: length(x) >= 2))), '|') AS terms
    FROM (SELECT p_partkey, list_filter(string_split(lower(p_name || 's'), ' '), lambda x: length(x) >= 2) AS w FROM part)
""")
def query_term_sets(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(text.query_terms(F.concat("p_name", F.lit("s of the"))), "|").alias("terms"))


@query(r"""
    SELECT event_id, 'a%25b%3A' || user_id || '%0A' AS escaped, 'a%b:' || user_id || chr(10) AS back, 'i' || chr(775) || 'x' AS lowered, user_id || ' y' AS stripped, 'σ' || lower(event_type) || 'σk' AS folded, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS nullable, event_id % 4 <> 0 AS canonical FROM events
""")
def escapes_and_folds(spark, d):
    k = F.col("event_id")
    raw = F.concat(F.lit("a%b:"), F.col("user_id").cast("string"), F.lit("\n"))
    strip = F.concat(F.lit(" \x1c "), F.col("user_id").cast("string"), F.lit(" y　\x1f"))
    number = F.when(k % 4 == 0, F.concat(F.lit("0"), k.cast("string"))).otherwise(k.cast("string"))
    return table(spark, d, "events").select(
        "event_id", text.percent_escape(raw).alias("escaped"), text.percent_unescape(text.percent_escape(raw)).alias("back"), text.python_lower(F.lit("İX")).alias("lowered"), text.python_strip(strip).alias("stripped"),
        text.fold_key(F.concat(F.lit("Σ"), F.upper("event_type"), F.lit("ςK"))).alias("folded"), digest.empty_to_null(F.when(k % 3 == 0, "").otherwise(F.col("event_type"))).alias("nullable"), digest.canonical_sequence(number).alias("canonical"),
    )


@query("""
    SELECT doc_id, CASE WHEN strlen(text) <= 200 THEN text ELSE left(text, CAST(list_max(list_filter(range(1, 198), lambda n: strlen(left(text, CAST(n AS BIGINT))) <= 197)) AS BIGINT)) || '...' END AS line FROM documents
""")
def bounded_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", text.bounded_line(F.col("text")).alias("line"))


@query("""
    SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 3 WHEN p_size % 4 = 1 THEN 2 WHEN p_size % 4 = 2 THEN 4 ELSE 0 END AS line FROM part
""")
def definition_lines(spark, d):
    i, k = tag("REQ-A-", "p_partkey"), F.col("p_size") % 4
    doc = F.when(k == 0, F.concat(F.lit("see "), i, F.lit("\n\n- **"), i, F.lit(".** is this\n"), i, F.lit(": again"))).when(k == 1, F.concat(F.lit("some words\n"), i, F.lit(": wrapped"))).when(k == 2, F.concat(F.lit("# h\n\n| id | x |\n| `"), i, F.lit("` | y |"))).otherwise(F.lit("nothing\nhere"))
    return table(spark, d, "part").select("p_partkey", text.definition_line(doc, i).alias("line"))


@query("""
    SELECT p_partkey, 'a/' || p_partkey AS imports, '          ' || '/* ' || p_name || ' */' AS comments, 'x = "' || repeat(' ', length(p_name)) || '"; ' || '       ' AS code, '2,3' AS fenced, p_name || chr(65533) AS repaired FROM part
""")
def lexer_masks(spark, d):
    n = F.col("p_name")
    code = F.concat(F.lit('x = "'), n, F.lit('"; // note'))
    comment = F.concat(F.lit('y = "/*"; '), F.lit("/* "), n, F.lit(" */"))
    fenced = F.concat(F.lit("~~~~\n"), n, F.lit("\n~~~\n~~~~\nafter"))
    return table(spark, d, "part").select(
        "p_partkey", F.get(text.import_specifiers(F.concat(F.lit("import 'a/"), F.col("p_partkey").cast("string"), F.lit("'"))), F.lit(0)).alias("imports"),
        lexers.comment_mask("//", ("/*", "*/"))(comment).alias("comments"), lexers.web_code_mask(code).alias("code"),
        F.array_join(F.transform(lexers.fenced_lines(fenced), lambda x: x.cast("string")), ",").alias("fenced"), exact.repair_utf8(F.concat(n.cast("binary"), F.lit(b"\xff"))).alias("repaired"),
    )


# --- digests and measures


_PADS = ["".join(f"{(b ^ pad):02x}" for b in (b"k" * 16).ljust(64, b"\0")) for pad in (0x36, 0x5C)]


def _mac(message: str) -> str:
    """HMAC-SHA256 of a blob in SQL, as a blob."""
    return f"unhex(sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || {message}))))"


def _framed(parts: list[tuple[str, str]]) -> str:
    return " || ".join(f"unhex('{len(name):016x}') || encode('{name}') || unhex('{32:016x}') || {_mac(f'encode({value})')}" for name, value in parts)


@query(f"""
    SELECT event_id, sha256('event' || chr(0) || event_type) AS domain, sha1('blob ' || length(event_type) || chr(0) || event_type) AS blob, CASE WHEN value BETWEEN 0 AND 86400 THEN CAST(round(value * 1000) AS BIGINT) END AS ms, value < 0 OR value > 86400 AS invalid,
        lower(hex({_mac('(' + _framed([("A", "event_type"), ("B", "CASE WHEN event_id % 5 = 0 THEN '2' ELSE '1' END")]) + ')')})) AS environment FROM events
""")
def digests_and_durations(spark, d):
    e = table(spark, d, "events")
    ms, bad = digest.milliseconds(F.col("value"), 1000.0)
    hmac = exact.environment_digest(b"k" * 16)
    env = F.create_map(F.lit("B"), F.when(F.col("event_id") % 5 == 0, "2").otherwise("1"), F.lit("A"), F.col("event_type"))
    return e.select("event_id", digest.domain_hash("event", F.col("event_type")).alias("domain"), digest.blob_id(F.col("event_type")).alias("blob"), ms.alias("ms"), bad.alias("invalid"), hmac(env).alias("environment"))


@query("SELECT user_id, CAST(least(18446744073709551615, sum(CAST(event_id AS HUGEINT)) + CASE WHEN user_id % 2 = 0 THEN 18446744073709551615 ELSE 0 END) AS VARCHAR) AS total FROM events GROUP BY user_id")
def saturated_counts(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.sum("event_id").alias("n"))
    top = F.when(F.col("user_id") % 2 == 0, F.lit("18446744073709551615")).otherwise(F.lit("0")).cast("decimal(20,0)")
    return u.select("user_id", report.saturating(F.col("n"), top).cast("string").alias("total"))


@query("""
    SELECT user_id, day, CASE WHEN bool_or(value < 0) OR sum(ms) > 86400000 THEN CASE WHEN bool_or(value < 0) THEN 'INVALID' WHEN bool_or(ms IS NULL) THEN 'NOT_MEASURED' ELSE 'INVALID' END WHEN bool_or(ms IS NULL) THEN 'NOT_MEASURED' ELSE 'MEASURED' END AS state,
        CASE WHEN NOT bool_or(value < 0) AND NOT bool_or(ms IS NULL) AND sum(ms) <= 86400000 THEN CAST(sum(ms) AS BIGINT) END AS ms
    FROM (SELECT user_id, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, value, CASE WHEN event_type <> 'error' THEN CAST(trunc(value * 100) AS BIGINT) END AS ms FROM events) GROUP BY user_id, day
""")
def attempt_sums(spark, d):
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000)
    e = table(spark, d, "events").select("user_id", day.alias("day"), F.when(F.col("event_type") != "error", (F.col("value") * 100).cast("long")).alias("ms"), (F.col("value") < 0).alias("bad"))
    return selection.attempts(e, ["user_id", "day"], "ms", "bad")


# --- joins


@query("""
    WITH b AS (SELECT l_suppkey AS f, l_partkey AS open, l_partkey + 2 + CAST(l_quantity AS BIGINT) AS close FROM lineitem), q AS (SELECT DISTINCT l_suppkey AS f, l_partkey AS lo FROM lineitem),
    h AS (SELECT q.f, lo, open, close, row_number() OVER (PARTITION BY q.f, lo ORDER BY close - open, open DESC) AS k FROM q JOIN b ON q.f = b.f AND (lo % 2 = 0 AND open < lo AND lo < close OR lo % 2 = 1 AND open <= lo - 1 AND lo <= close))
    SELECT DISTINCT f, lo, open, close FROM h WHERE k = 1
""")
def innermost_bodies(spark, d):
    li = table(spark, d, "lineitem")
    bodies = li.select(F.col("l_suppkey").alias("f"), F.col("l_partkey").alias("open"), (F.col("l_partkey") + 2 + F.col("l_quantity").cast("long")).alias("close"))
    # an odd place is an insertion: its high end lies before its low one
    points = li.select(F.col("l_suppkey").alias("f"), F.col("l_partkey").alias("lo")).distinct().withColumn("hi", F.col("lo") - F.col("lo") % 2)
    return evidence.innermost(points, bodies, ["f"], "lo", "hi").select("f", "lo", "open", "close")


@query("""
    WITH c AS (SELECT DISTINCT l_orderkey AS body, l_linenumber AS line FROM lineitem WHERE l_discount > 0.05), t AS (SELECT DISTINCT l_orderkey AS body, l_linenumber AS line, l_suppkey AS test FROM lineitem WHERE l_tax < 0.04), a AS (SELECT DISTINCT l_orderkey AS body, l_suppkey AS test FROM lineitem),
    j AS (SELECT c.body, t.test FROM c LEFT JOIN t ON c.body = t.body AND c.line = t.line)
    SELECT body, test FROM j WHERE test IS NOT NULL UNION SELECT a.body, a.test FROM a JOIN j ON a.body = j.body AND j.test IS NULL
""")
def line_test_widening(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("body"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("test"), "l_discount", "l_tax")
    return evidence.line_tests(li.filter("l_discount > 0.05").select("body", "line").distinct(), li.filter("l_tax < 0.04").select("body", "line", "test").distinct(), li.select("body", "test").distinct(), "body", "line")


_HUNKS = """
    m AS (SELECT DISTINCT l_suppkey AS file, l_partkey AS open, l_partkey + 9 + l_orderkey % 32 AS close FROM lineitem), h AS (SELECT DISTINCT l_suppkey AS file, l_partkey AS hunk, l_partkey AS lo, l_partkey + l_partkey % 3 - 1 AS hi FROM lineitem),
    l AS (SELECT DISTINCT l_suppkey AS file, l_partkey AS line, 't' || l_orderkey % 50 AS test FROM lineitem WHERE l_quantity > 5),
    w AS (SELECT h.file, hunk, open, close, row_number() OVER (PARTITION BY h.file, hunk ORDER BY close - open, open DESC) AS k FROM h JOIN m ON h.file = m.file AND (open < lo AND hi < close OR hi < lo AND open <= hi AND lo <= close)),
    t AS (SELECT w.file, hunk, list_sort(list_distinct(list(test))) AS tests FROM w JOIN l ON l.file = w.file AND line > open AND line < close WHERE k = 1 GROUP BY w.file, hunk),
    r AS (SELECT h.file, h.hunk, CASE WHEN w.open IS NULL THEN 'outside a method' WHEN t.tests IS NULL THEN 'no executed line' ELSE 'selected' END AS state, coalesce(array_to_string(t.tests, ','), '') AS tests
        FROM h LEFT JOIN w ON w.file = h.file AND w.hunk = h.hunk AND w.k = 1 LEFT JOIN t ON t.file = h.file AND t.hunk = h.hunk)
"""


def _hunk_tests(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), "l_partkey", "l_orderkey", "l_quantity")
    methods = li.select("file", F.col("l_partkey").alias("open"), (F.col("l_partkey") + 9 + F.col("l_orderkey") % 32).alias("close"))
    hunks = li.select("file", F.col("l_partkey").alias("hunk"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_partkey") % 3 - 1).alias("end"))
    lines = li.filter("l_quantity > 5").select("file", F.col("l_partkey").alias("line"), F.concat(F.lit("t"), (F.col("l_orderkey") % 50).cast("string")).alias("test"))
    # the operator takes sets: rows that are alike meet there
    return selection.hunk_tests(hunks, methods, lines, "file")


@query(f"WITH {_HUNKS} SELECT * FROM r")
def hunk_methods(spark, d):
    return _hunk_tests(spark, d)


@query(f"""
    WITH {_HUNKS}, s AS (SELECT hunk % 7 AS change, CASE WHEN hunk % 7 < 3 THEN state ELSE 'selected' END AS state, tests FROM r),
    c AS (SELECT change, min(CASE WHEN state = 'outside a method' THEN state END) AS reason FROM s GROUP BY 1), u AS (SELECT DISTINCT change, unnest(string_split(tests, ',')) AS test FROM s),
    a AS (SELECT change, coalesce(string_agg(test, ',' ORDER BY test) FILTER (WHERE test <> ''), '') AS tests FROM u GROUP BY change)
    SELECT c.change, reason IS NOT NULL AS whole, reason, CASE WHEN reason IS NULL THEN sha256(tests) END AS tests FROM c JOIN a ON a.change = c.change
""")
def change_fallback(spark, d):
    change = F.col("hunk") % 7
    state = F.when((F.col("state") == "outside a method") & (change < 3), F.col("state")).otherwise("selected")
    rows = _hunk_tests(spark, d).select(change.alias("change"), state.alias("state"), "tests")
    return selection.with_fallback(rows, "state", "selected", "tests", ["change"]).withColumn("tests", F.sha2("tests", 256))


@query("SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'A' || p_size % 2 || ',B' || p_size END AS ids FROM part")
def selector_requirements(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("selector"), "p_size")
    chosen = p.filter("p_size <= 10").select("selector", "p_size").distinct()
    both = chosen.select("selector", F.explode(F.array(F.concat(F.lit("B"), "selector"), F.concat(F.lit("A"), (F.col("p_size") % 2).cast("string")))).alias("id"))
    return evidence.require_all(both, p, "selector").select("p_partkey", F.array_join("ids", ",").alias("ids"))


@query("""
    WITH b AS (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier WHERE s_suppkey % 5 <> 0), h AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 0.0 ELSE s_acctbal END AS v FROM supplier WHERE s_suppkey % 7 <> 0), u AS (SELECT l_suppkey AS k, min(l_partkey) AS first, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1)
    SELECT 'v' || coalesce(b.k, h.k) AS name, CAST(b.v AS VARCHAR) IS NULL AS added, CAST(h.v AS VARCHAR) IS NULL AS removed, coalesce(u.n, 0) AS dependents FROM b FULL OUTER JOIN h ON b.k = h.k LEFT JOIN u ON u.k = coalesce(b.k, h.k) WHERE b.v IS DISTINCT FROM h.v
""")
def environment_diff(spark, d):
    s = table(spark, d, "supplier").select(tag("v", "s_suppkey").alias("name"), "s_suppkey", "s_acctbal")
    base = s.filter("s_suppkey % 5 <> 0").select("name", F.col("s_acctbal").cast("string").alias("value"))
    head = s.filter("s_suppkey % 7 <> 0").select("name", F.when(F.col("s_suppkey") % 3 == 0, F.lit(0.0)).otherwise(F.col("s_acctbal")).cast("string").alias("value"))
    uses = table(spark, d, "lineitem").select(tag("v", "l_suppkey").alias("name"), tag("p", "l_partkey").alias("user")).distinct()
    got = evidence.environment_changes(base, head, uses)
    return got.select("name", F.col("before").isNull().alias("added"), F.col("after").isNull().alias("removed"), F.size("dependents").cast("long").alias("dependents"))


@query("""
    WITH l AS (SELECT 'f' || p_size || '::' || p_name AS id FROM part), a AS (SELECT DISTINCT CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE 'f' || s_suppkey || '::small ring' END AS id FROM supplier), c AS (SELECT id, count(*) AS n FROM l GROUP BY id)
    SELECT a.id, CASE WHEN a.id = '' THEN 'all' WHEN n = 1 THEN 'test' WHEN n > 1 THEN 'file' ELSE 'dangling' END AS selection, CASE WHEN a.id = '' THEN NULL WHEN n = 1 THEN a.id ELSE regexp_extract(a.id, '^[^:]*', 0) END AS target FROM a LEFT JOIN c ON a.id = c.id
""")
def resolved_ids(spark, d):
    listing = table(spark, d, "part").select(F.concat(tag("f", "p_size"), F.lit("::"), F.col("p_name")).alias("id"))
    asked = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 10 == 0, "").otherwise(F.concat(tag("f", "s_suppkey"), F.lit("::small ring"))).alias("id"))
    return evidence.resolve(asked, listing)


@query("SELECT o_orderkey, unnest(CASE WHEN o_custkey % 2 = 0 THEN ['m' || o_custkey] ELSE ['a' || o_orderkey % 3, 'b' || o_orderkey % 4] END) AS test FROM orders")
def attributed_records(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", F.array(F.concat(F.lit("a"), (k % 3).cast("string")), F.concat(F.lit("b"), (k % 4).cast("string"))).alias("tests"), F.when(F.col("o_custkey") % 2 == 0, tag("m", "o_custkey")).alias("marked"))
    return evidence.attribute(o, "tests", "marked")


@query("SELECT page_id, CASE WHEN url LIKE 'https://m.%' THEN '^https://m[.]' WHEN url LIKE 'https://%' THEN '^https://' WHEN contains(url, 'page=') THEN 'page=' END AS pattern FROM pages")
def first_globs(spark, d):
    patterns = spark.createDataFrame([(3, "page="), (1, "^https://m[.]"), (2, "^https://")], "place int, regex string")
    return evidence.first_pattern(table(spark, d, "pages").select("page_id", "url"), patterns, "url").select("page_id", "pattern")


@query("""
    WITH c AS (SELECT 'f' || s_suppkey AS file FROM supplier), b AS (SELECT 'f' || l_suppkey % 90 AS file, l_linenumber AS screen, l_orderkey % 4 AS test FROM lineitem)
    SELECT c.file, coalesce(array_to_string(list_sort(list_distinct(list('s' || screen) FILTER (WHERE screen IS NOT NULL))), ','), '') AS screens, coalesce(array_to_string(list_sort(list_distinct(list('t' || test) FILTER (WHERE test IS NOT NULL))), ','), '') AS tests FROM c LEFT JOIN b ON b.file = c.file GROUP BY c.file
""")
def observed_bindings(spark, d):
    b = table(spark, d, "lineitem").select(F.concat(F.lit("f"), (F.col("l_suppkey") % 90).cast("string")).alias("file"), tag("s", "l_linenumber").alias("screens"), F.concat(F.lit("t"), (F.col("l_orderkey") % 4).cast("string")).alias("tests"))
    got = selection.observed_bindings(table(spark, d, "supplier").select(tag("f", "s_suppkey").alias("file")), b, "file", ["screens", "tests"])
    return got.select("file", F.array_join("screens", ",").alias("screens"), F.array_join("tests", ",").alias("tests"))


@query("""
    WITH u AS (SELECT l_orderkey, l_linenumber, l_partkey AS doc_start, l_partkey + 30 AS doc_end FROM lineitem), e AS (SELECT o_orderkey, o_custkey AS s, o_custkey + 10 AS t FROM orders)
    SELECT o_orderkey, count(*) AS units, min(l_linenumber) AS first FROM e JOIN u ON l_orderkey = o_orderkey AND doc_start <= s AND t <= doc_end GROUP BY o_orderkey
""")
def docstring_containment(spark, d):
    u = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_partkey").alias("doc_start"), (F.col("l_partkey") + 30).alias("doc_end"))
    e = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("s"), (F.col("o_custkey") + 10).alias("t"))
    hit = joins.containing(e, u, ["o_orderkey"], "s", "t", "doc_start", "doc_end")
    return hit.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("units"), F.min("l_linenumber").alias("first"))


@query("""
    SELECT p_partkey, count(l_partkey) AS matches, CASE WHEN count(l_partkey) = 0 THEN 'missing' WHEN count(l_partkey) = 1 THEN 'associated' ELSE 'ambiguous' END AS state, CASE WHEN count(l_partkey) = 0 THEN 'NOT_MATCHED' WHEN count(l_partkey) > 1 THEN 'AMBIGUOUS' END AS abstained
    FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND CAST(l_quantity AS BIGINT) = p_size GROUP BY p_partkey
""")
def outcome_states(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("long").alias("p_size")).agg(F.count(F.lit(1)).alias("n"))
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("p_size")).join(n, ["p_partkey", "p_size"], "left").select("p_partkey", F.coalesce("n", F.lit(0).cast("long")).alias("matches"))
    state = joins.match_state(F.col("matches"))
    return p.select("p_partkey", "matches", state.alias("state"), F.when(state == "missing", "NOT_MATCHED").when(state == "ambiguous", "AMBIGUOUS").alias("abstained"))


@query("""
    WITH c AS (SELECT l_orderkey AS test, arg_min(l_suppkey, l_linenumber * 1000000 + l_suppkey) AS first FROM lineitem GROUP BY 1), f AS (SELECT * FROM c WHERE test % 3 = 0)
    SELECT a.test, a.first, count(*) AS others, min(b.test) AS least FROM f a JOIN f b ON a.first = b.first AND a.test <> b.test GROUP BY 1, 2
""")
def shared_first_edges(spark, d):
    chain = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("test")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("c"))
    chain = chain.select("test", F.transform("c", lambda x: x["l_suppkey"]).alias("edges"), (F.col("test") % 3 == 0).alias("flagged"))
    return selection.shared_first(chain, "test", "edges", "flagged")


@query("""
    WITH b AS (SELECT 'd' || p_size || '/' || p_partkey AS path, p_brand AS oid FROM part WHERE p_partkey % 8 <> 0), h AS (SELECT 'd' || p_size || '/' || p_partkey AS path, CASE WHEN p_partkey % 6 = 0 THEN 'x' ELSE p_brand END AS oid FROM part WHERE p_partkey % 9 <> 0)
    SELECT coalesce(b.path, h.path) AS path, CASE WHEN b.oid IS NULL THEN 'added' WHEN h.oid IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM b FULL OUTER JOIN h ON b.path = h.path WHERE b.oid IS DISTINCT FROM h.oid
""")
def tree_diff(spark, d):
    p = table(spark, d, "part").select(F.concat(tag("d", "p_size"), tag("/", "p_partkey")).alias("path"), "p_partkey", "p_brand", F.lit("100644").alias("mode"))
    base = p.filter("p_partkey % 8 <> 0").select("path", "mode", F.col("p_brand").alias("oid"))
    head = p.filter("p_partkey % 9 <> 0").select("path", "mode", F.when(F.col("p_partkey") % 6 == 0, "x").otherwise(F.col("p_brand")).alias("oid"))
    return joins.change_status(base, head, "path", "mode", "oid").filter("status <> 'unchanged'")


@query("""
    WITH c AS (SELECT 'd' || p_size % 5 || '/' || p_size || '/' || p_partkey AS path FROM part), w AS (SELECT unnest(['d1', 'd2/7', 'd3/8/8', 'd4/9/none']) AS under)
    SELECT under, count(*) AS changed FROM w JOIN c ON path = under OR starts_with(path, under || '/') GROUP BY under
""")
def changed_under(spark, d):
    path = F.concat(F.lit("d"), (F.col("p_size") % 5).cast("string"), tag("/", "p_size"), tag("/", "p_partkey"))
    asked = spark.createDataFrame([("d1",), ("d2/7",), ("d3/8/8",), ("d4/9/none",)], "under string")
    up = table(spark, d, "part").select(F.explode(joins.ancestors(path)).alias("under"))
    return up.join(asked, "under").groupBy("under").agg(F.count(F.lit(1)).alias("changed"))


@query("""
    WITH u AS (SELECT p_partkey AS package, CASE WHEN p_size = 7 THEN NULL ELSE p_brand || p_size END AS digest FROM part), r AS (SELECT l_partkey AS package, CASE WHEN l_linenumber = 7 THEN p_brand || p_size ELSE 'old' END AS recorded, l_orderkey AS record FROM lineitem JOIN part ON l_partkey = p_partkey WHERE (l_quantity - 1) * 0.002 > l_discount AND p_size % 4 > 0),
    j AS (SELECT u.package, u.digest, min(CASE WHEN recorded = digest THEN record END) AS witness, count(record) AS n FROM u LEFT JOIN r ON u.package = r.package GROUP BY 1, 2)
    SELECT package, CASE WHEN witness IS NOT NULL THEN 'REUSE' ELSE 'RUN' END AS decision, CASE WHEN witness IS NOT NULL THEN 'match' WHEN digest IS NULL THEN 'no digest' WHEN n > 0 THEN 'digest differs' ELSE 'no record' END AS reason, witness FROM j
""")
def record_reuse(spark, d):
    own = F.concat("p_brand", F.col("p_size").cast("string"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("package"), F.when(F.col("p_size") != 7, own).alias("digest"), own.alias("own"), "p_size")
    r = table(spark, d, "lineitem").select(F.col("l_partkey").alias("package"), "l_linenumber", F.col("l_orderkey").alias("record"), ((F.col("l_quantity") - 1) * 0.002 > F.col("l_discount")).alias("admitted")).join(p.select("package", "own", "p_size"), "package")
    records = r.select("package", F.when(F.col("l_linenumber") == 7, F.col("own")).otherwise("old").alias("digest"), "record", (F.col("admitted") & (F.col("p_size") % 4 > 0)).alias("admitted"))
    return selection.reuse(p.select("package", "digest"), records, ["package"], "digest")


@query("""
    WITH p AS (SELECT o_custkey AS key, count(*) AS planned FROM orders GROUP BY 1), s AS (SELECT o_custkey AS key, count(*) AS started FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY 1)
    SELECT coalesce(p.key, s.key) AS key, coalesce(planned, 0) AS planned, coalesce(started, 0) AS started FROM p FULL OUTER JOIN s ON p.key = s.key WHERE coalesce(planned, 0) <> coalesce(started, 0)
""")
def schedule_bijection(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey")
    return selection.bijection(o, o.filter("o_orderkey % 10 <> 0"), ["key"])


@query("""
    WITH w AS (SELECT c_custkey AS flow FROM customer), a AS (SELECT o_custkey AS flow, CASE WHEN o_orderkey % 50 = 0 THEN 'incomplete' WHEN o_orderkey % 51 = 0 THEN 'torn' END AS error, CASE WHEN o_orderkey % 7 = 0 THEN 'old' ELSE 'head' END AS c, CASE WHEN o_orderpriority LIKE '5%' THEN 'flaky' ELSE 'clean' END AS verdict FROM orders)
    SELECT flow, ['missing', 'invalid', 'incomplete', 'stale', 'failed', 'verified'][min(CASE WHEN c IS NULL THEN 1 WHEN error = 'incomplete' THEN 3 WHEN error IS NOT NULL THEN 2 WHEN c <> 'head' THEN 4 WHEN verdict <> 'clean' THEN 5 ELSE 6 END)] AS state FROM w LEFT JOIN a USING (flow) GROUP BY flow
""")
def stability_states(spark, d):
    k = F.col("o_orderkey")
    a = table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("flow"), F.when(k % 50 == 0, "incomplete").when(k % 51 == 0, "torn").alias("error"), F.when(k % 7 == 0, "old").otherwise("head").alias("commit"), F.when(F.col("o_orderpriority").startswith("5"), "flaky").otherwise("clean").alias("verdict"))
    return selection.stability(table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("flow")), a, ["flow"], "head")


@query("""
    SELECT l_orderkey AS flow, l_partkey AS test, CASE WHEN l_orderkey % 4 = 0 THEN 'dangling' WHEN l_partkey % 5 = 0 THEN 'unknown' WHEN l_linenumber > 4 THEN 'stale' ELSE 'current' END AS state FROM lineitem
""")
def link_states(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("flow"), F.col("l_partkey").alias("test"), F.when(F.col("l_linenumber") > 4, "old").otherwise("now").alias("digest"))
    flows = li.select("flow").distinct().filter("flow % 4 <> 0").withColumn("digest", F.lit("now"))
    return selection.link_states(li, flows, table(spark, d, "part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("test")), "flow", "test", "digest")


# --- folds


@query("""
    SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R' AND l_linenumber = 1) THEN 'survived' WHEN bool_or(l_tax > 0.07) THEN 'not measured' WHEN bool_and(l_returnflag <> 'N') THEN 'killed' ELSE 'incomplete' END AS strength FROM lineitem GROUP BY l_orderkey
""")
def step_strength(spark, d):
    outcome = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), "survived").when(F.col("l_returnflag") != "N", "killed")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(evidence.strength(outcome, F.col("l_tax") > 0.07).alias("strength"))


@query("""
    WITH f AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'invalid' WHEN 'view' THEN 'abstained' ELSE 'valid' END AS state, 'r' || event_id AS reason, 'a' || event_id % 3 AS anchor FROM events)
    SELECT user_id, CASE WHEN bool_or(state = 'invalid') THEN 'invalid' WHEN bool_or(state = 'abstained') THEN 'abstained' ELSE 'valid' END AS state,
        coalesce(arg_min(reason, event_id) FILTER (WHERE state = 'invalid'), arg_min(reason, event_id) FILTER (WHERE state = 'abstained')) AS reason, len(list_distinct(list(anchor))) AS anchors FROM f GROUP BY user_id
""")
def hygiene_fold(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "invalid").when(F.col("event_type") == "view", "abstained").otherwise("valid").alias("state"), tag("r", "event_id").alias("reason"), F.concat(F.lit("a"), (F.col("event_id") % 3).cast("string")).alias("anchor"))
    return evidence.hygiene(e, "user_id", "event_id").withColumn("anchors", F.size("anchors").cast("long"))


@query("SELECT l_orderkey, CAST(greatest(max(l_linenumber), min(l_suppkey)) AS BIGINT) AS a, CAST(max(l_suppkey) AS BIGINT) AS b, bool_or(l_quantity > 40) AS ran FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_linenumber < 7) > 0")
def merged_units(spark, d):
    li = table(spark, d, "lineitem")
    one = li.groupBy("l_orderkey").agg(F.array(F.max(F.col("l_linenumber").cast("long"))).alias("x"), F.array(F.min("l_suppkey"), F.max("l_suppkey")).alias("y"))
    units = li.select("l_orderkey", (F.col("l_quantity") > 40).alias("ran"), F.lit(False).alias("blank"))
    blank = li.filter("l_linenumber < 7").select("l_orderkey").distinct()
    merged = one.select("l_orderkey", evidence.merge_max(F.col("x"), F.col("y")).alias("m")).join(evidence.line_states(units, ["l_orderkey"]), "l_orderkey").join(blank, "l_orderkey", "left_semi")
    return merged.select("l_orderkey", F.get("m", F.lit(0)).alias("a"), F.get("m", F.lit(1)).alias("b"), "ran")


@query("""
    SELECT lang, CAST(sum(n_chars) AS BIGINT) AS records_in, CAST(sum(CASE WHEN source < 'src2' THEN n_chars ELSE 0 END) AS BIGINT) AS admitted, count(*) FILTER (WHERE source LIKE 'src1%') AS high, count(*) FILTER (WHERE source NOT LIKE 'src1%') AS low FROM documents GROUP BY lang
""")
def shard_sums(spark, d):
    shards = table(spark, d, "documents").groupBy("lang", "source").agg(F.sum("n_chars").alias("n"), F.count(F.lit(1)).alias("k"))
    shards = shards.withColumn("severity", F.create_map(F.when(F.col("source").startswith("src1"), "high").otherwise("low"), F.col("k")))
    sums = shards.groupBy("lang").agg(F.sum("n").alias("records_in"), F.sum(F.when(F.col("source") < "src2", F.col("n")).otherwise(0)).alias("admitted"))
    kinds = shards.select("lang", F.explode("severity").alias("s", "k")).groupBy("lang").agg(F.sum(F.when(F.col("s") == "high", F.col("k")).otherwise(0)).alias("high"), F.sum(F.when(F.col("s") == "low", F.col("k")).otherwise(0)).alias("low"))
    return sums.join(kinds, "lang")


@query("SELECT source, CASE WHEN bool_or(lang = 'de') THEN 'stale' WHEN bool_or(lang = 'fr') THEN 'unknown' ELSE 'fresh' END AS state FROM documents GROUP BY source")
def worst_input(spark, d):
    state = F.when(F.col("lang") == "de", "stale").when(F.col("lang") == "fr", "unknown").otherwise("fresh")
    return table(spark, d, "documents").select("source", state.alias("s")).groupBy("source").agg(report.worst_of(F.col("s"), {"fresh": 0, "unknown": 1, "stale": 2}).alias("state"))


@query("""
    WITH p AS (SELECT DISTINCT l_returnflag AS path, l_suppkey AS unit, l_suppkey % 2 = 0 AS o FROM lineitem), s AS (SELECT unit FROM p GROUP BY unit HAVING count(DISTINCT path) = (SELECT count(DISTINCT path) FROM p) AND bool_or(o))
    SELECT path, unit, 'addition' AS place FROM p WHERE unit NOT IN (SELECT unit FROM s) UNION ALL SELECT NULL, unit, 'shared' FROM s
""")
def path_concerns(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("path"), F.col("l_suppkey").alias("unit"), (F.col("l_suppkey") % 2 == 0).alias("open"))
    return selection.path_concern(p, "path", "unit", "open")


# --- sequences


@query("""
    WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(min(event_id) % 7 AS BIGINT) AS n FROM events GROUP BY 1, 2), m AS (SELECT *, min(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM d),
    s AS (SELECT *, best IS NOT NULL AND n >= best AS stale FROM m), e AS (SELECT *, n = 0 OR stale AND coalesce(lag(stale) OVER (PARTITION BY user_id ORDER BY day), FALSE) AS ends FROM s)
    SELECT user_id, min(CASE WHEN ends THEN day END) AS stop FROM e GROUP BY user_id
""")
def repair_stop(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg((F.min("event_id") % 7).alias("n"))
    return sequence.new_minimum_stop(e, ["user_id"], "day", "n")


@query("SELECT c_custkey, row_number() OVER (ORDER BY length(c_name), c_name, c_custkey) AS rank FROM customer")
def specificity_order(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return sequence.numbered(c, F.length("c_name"), [F.col("c_name"), F.col("c_custkey")], "rank").select("c_custkey", "rank")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 4")
def rank_disclosure(spark, d):
    from pyspark.sql.window import Window

    order = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", order.cast("long").alias("rank")).filter("rank <= 4")


@query("""
    WITH r AS (SELECT c_mktsegment, c_custkey, sum(length(c_name)) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey, c_custkey) AS upto FROM customer) SELECT c_mktsegment, c_custkey FROM r WHERE upto <= 900
""")
def tail_budget(spark, d):
    c = table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_nationkey", F.length("c_name").alias("b"))
    return sequence.tail_budget(c, ["c_mktsegment"], "c_nationkey", "c_custkey", "b", 900).select("c_mktsegment", "c_custkey")


@query("""
    WITH f AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS r FROM documents), s AS (SELECT n, (SELECT sum(n_chars) FROM f WHERE r <= n) AS b FROM (SELECT unnest([64, 32, 16, 8, 4, 2, 1]) AS n)) SELECT doc_id FROM f WHERE r <= coalesce((SELECT max(n) FROM s WHERE b <= 20000), 0)
""")
def halved_page(spark, d):
    return sequence.halved_page(table(spark, d, "documents").select("doc_id", "n_chars"), [F.col("doc_id")], F.col("n_chars"), 64, 20000).select("doc_id")


@query("SELECT l_suppkey, arg_max(l_partkey, l_orderkey * 100 + l_linenumber * 10 + 0.000001 * l_partkey) AS last FROM lineitem GROUP BY l_suppkey")
def last_row_per_id(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10).alias("place"))
    return sequence.latest(li, ["l_suppkey"], ["place", "l_partkey"]).select("l_suppkey", F.col("l_partkey").alias("last"))


@query("""SELECT DISTINCT '{"brand":"' || p_brand || '","size":' || p_size || '}' AS form FROM part""")
def canonical_set(spark, d):
    return table(spark, d, "part").select(exact.canonical_json(F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand")))).alias("form")).dropDuplicates(["form"])


@query("SELECT DISTINCT CAST(o_custkey AS BIGINT) AS k FROM orders UNION SELECT DISTINCT CAST(c_custkey AS BIGINT) FROM customer")
def union_of_keys(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("k")).unionByName(table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("k"))).distinct()


# --- graphs


@query("""
    WITH p AS (SELECT page_id, regexp_replace(url, '^https?://|[?#].*$', '', 'g') AS u FROM pages), h AS (SELECT DISTINCT regexp_extract(u, '^[^/]+', 0) AS root FROM p WHERE page_id % 3 = 0)
    SELECT page_id, root AS package FROM p LEFT JOIN h ON starts_with(u, root || '/')
""")
def nearest_packages(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"^https?://|[?#].*$", "").alias("u"))
    roots = p.filter("page_id % 3 = 0").select(F.substring_index("u", "/", 1).alias("package"))
    best = evidence.nearest_package(p.select("u").distinct(), roots, "u")
    return p.join(best, "u").select("page_id", "package")


@query("SELECT l_partkey AS block, array_to_string(list_sort(list_distinct(list(l_orderkey))), ',') AS tests FROM lineitem GROUP BY l_partkey")
def reverse_map(spark, d):
    by_test = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("blocks"))
    back = by_test.select("l_orderkey", F.explode("blocks").alias("block")).groupBy("block").agg(F.array_sort(F.collect_list("l_orderkey")).alias("t"))
    return back.select("block", F.array_join(F.col("t").cast("array<string>"), ",").alias("tests"))


@query("SELECT p_name AS term, dense_rank() OVER (ORDER BY p_name) - 1 AS id FROM (SELECT DISTINCT p_name FROM part)")
def dictionary_ids(spark, d):
    return evidence.dictionary(table(spark, d, "part").select(F.col("p_name").alias("term")), "term")


@query("""
    WITH RECURSIVE p AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 AND c_custkey % 20 = 1 THEN c_custkey + 1 ELSE c_custkey - 1 END AS parent FROM customer),
    w AS (SELECT node, parent AS pos, [node] AS chain, CASE WHEN parent IS NULL THEN 'root' ELSE 'open' END AS state, 0 AS n FROM p
        UNION ALL SELECT w.node, CASE WHEN list_contains(chain, w.pos) THEN w.pos ELSE p.parent END, CASE WHEN list_contains(chain, w.pos) THEN chain ELSE list_append(chain, w.pos) END, CASE WHEN list_contains(chain, w.pos) THEN 'cycle' WHEN p.parent IS NULL THEN 'root' ELSE 'open' END, n + 1 FROM w LEFT JOIN p ON p.node = w.pos WHERE state = 'open' AND n < 16)
    SELECT node, len(chain) AS steps, CASE WHEN state = 'open' THEN 'too deep' ELSE state END AS state FROM w WHERE state <> 'open' OR n = 16
""")
def lineage_walk(spark, d):
    k = F.col("c_custkey").cast("long")
    parents = table(spark, d, "customer").select(k.alias("node"), F.when(k % 10 == 0, None).when(k % 20 == 1, k + 1).otherwise(k - 1).alias("parent"))
    return evidence.lineage(parents, "node", "parent").select("node", F.size("chain").cast("long").alias("steps"), "state")


_CLOSURE = """
    code AS (SELECT DISTINCT l_suppkey AS src, (l_suppkey * 7 + l_partkey) % 100 AS dst FROM lineitem ), tests AS (SELECT DISTINCT l_suppkey AS src, 1000 + l_partkey % 50 AS dst FROM lineitem WHERE l_linenumber = 2),
    seeds AS (SELECT s_suppkey AS seed FROM supplier),
    c AS (SELECT seed, seed AS node FROM seeds UNION SELECT c.seed, code.dst FROM c JOIN code ON code.src = c.node)
"""


def _closure(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber")
    code = li.select(F.col("l_suppkey").alias("src"), ((F.col("l_suppkey") * 7 + F.col("l_partkey")) % 100).alias("dst")).distinct()
    tests = li.filter("l_linenumber = 2").select(F.col("l_suppkey").alias("src"), (F.lit(1000) + F.col("l_partkey") % 50).alias("dst")).distinct()
    seeds = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))
    return code, tests, seeds


@query(f"""
    WITH RECURSIVE {_CLOSURE} SELECT seed, count(*) AS units, min(node) AS least, max(node) AS most FROM (SELECT seed, node FROM c WHERE seed <> node UNION SELECT c.seed, tests.dst FROM c JOIN tests ON tests.src = c.node) GROUP BY seed
""")
def closure_one_level(spark, d):
    code, tests, seeds = _closure(spark, d)
    return selection.closure_and_one(code, tests, seeds).groupBy("seed").agg(F.count(F.lit(1)).alias("units"), F.min("node").alias("least"), F.max("node").alias("most"))


@query("""
    WITH c AS (SELECT l_orderkey AS o, list(l_suppkey % 3 ORDER BY l_linenumber, l_suppkey) AS c FROM lineitem GROUP BY 1)
    SELECT a.o, len(a.c) >= 2 AND len(b.c) >= 2 AND a.c[1:2] = b.c[1:2] AS same FROM c a JOIN c b ON b.o = a.o + 1
""")
def chain_prefixes(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"] % 3).alias("c"))
    nxt = c.select((F.col("o") - 1).alias("o"), F.col("c").alias("b"))
    return c.join(nxt, "o").select("o", selection.same_prefix(F.col("c"), F.col("b"), F.lit(2)).alias("same"))


# In the SQL, last lines that read 'end' are a common suffix of both texts. If the second line repeats the first one or the line put for it, the
# shortest edit that deletes last keeps the repeats and drops or puts one after them: a hunk more, if another line stands behind. Where 'end' and
# the new line take turns, the last line goes instead.
@query("""
    WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l, 'new ' || doc_id AS w FROM documents WHERE text IS NOT NULL),
    e AS (SELECT *, substr(text, length(l[1]) + 1) AS rest, list_position(l, l[1] || '?') AS other FROM d), r AS (SELECT *, regexp_replace(rest, '(\\nend)+$', '') AS body FROM e)
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN l[2] = l[1] THEN 'live' ELSE 'moved' END WHEN 1 THEN CASE WHEN other > 0 THEN 'moved' ELSE 'changed' END WHEN 2 THEN 'gone' ELSE 'live' END AS state,
        CASE WHEN doc_id % 4 = 0 AND l[2] IS DISTINCT FROM l[1] THEN 1 WHEN doc_id % 4 = 1 AND other > 0 THEN other END AS moved_to,
        CASE WHEN doc_id % 3 = 0 THEN w || rest ELSE text END || chr(10) || 'end' AS patched,
        CASE WHEN doc_id % 3 = 0 AND text <> '' AND l[1] <> w AND body <> '' THEN
            CASE WHEN l[2] IN (l[1], w) AND len(list_distinct(string_split(body, chr(10))[2:])) > 1 AND replace(l[1] || body || chr(10), 'end' || chr(10) || w || chr(10), '') <> '' THEN 3 ELSE 2 END
        ELSE 1 END AS hunks
    FROM r
""")
def patch_and_relocate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text").filter("text is not null")
    lines, key = F.split("text", "\n"), F.col("doc_id")
    first = F.get(lines, F.lit(0))
    head = F.when(key % 3 == 0, F.concat(F.lit("new "), key.cast("string"))).otherwise(first)
    hunk = F.array(F.struct(F.lit(1).alias("start"), F.array(first).alias("gone"), F.array(head).alias("new")), F.struct((F.size(lines) + 1).alias("start"), F.array().cast("array<string>").alias("gone"), F.array(F.lit("end")).alias("new"))).cast(exact.HUNKS)
    out = docs.select("doc_id", "text", exact.apply_hunks("text", hunk).alias("patched"))
    out = out.withColumn("hunks", F.size(diff.line_diff(F.col("text"), F.col("patched"))))
    # the first line, looked for in its place, one line too low, under another digest, and in a file that is not there
    # (an id that stands twice, or is null, has a file for each of its texts)
    kind, path = key % 4, F.concat_ws("/", key.cast("string"), F.sha2("text", 256))
    digest_ = F.when(kind == 1, F.sha2(F.concat(first, F.lit("?")), 256)).otherwise(F.sha2(first, 256))
    anchors = out.select(F.struct("doc_id", "patched", "hunks").alias("id"), F.when(kind == 2, F.concat(F.lit("no/"), path)).otherwise(path).alias("path"), F.when(kind == 0, 2).otherwise(1).alias("line"), F.lit(1).alias("width"), digest_.alias("digest"))
    at = evidence.relocate(anchors, docs.select(path.alias("path"), "text").dropDuplicates(["path"]))
    return at.select("id.doc_id", "state", "moved_to", "id.patched", "id.hunks")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def freshness_memo(spark, d):
    from ..streaming import events as streams

    return streams.latest_state(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


@query("SELECT l_suppkey AS file, min(l_partkey) AS start, max(l_partkey) + 1 AS \"end\", count(*) AS members FROM lineitem GROUP BY l_suppkey HAVING max(l_partkey) - min(l_partkey) < 0 UNION ALL SELECT s_suppkey, 0, 10, 1 FROM supplier")
def single_islands(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("file"), F.lit(0).cast("long").alias("start"), F.lit(10).cast("long").alias("end"))
    return intervals.union(s, ["file"], "start", "end")


# --- ranking


@query("""
    WITH f AS (SELECT doc_id, 0 AS f, 1.0 AS w, 0.3 AS b, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents UNION ALL SELECT doc_id, 1, 2.0, 0.0, [source] FROM documents UNION ALL SELECT doc_id, 2, 0.5, 0.0, [lang] FROM documents),
    s AS (SELECT f, count(*) AS n, avg(len(t)) AS mean FROM f GROUP BY f), tf AS (SELECT doc_id, f.f, w, b, len(t) AS length, u.term, count(*) AS tf FROM f, unnest(t) AS u(term) WHERE u.term IN ('that', 'with', 'und', 'src3', 'fr') GROUP BY ALL),
    g AS (SELECT f, term, count(*) AS df FROM tf GROUP BY f, term)
    SELECT doc_id, round(sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - b + b * length / mean))), 6) AS score, count(DISTINCT tf.term) AS terms
    FROM tf JOIN g ON g.f = tf.f AND g.term = tf.term JOIN s ON s.f = tf.f GROUP BY doc_id ORDER BY score DESC, terms DESC, doc_id LIMIT 20
""")
def bm25_three_fields(spark, d):
    docs = table(spark, d, "documents")
    body = docs.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("terms"))
    one = lambda c: docs.select("doc_id", F.array(c).alias("terms"))
    return search.bm25_fields([body, one("source"), one("lang")], "doc_id", ["that", "with", "und", "src3", "fr"], [1.0, 2.0, 0.5], [0.3, 0.0, 0.0])


@query("""
    SELECT o_orderkey, round(o_totalprice * (1 + 0.25 * pow(0.5, date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') / 90.0) + CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE 0.25 * pow(0.5, (o_custkey % 300) / 90.0) END), 4) AS score FROM orders
""")
def decayed_scores(spark, d):
    age = F.date_diff(F.lit("2002-01-01").cast("date"), F.to_date("o_orderdate"))
    blame = F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 300)
    return table(spark, d, "orders").select("o_orderkey", F.round(search.decayed(F.col("o_totalprice"), age, blame), 4).alias("score"))


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_size % 5 DESC, p_size DESC) AS tier FROM part")
def coverage_tiers(spark, d):
    return search.tiers(table(spark, d, "part").select("p_partkey", (F.col("p_size") % 5).alias("held"), "p_size"), "held", "p_size").select("p_partkey", F.col("tier").cast("long").alias("tier"))


@query("SELECT p_partkey, lower(p_name) = 'red widget' AS exact FROM part ORDER BY lower(p_name) = 'red widget' DESC, length(p_name), p_partkey LIMIT 30")
def exact_name_first(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name").orderBy(search.exact_first(F.col("p_name"), "Red Widget"), F.length("p_name"), "p_partkey").limit(30)
    return p.select("p_partkey", (F.lower("p_name") == "red widget").alias("exact"))


@query("""
    WITH m AS (SELECT p_brand AS family, max(p_size) + 1 AS possible FROM part GROUP BY 1) SELECT p_brand AS family, p_partkey, round(p_size / CAST(possible AS DOUBLE), 9) AS share FROM part JOIN m ON p_brand = family ORDER BY share DESC, family, p_partkey LIMIT 40
""")
def family_merge(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("family"), "p_partkey", "p_size")
    possible = p.groupBy("family").agg((F.max("p_size") + 1).alias("possible"))
    return search.merged_families(p, possible, "family", "p_partkey", "p_size", 40).select("family", "p_partkey", "share")


@query("SELECT item_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) <= 12 AS name FROM benchmark")
def prose_threshold(spark, d):
    return table(spark, d, "benchmark").select("item_id", search.weighs_as_name(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("name"))


@query("""
    WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber * 1000000 + l_partkey) AS k FROM lineitem)
    SELECT l_orderkey, l_linenumber * 1000000 + l_partkey AS item, CASE WHEN k > 12 THEN 'not judged' WHEN a < 100 THEN 'insufficient' WHEN a - l_quantity < 100 THEN 'necessary' ELSE 'redundant' END AS label FROM r
""")
def necessity_labels(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey")).alias("item"), "l_quantity")
    return search.necessity(li, "l_orderkey", "item", "l_quantity", 100.0)


@query("""
    WITH s AS (SELECT DISTINCT l_suppkey AS anchor, l_partkey AS test, 4 AS w, 'name' AS s FROM lineitem WHERE l_linenumber = 1 UNION SELECT l_suppkey, l_partkey, 3, 'path' FROM lineitem WHERE l_linenumber = 2 UNION SELECT l_suppkey, l_partkey, 2, 'change' FROM lineitem WHERE l_linenumber = 3 UNION SELECT l_suppkey, l_partkey, 1, 'import' FROM lineitem WHERE l_linenumber > 3),
    g AS (SELECT anchor, test, CAST(sum(w) AS BIGINT) AS weight, string_agg(s, '+' ORDER BY s) AS signals FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY weight DESC, length(signals) DESC, test) AS k FROM g)
    SELECT anchor, test, weight, signals FROM r WHERE k = 1
""")
def test_links(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("anchor"), F.col("l_partkey").alias("test"), "l_linenumber")
    by = [li.filter(c) for c in ("l_linenumber = 1", "l_linenumber = 2", "l_linenumber = 3", "l_linenumber > 3")]
    return search.test_code_links(li.select("anchor").distinct(), *by)


@query("""
    WITH s AS (SELECT l_orderkey AS packet, l_linenumber * 100000 + l_partkey AS place, l_suppkey % 3 AS file, CASE WHEN l_linenumber > 5 THEN 'call' ELSE 'core' END AS kind, least(80, CAST(l_quantity AS BIGINT) * 3) AS lines, (l_linenumber - 5) * 100000 + l_partkey AS o FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2, 3)),
    f AS (SELECT *, row_number() OVER (PARTITION BY packet, file ORDER BY place) AS k FROM s WHERE kind = 'core'), c AS (SELECT *, row_number() OVER (PARTITION BY packet ORDER BY place) AS n FROM f WHERE k <= 3),
    t AS (SELECT s.*, row_number() OVER (PARTITION BY s.packet, s.o ORDER BY s.place) AS n FROM s WHERE kind = 'call' AND EXISTS (SELECT 1 FROM c WHERE c.packet = s.packet AND c.place = s.o AND c.n <= 8)),
    b AS (SELECT packet, place, kind, lines FROM c WHERE n <= 8 UNION ALL SELECT packet, place, kind, lines FROM t WHERE n <= 2), u AS (SELECT *, sum(lines) OVER (PARTITION BY packet ORDER BY kind <> 'core', place) AS upto FROM b)
    SELECT packet, place, kind, lines FROM u WHERE upto <= 240
""")
def span_budget(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min("l_suppkey").alias("s"), F.min("l_quantity").alias("q"))
    n = F.col("l_linenumber").cast("long")
    spans = li.select(F.col("l_orderkey").alias("packet"), (n * 100000 + F.col("l_partkey")).alias("place"), (F.col("s") % 3).alias("file"), F.when(n > 5, "call").otherwise("core").alias("kind"), ((n - 5) * 100000 + F.col("l_partkey")).alias("of"), (F.col("q").cast("long") * 3).alias("lines"))
    return search.span_rows(spans, "packet").select("packet", "place", "kind", "lines")


@query("""
    WITH RECURSIVE e AS (SELECT src, dst, count(*) AS weight FROM (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem) GROUP BY 1, 2),
    o AS (SELECT src, sum(weight) AS out FROM e GROUP BY src), p AS (SELECT e.src, e.dst, CAST(weight AS DOUBLE) / out AS p FROM e JOIN o ON o.src = e.src),
    t AS (SELECT 0 AS round, 's1' AS node, CAST(0 AS DOUBLE) AS rank, CAST(1 AS DOUBLE) AS r
        UNION ALL SELECT round + 1, node, sum(rank), sum(r) FROM (
            SELECT round, x.node, rank, r FROM (SELECT round, unnest([{'node': t.node, 'rank': t.rank + CASE WHEN t.r >= 0.00001 THEN 0.15 * t.r ELSE 0 END, 'r': CASE WHEN t.r >= 0.00001 THEN 0 ELSE t.r END}]
                || CASE WHEN t.r >= 0.00001 THEN list_transform(n.l, lambda y: {'node': y.dst, 'rank': CAST(0 AS DOUBLE), 'r': t.r * 0.85 * y.p}) ELSE [] END, recursive := true), max(t.r) OVER () AS most
                FROM t JOIN (SELECT src, list({'dst': dst, 'p': p}) AS l FROM p GROUP BY src) n ON n.src = t.node) x WHERE most >= 0.00001) GROUP BY round, node),
    l AS (SELECT node, rank FROM t WHERE round = (SELECT max(round) FROM t))
    SELECT node, round(rank, 7) AS score FROM l WHERE node <> 's1' AND rank > 0 ORDER BY score DESC, node LIMIT 5
""")
def personal_ranks(spark, d):
    li = table(spark, d, "lineitem").select(tag("s", "l_suppkey").alias("a"), tag("p", "l_partkey").alias("b"))
    edges = li.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(li.select(F.col("b").alias("src"), F.col("a").alias("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    # its SQL has no bound: whole tables of any size are ranked
    return graph.personal_rank(edges, spark.createDataFrame([("s1",)], "node string"), most_nodes=None, most_arcs=None, most_pushes=None)


@query("""
    WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) - length(p_name) AS d FROM part),
    w AS (SELECT r.round, d, CAST('0x' || substr(md5(p_partkey || ':' || r.round), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM p, range(400) r(round)),
    x AS (SELECT round, d, CASE WHEN u >= 0.9994058151824183 THEN 6 WHEN u >= 0.9963401531726563 THEN 5 WHEN u >= 0.9810118431238462 THEN 4 WHEN u >= 0.9196986029286058 THEN 3 WHEN u >= 0.7357588823428847 THEN 2 WHEN u >= 0.36787944117144233 THEN 1 ELSE 0 END AS w FROM w),
    m AS (SELECT round, sum(w * d) / sum(w) AS m FROM x GROUP BY round)
    SELECT (SELECT round(avg(d), 9) FROM p) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM m
""")
def bootstrap_interval(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.length("p_name").cast("double").alias("b"))
    return search.paired_bootstrap(p, "p_partkey", "a", "b", rounds=400)
