"""Queries of scans, record rules and small operators over the driver's tables. Scans read lines that are written from a table in the plan."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import graph, record
from tessera.operators.ordinals import numbered
from tessera.plans.registry import query, table
from tessera.sources import lines as L

# -- scans --------------------------------------------------------------------------------------------------------------


@query(
    "s7_ledger_scan",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'dispatch' WHEN 'purchase' THEN 'verified' WHEN 'refund' THEN 'pass' ELSE 'note' END AS keyword, event_type = 'refund' AS is_lead,
    CASE WHEN event_type <> 'refund' THEN 'U-' || user_id END AS unit_id, CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) END AS created,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN value < 50 THEN 'mismatch' ELSE 'ok' END END AS result, CASE WHEN event_type = 'click' AND event_id % 10 <> 0 THEN 'A' || (event_id % 7) || ',B2' END AS sheets,
    CASE WHEN event_type = 'click' AND event_id % 10 = 0 THEN 'names no sheets' END AS error FROM events""",
)
def _(s, d):
    e = table(s, d, "events")
    t, u = F.col("event_type"), F.concat(F.lit(" 1 P1 U-"), F.col("user_id"))
    line = (
        F.when(t == "click", F.concat(F.lit("dispatch"), u, F.when(F.col("event_id") % 10 == 0, F.lit("  sheet  ")).otherwise(F.lit("  sheets  ")), F.lit("B2, A"), (F.col("event_id") % 7).cast("string"), F.lit(" , B2 purpose read all")))
        .when(t == "purchase", F.concat(F.lit("  verified"), u, F.lit(" created "), F.floor("value").cast("string"), F.lit(" items 2 result "), F.when(F.col("value") < 50, "mismatch").otherwise("ok")))
        .when(t == "refund", F.lit("pass: P1 created 99")).otherwise(F.concat(F.lit("note"), u, F.lit(" kind clause")))
    )
    got = L.scan_ledger(e.select("event_id", F.lit("ledger.md").alias("file"), F.col("event_id").alias("line_no"), line.alias("line")))
    return got.select("event_id", "keyword", "is_lead", "unit_id", "created", "result", F.array_join("sheets", ",").alias("sheets"), "error")


@query("s11_trades_scan", "SELECT 'u' || l_suppkey AS unit_id, p_type AS code, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def _(s, d):
    g = table(s, d, "lineitem").join(table(s, d, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy("l_suppkey", "p_type").agg(F.count("*").alias("c"))
    row = F.concat(F.lit("u"), "l_suppkey", F.lit(" trade "), "p_type", F.lit("  "), F.col("c").cast("string"))
    both = g.select(F.explode(F.array(row, F.concat(F.lit("u"), "l_suppkey", F.lit(" touched "), "p_type"), F.lit("  "))).alias("line"))
    return L.scan_trades(both.withColumn("file", F.lit("A1.txt")).withColumn("line_no", F.lit(1))).where("kind = 'trade' AND error IS NULL").select("unit_id", "code", "n")


@query("s11_trades_refused", "SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 1")
def _(s, d):
    line = F.concat(F.lit("u1 "), F.when(F.col("n_nationkey") % 2 == 1, "trades").otherwise("trade"), F.lit(" "), "n_name", F.lit(" 3"))
    return L.scan_trades(table(s, d, "nation").select("n_nationkey", line.alias("line"))).where("error IS NOT NULL").select("n_nationkey")


@query("s12_names_scan", "SELECT CAST(c_nationkey AS VARCHAR) AS unit_id, 'scopeItem:' || c_nationkey || '-' || (c_custkey % 7) AS subject, arg_max(c_name, c_custkey) AS name FROM customer GROUP BY 1, 2")
def _(s, d):
    c = table(s, d, "customer")
    line = F.concat_ws("\t", F.col("c_nationkey").cast("string"), F.concat(F.lit("scopeItem:"), "c_nationkey", F.lit("-"), (F.col("c_custkey") % 7).cast("string")), "c_name")
    names = c.select(F.lit("a.txt").alias("file"), F.col("c_custkey").alias("line_no"), line.alias("line")).union(c.select(F.lit("b.txt"), "c_custkey", F.concat("c_nationkey", F.lit("\tnone"))))
    return L.last_names(L.scan_names(names))


@query("s14_outcome_scan", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 'k' || o_custkey END AS key, CASE o_orderstatus WHEN 'F' THEN 'recited' WHEN 'O' THEN 'not found' END AS outcome, CASE WHEN o_orderstatus <> 'P' THEN 'a \"b\" | ' || o_orderpriority END AS name, o_orderstatus = 'P' AS refused FROM orders")
def _(s, d):
    o = table(s, d, "orders")
    outcome = F.when(F.col("o_orderstatus") == "F", "recited").when(F.col("o_orderstatus") == "O", "not found").otherwise("lost")
    name = F.substring(F.to_json(F.struct(F.concat(F.lit('a "b" | '), "o_orderpriority").alias("x"))), 6, 10_000)
    line = F.concat(F.lit("row: k"), "o_custkey", F.lit(" | "), outcome, F.lit(" | p 1 | "), F.regexp_replace(name, r"\}$", ""), F.lit(" | what | else"))
    got = L.scan_outcomes(o.select("o_orderkey", "o_custkey", line.alias("line")))
    return got.select("o_orderkey", "key", "outcome", "name", F.col("error").isNotNull().alias("refused"))


@query("s16_fold_report", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'kept' WHEN 1 THEN 'sealant kept' WHEN 2 THEN 'deleted' END AS label, CASE WHEN n_nationkey % 4 = 2 THEN 'pkg-' || n_regionkey END AS package FROM nation")
def _(s, d):
    k = F.col("n_nationkey") % 4
    line = F.when(k == 0, F.concat(F.lit("kept: "), "n_name")).when(k == 1, F.lit("sealant kept: two")).when(k == 2, F.concat(F.lit("deleted: "), "n_name", F.lit(", trade 09 65 00, package pkg-"), "n_regionkey", F.lit(", no work"))).otherwise(F.lit("other: x"))
    return L.scan_fold_report(table(s, d, "nation").select("n_nationkey", "n_regionkey", line.alias("line"))).select("n_nationkey", "label", "package")


@query("s18_relation", "SELECT n_name AS name, '09 ' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || ',03' AS codes FROM nation")
def _(s, d):
    one = F.concat("n_name", F.lit(" =  09 "), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit(" , 03,03"))
    text = table(s, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.collect_list(one), " ; ").alias("text"))
    return L.scan_relation(text, "text").where("error IS NULL").select("name", F.array_join("codes", ",").alias("codes"))


@query("s20_jsonl", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 3 <> 0")
def _(s, d):
    line = F.when(F.col("event_id") % 3 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    return L.scan_jsonl(table(s, d, "events").select(F.lit("f").alias("file"), F.col("event_id").alias("line_no"), line.alias("line")), "k long").select(F.col("line_no").alias("event_id"), "k")


GRID_SQL = "SELECT n_nationkey AS key, CAST(row_number() OVER (ORDER BY {order}, n_nationkey) AS BIGINT) AS place FROM nation"


def _grid(s, d, with_offset):
    row = F.struct(F.col("n_nationkey").alias("k"))
    page = table(s, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(row)).alias("sheets"))
    body = F.to_json(F.struct((-F.col("n_regionkey")).alias("offset"), "sheets")) if with_offset else F.when(F.col("n_regionkey") > 0, F.to_json("sheets")).otherwise(F.to_json(F.struct(F.lit(9).alias("offset"), "sheets")))
    got = L.scan_pages(page.select(F.concat(F.lit("p"), F.col("n_regionkey").cast("string")).alias("file"), body.alias("json")))
    placed = numbered(got.select("page_ord", "row_ord", F.try_variant_get("sheet", "$.k", "int").alias("key")), ["page_ord", "row_ord"], name="place")
    return placed.select("key", "place")


@query("s3_pages_by_offset", GRID_SQL.format(order="-n_regionkey"))
def _(s, d):
    return _grid(s, d, True)


@query("s4_pages_by_name", GRID_SQL.format(order="n_regionkey"))
def _(s, d):
    return _grid(s, d, False)


@query(
    "s5_packages",
    """WITH p AS (SELECT c_nationkey AS file, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place, c_mktsegment || c_custkey // 30 AS id, c_acctbal FROM customer),
    r AS (SELECT *, c_acctbal < 0 AS bare, row_number() OVER (PARTITION BY file, id ORDER BY place) > 1 AS again FROM p)
    SELECT 'n' || file AS file, CAST(place AS INT) AS place, CASE WHEN bare THEN 'no tradeCode' WHEN c_acctbal > 9000 THEN 'codes are no list of texts' WHEN again THEN 'an id is there twice' END AS rule, CASE WHEN NOT bare AND c_acctbal <= 9000 AND NOT again THEN id END AS id FROM r""",
)
def _(s, d):
    c = F.col
    own = F.concat("c_mktsegment", F.floor(c("c_custkey") / 30).cast("string"))
    body = F.struct("c_custkey", F.to_json(F.struct(own.alias("id"), F.when(c("c_acctbal") >= 0, "09 65 00").alias("tradeCode"), F.when(c("c_acctbal") <= 9000, F.array(F.lit("09 65 00"))).alias("codes"))).alias("x"))
    files = table(s, d, "customer").groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(body)), lambda b: b["x"]).alias("x"))
    packages, refusals = L.scan_packages(files.select(F.concat(F.lit("n"), "c_nationkey").alias("file"), F.concat(F.lit("["), F.array_join("x", ", "), F.lit("]")).alias("json")))
    return packages.select("file", "place", F.lit(None).cast("string").alias("rule"), "id").union(refusals.select("*", F.lit(None).cast("string")))


@query("s19_deliveries", "SELECT event_id, CASE event_type WHEN 'click' THEN 'set' WHEN 'view' THEN 'addendum' END AS issue, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN false END AS still_reading, CASE event_type WHEN 'signup' THEN 'no issue' WHEN 'error' THEN 'another issue' END AS error FROM events")
def _(s, d):
    t = F.col("event_type")
    issue = F.when(t == "click", ',"issue":"set"').when(t == "view", ',"issue" : "addendum"').when(t == "purchase", ',"issue": null').when(t == "signup", "").otherwise(',"issue":"other"')
    line = F.concat(F.lit('{"id":"x","stillReading":false'), issue, F.lit("}"))
    return L.scan_deliveries(table(s, d, "events").select("event_id", line.alias("line"))).select("event_id", "issue", "still_reading", "error")


@query("s23_labels", "SELECT s_suppkey, n_name || ' and ' || r_name AS label FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def _(s, d):
    n = table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    return table(s, d, "supplier").join(F.broadcast(n), F.col("n_nationkey") == F.col("s_nationkey"), "left").select("s_suppkey", F.concat_ws(" and ", "n_name", "r_name").alias("label"))


# -- selection ------------------------------------------------------------------------------------------------------------


@query("p4_labels", "SELECT event_id, CASE WHEN event_type = 'view' THEN '(untyped)' ELSE event_type END AS label FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", T.labelled(F.when(F.col("event_type") != "view", F.col("event_type")), "(untyped)").alias("label"))


@query("p5_placeable", "SELECT p_partkey, p_size > 5 AND p_brand <> 'Brand#11' AS placeable FROM part")
def _(s, d):
    number, page = F.when(F.col("p_brand") != "Brand#11", F.col("p_brand")), F.when(F.col("p_size") > 5, F.col("p_size"))
    return table(s, d, "part").select("p_partkey", (number.isNotNull() & page.isNotNull()).alias("placeable"))


@query("p8_include_exclude", "SELECT p_partkey FROM part WHERE (p_size < 5 OR p_type GLOB 'S*') AND NOT p_type GLOB '*M*'")
def _(s, d):
    t = F.col("p_type")
    return table(s, d, "part").where(((F.col("p_size") < 5) | t.rlike(T.glob("S*"))) & ~t.rlike(T.glob("*M*"))).select("p_partkey")


@query("p13_slice", "SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority GLOB '[12]*') AS now, count(*) FILTER (WHERE NOT o_orderpriority GLOB '[12]*') AS deferred FROM orders GROUP BY 1")
def _(s, d):
    only = F.col("o_orderpriority").rlike(T.glob("[12]*"))
    return table(s, d, "orders").groupBy("o_orderstatus").agg(F.count_if(only).alias("now"), F.count_if(~only).alias("deferred"))


# -- joins ------------------------------------------------------------------------------------------------------------------


@query("j1_one_match", "WITH n AS (SELECT p_name, count(*) AS n, min(p_partkey) AS k FROM part WHERE p_size < 10 GROUP BY 1) SELECT p.p_partkey, CASE WHEN n = 1 THEN k END AS match FROM part p LEFT JOIN n USING (p_name)")
def _(s, d):
    p = table(s, d, "part")
    return record.unique_match(p.select("p_partkey", "p_name"), p.where("p_size < 10").select("p_name", F.col("p_partkey").alias("match")), "p_name").select("p_partkey", "match")


@query(
    "j5_best_match",
    """SELECT p_partkey, arg_min(s_suppkey, struct_pack(a := abs(s_nationkey * 80 - p_size * 40), b := s_suppkey)) AS best
    FROM (SELECT p_partkey, p_size, p_size % 5 AS k FROM part) JOIN (SELECT s_suppkey, s_nationkey, s_nationkey % 5 AS k FROM supplier) USING (k) GROUP BY 1""",
)
def _(s, d):
    # home first: the division joins, the nearest code then decides, ties to the lowest package
    items = table(s, d, "part").select("p_partkey", "p_size", (F.col("p_size") % 5).alias("k"))
    packages = table(s, d, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_nationkey") % 5).alias("k"))
    # packages of one code are equally near to every item, so the lowest of each stands for them: a part meets codes, not packages
    packages = packages.groupBy("s_nationkey", "k").agg(F.min("s_suppkey").alias("s_suppkey"))
    near = F.struct(F.abs(F.col("s_nationkey") * 80 - F.col("p_size") * 40), F.col("s_suppkey"))
    return items.join(F.broadcast(packages), "k").groupBy("p_partkey").agg(F.min_by("s_suppkey", near).alias("best"))


@query("j13_name_links", "WITH h AS (SELECT DISTINCT c_mktsegment AS name, c_nationkey AS item FROM customer), f AS (SELECT name, min(item) AS f FROM h GROUP BY 1) SELECT h.name, f AS \"from\", item AS \"to\" FROM h JOIN f USING (name) WHERE item <> f")
def _(s, d):
    return record.name_links(table(s, d, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("item")), "name", "item")


@query("j14_pass_lookup", "SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def _(s, d):
    done = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(s, d, "lineitem").join(done, "l_orderkey", "left_semi").join(table(s, d, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy("l_suppkey", "p_brand").agg(F.count("*").alias("n"))


@query("j16_sibling_tags", "SELECT s_nationkey AS tag, count(*) AS n FROM supplier GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("tag")).agg(F.count("*").alias("n")).where("n > 1")


@query("j17_levels", "WITH RECURSIVE e AS (SELECT n_nationkey AS a, n_nationkey // 2 AS b FROM nation WHERE n_nationkey > 0), l AS (SELECT 0 AS a, 0 AS level UNION ALL SELECT e.a, l.level + 1 FROM l JOIN e ON e.b = l.a) SELECT a, level FROM l")
def _(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("a"))
    return graph.levels(n.where("a > 0").withColumn("b", F.floor(F.col("a") / 2).cast("int")), n, "a", "b")


# -- aggregates and order -----------------------------------------------------------------------------------------------------


@query("a13_ordered_words", "SELECT o_custkey, string_agg(o_orderpriority, '; ' ORDER BY f) AS words FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS f FROM orders GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    first = table(s, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("f"))
    words = F.transform(F.sort_array(F.collect_list(F.struct("f", "o_orderpriority"))), lambda x: x["o_orderpriority"])
    return first.groupBy("o_custkey").agg(F.array_join(words, "; ").alias("words"))


@query("a16_totals_agree", "SELECT count(*) AS open, CAST(sum(CASE WHEN l_returnflag IN ('A', 'N', 'R') THEN 1 ELSE 0 END) AS BIGINT) AS in_kinds FROM lineitem WHERE l_linestatus = 'O'")
def _(s, d):
    return table(s, d, "lineitem").where("l_linestatus = 'O'").agg(F.count("*").alias("open"), F.sum(F.col("l_returnflag").isin("A", "N", "R").cast("int")).alias("in_kinds"))


@query("a17_exactly_one", "SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber = 1) = 1 AS holds FROM lineitem GROUP BY 1")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey").agg((F.count_if(F.col("l_linenumber") == 1) == 1).alias("holds"))


@query("a20_first_seen", "SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS kinds FROM (SELECT user_id, event_type, min(struct_pack(t := ts, i := event_id)) AS f FROM events GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    first = table(s, d, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    kinds = F.transform(F.sort_array(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"])
    return first.groupBy("user_id").agg(F.array_join(kinds, ",").alias("kinds"))


@query("a21_unnamed", "SELECT DISTINCT o_custkey AS unit FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def _(s, d):
    named = table(s, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("unit"))
    return table(s, d, "orders").select(F.col("o_custkey").alias("unit")).distinct().join(named, "unit", "left_anti")


@query("a23_prefix_digest", "SELECT user_id, sha256(string_agg(event_type, chr(10) ORDER BY ts, event_id)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 5 GROUP BY 1")
def _(s, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    head = table(s, d, "events").withColumn("n", n).where("n <= 5").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("n", "event_type"))).alias("x"))
    return head.select("user_id", F.sha2(F.array_join(F.transform("x", lambda x: x["event_type"]), "\n"), 256).alias("digest"))


@query("w13_bid_ranks", "SELECT s_suppkey, CAST(dense_rank() OVER w AS BIGINT) AS place, CAST(ntile(4) OVER w AS BIGINT) AS quarter, lead(s_suppkey) OVER w AS after FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)")
def _(s, d):
    w = Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    return table(s, d, "supplier").select("s_suppkey", F.dense_rank().over(w).cast("long").alias("place"), F.ntile(4).over(w).cast("long").alias("quarter"), F.lead("s_suppkey").over(w).alias("after"))


@query("o3_named", "WITH r AS (SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS n, count(*) OVER (PARTITION BY s_nationkey) AS c FROM supplier) SELECT s_nationkey, string_agg(s_name, ', ' ORDER BY n) AS named, CAST(greatest(any_value(c) - 5, 0) AS BIGINT) AS more FROM r WHERE n <= 5 GROUP BY 1")
def _(s, d):
    w = Window.partitionBy("s_nationkey")
    r = table(s, d, "supplier").withColumn("n", F.row_number().over(w.orderBy("s_name"))).withColumn("c", F.count("*").over(w)).where("n <= 5")
    named = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "s_name"))), lambda x: x["s_name"]), ", ")
    return r.groupBy("s_nationkey").agg(named.alias("named"), F.greatest(F.max("c") - 5, F.lit(0)).alias("more"))


@query("o4_next_slots", "SELECT n_nationkey FROM nation WHERE n_regionkey > 1 ORDER BY n_regionkey, n_nationkey LIMIT (SELECT greatest(6 - count(*) FILTER (WHERE n_nationkey < 3), 0) FROM nation)")
def _(s, d):
    return record.next_slots(table(s, d, "nation"), ["n_regionkey", "n_nationkey"], F.col("n_regionkey") > 1, F.col("n_nationkey") < 3).select("n_nationkey")


@query("o7_free_letter", "WITH l AS (SELECT unnest(string_split('bcdefghijklmnopqrstuvwxyz', '')) AS letter), u AS (SELECT DISTINCT s_nationkey AS k, chr(CAST(98 + s_suppkey % 4 AS INT)) AS letter FROM supplier) SELECT k, min(l.letter) AS letter FROM (SELECT DISTINCT k FROM u) CROSS JOIN l WHERE (k, l.letter) NOT IN (SELECT (k, letter) FROM u) GROUP BY 1")
def _(s, d):
    letters = F.array(*[F.lit(chr(98 + k)) for k in range(25)])
    used = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.collect_set(F.char(98 + F.col("s_suppkey") % 4)).alias("used"))
    return used.select("k", F.array_min(F.array_except(letters, "used")).alias("letter"))


@query("t3_check_in_due", "WITH m AS (SELECT user_id, max(struct_pack(t := ts, i := event_id)) AS k FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT e.user_id, count(*) FILTER (WHERE event_type = 'click' AND (k IS NULL OR struct_pack(t := ts, i := event_id) > k)) AS since, count(*) FILTER (WHERE event_type = 'click' AND (k IS NULL OR struct_pack(t := ts, i := event_id) > k)) >= 4 AS due FROM events e LEFT JOIN m USING (user_id) GROUP BY 1")
def _(s, d):
    return record.check_in_due(table(s, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_type") == "click")


@query("t6_read_versions", "SELECT event_id, 'U' || user_id || CASE WHEN r > 1 THEN '.read-' || r ELSE '' END AS report FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type = 'click')")
def _(s, d):
    r = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    name = F.concat(F.lit("U"), "user_id", F.when(F.col("r") > 1, F.concat(F.lit(".read-"), F.col("r").cast("string"))).otherwise(""))
    return table(s, d, "events").where("event_type = 'click'").withColumn("r", r).select("event_id", name.alias("report"))


# -- sets and scalars ---------------------------------------------------------------------------------------------------------


@query("u1_concatenate", "SELECT 'customer' AS list, c_custkey AS k FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier")
def _(s, d):
    return table(s, d, "customer").select(F.lit("customer").alias("list"), F.col("c_custkey").alias("k")).unionByName(table(s, d, "supplier").select(F.lit("supplier").alias("list"), F.col("s_suppkey").alias("k")))


@query("u7_subset", "SELECT c_nationkey, count(DISTINCT c_mktsegment) FILTER (WHERE c_mktsegment <> 'BUILDING') = count(DISTINCT c_mktsegment) AS inside FROM customer GROUP BY 1")
def _(s, d):
    held = table(s, d, "customer").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("held"), F.collect_set(F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))).alias("known"))
    return held.select("c_nationkey", (F.size(F.array_except("held", "known")) == 0).alias("inside"))


@query("f1_splits", "SELECT event_id, split_part(props, ':', 1) AS before FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", T.before_first(F.col("props"), ":").alias("before"))


@query("f4_unit_ids", "SELECT o_orderkey, regexp_extract(o_orderpriority, '^([0-9])-([A-Z]+)', 1) AS number, regexp_extract(o_orderpriority, '^([0-9])-([A-Z]+)', 2) AS word FROM orders")
def _(s, d):
    shape = "^([0-9])-([A-Z]+)"
    return table(s, d, "orders").select("o_orderkey", F.regexp_extract("o_orderpriority", shape, 1).alias("number"), F.regexp_extract("o_orderpriority", shape, 2).alias("word"))


@query("f7_digits", "SELECT p_partkey, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", T.digits(F.col("p_brand")).alias("digits"))


@query("f8_three_pairs", "SELECT p_partkey, rpad(lpad(CAST(p_size AS VARCHAR), 2, '0'), 6, '0') AS code FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", T.three_pairs(F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("code"))


@query(
    "f10_degrading_text",
    """WITH g AS (SELECT s_nationkey, string_agg(s_name, '; ' ORDER BY s_name) AS every, count(*) AS n, count(DISTINCT s_suppkey % 3) AS k FROM supplier GROUP BY 1)
    SELECT s_nationkey, CASE WHEN length(every) <= 80 THEN every WHEN length(n || ' in ' || k || ' groups') <= 12 THEN n || ' in ' || k || ' groups' ELSE n || ' rows' END AS said FROM g""",
)
def _(s, d):
    g = table(s, d, "supplier").groupBy("s_nationkey").agg(F.array_join(F.sort_array(F.collect_list("s_name")), "; ").alias("every"), F.count("*").cast("string").alias("n"), F.countDistinct(F.col("s_suppkey") % 3).cast("string").alias("k"))
    grouped = F.concat("n", F.lit(" in "), "k", F.lit(" groups"))
    return g.select("s_nationkey", F.coalesce(F.when(F.length("every") <= 80, F.col("every")), F.when(F.length(grouped) <= 12, grouped), F.concat("n", F.lit(" rows"))).alias("said"))


@query("f14_plurals", "SELECT o_custkey, count(*) || CASE WHEN count(*) = 1 THEN ' order' ELSE ' orders' END AS said FROM orders GROUP BY 1")
def _(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).select("o_custkey", T.counted(F.col("n"), "order").alias("said"))


@query("f15_divmod", "SELECT p_partkey, p_size // 12 AS parts, p_size % 12 AS rest, greatest(p_size, 12) AS most FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.floor(F.col("p_size") / 12).cast("int").alias("parts"), (F.col("p_size") % 12).alias("rest"), F.greatest("p_size", F.lit(12)).alias("most"))


@query("f17_phases", "SELECT event_id, CASE WHEN event_id % 5 IN (1, 2, 3) THEN CAST(event_id % 5 AS VARCHAR) WHEN event_id % 5 = 4 THEN 'r' END AS phase FROM events")
def _(s, d):
    k = F.col("event_id") % 5
    return table(s, d, "events").select("event_id", T.phase(F.when(k == 4, F.lit(" R ")).otherwise(k.cast("string"))).alias("phase"))


@query("f18_ranges", "SELECT l_orderkey, l_linenumber, 1 <= l_linenumber AND l_linenumber <= l_quantity AND l_quantity <= 40 AS valid FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", T.in_range(F.col("l_linenumber"), F.col("l_quantity"), F.lit(40)).alias("valid"))


# -- record service -------------------------------------------------------------------------------------------------------------


@query("r1_append", "SELECT o_orderkey, c_custkey IS NULL OR o_orderkey % 3 = 0 AS accepted FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) ON c_custkey = o_custkey")
def _(s, d):
    current = table(s, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("subject"), F.col("c_custkey").alias("entry_id"))
    entries = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("subject"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("supersedes_id"))
    return record.append(current, entries, ["subject"]).select("o_orderkey", "accepted")


@query("r3_search", """SELECT event_id AS entry_id FROM events WHERE starts_with(CAST(user_id AS VARCHAR), '1') AND event_type = 'click' AND contains(user_id || ' ' || event_type || ' ' || lower(props), '"k": 7') ORDER BY 1 LIMIT 50 OFFSET 5""")
def _(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("entry_id"), F.col("user_id").cast("string").alias("subject"), F.col("event_type").alias("predicate"), F.col("props").alias("value"))
    return record.search(e, prefix="1", predicate="click", text='"K": 7', limit=50, offset=5).select("entry_id")


@query("r5_latest_issue", "SELECT l_partkey, arg_max(l_orderkey, struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber)) AS latest, count(*) AS occurrences FROM lineitem GROUP BY 1")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_partkey").agg(F.max_by("l_orderkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("latest"), F.count("*").alias("occurrences"))


@query("r7_three_way", "WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders), c AS (SELECT DISTINCT user_id AS k FROM events) SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'index-only' WHEN a.k IS NULL THEN 'set-only' ELSE 'matched' END AS verdict, coalesce(a.k, b.k) IN (SELECT k FROM c) AS in_spec FROM a FULL JOIN b ON a.k = b.k")
def _(s, d):
    c, o, e = (table(s, d, t) for t in ("customer", "orders", "events"))
    return record.reconcile_three(c.where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), o.select(F.col("o_custkey").alias("k")), e.select(F.col("user_id").alias("k")), "k")


@query("r15_verify_unit", "SELECT s_nationkey AS unit, count(*) AS entries, count(DISTINCT s_suppkey % 7) AS subjects, CAST(3 AS BIGINT) AS claimed, count(DISTINCT s_suppkey % 7) = 3 AS holds FROM supplier GROUP BY 1")
def _(s, d):
    e = table(s, d, "supplier").select("s_nationkey", (F.col("s_suppkey") % 7).alias("subject"))
    return record.verify_unit(e, e.select(F.col("s_nationkey").alias("unit")).distinct().withColumn("claimed", F.lit(3).cast("long")), F.col("s_nationkey"))


@query("r19_batches", "SELECT o_orderpriority AS batch, count(*) AS entries, min(o_orderkey) FILTER (WHERE o_totalprice < 20000) AS first_bad, count(*) <= 500 AND count(*) FILTER (WHERE o_totalprice < 20000) = 0 AS accepted FROM orders GROUP BY 1")
def _(s, d):
    o = table(s, d, "orders").withColumnRenamed("o_orderpriority", "batch")
    return record.batch_verdict(o, "batch", "o_orderkey", F.col("o_totalprice") >= 20_000)


@query("r23_census", "SELECT l_suppkey, count(*) AS candidates, count(*) = count(*) FILTER (WHERE l_returnflag = 'N') + count(*) FILTER (WHERE l_returnflag = 'A') AS balanced FROM lineitem GROUP BY 1")
def _(s, d):
    f = F.col("l_returnflag")
    return table(s, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("candidates"), (F.count("*") == F.count_if(f == "N") + F.count_if(f == "A")).alias("balanced"))


@query("r25_proposal_state", "SELECT o_custkey, CASE arg_max(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderkey)) WHEN 'F' THEN 'leveled' WHEN 'O' THEN 'not leveled' ELSE 'taken off' END AS state FROM orders GROUP BY 1")
def _(s, d):
    last = table(s, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("x"))
    return last.select("o_custkey", F.when(F.col("x") == "F", "leveled").when(F.col("x") == "O", "not leveled").otherwise("taken off").alias("state"))


@query("r26_bidder_summary", "SELECT l_suppkey, count(*) AS items, count(DISTINCT l_orderkey) AS responses, count(*) - (SELECT count(*) FROM lineitem) // (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS above FROM lineitem GROUP BY 1")
def _(s, d):
    l = table(s, d, "lineitem")
    base = l.agg(F.floor(F.count("*") / F.countDistinct("l_suppkey")).alias("base"))
    g = l.groupBy("l_suppkey").agg(F.count("*").alias("items"), F.countDistinct("l_orderkey").alias("responses"))
    return g.join(F.broadcast(base)).select("l_suppkey", "items", "responses", (F.col("items") - F.col("base")).alias("above"))


@query("r35_company_match", "WITH n AS (SELECT replace(lower(n_name), ' ', '') AS k, count(*) AS c, min(n_nationkey) AS m FROM nation GROUP BY 1) SELECT n_nationkey, CASE WHEN c = 1 THEN m END AS match FROM nation JOIN n ON replace(lower(n_name), ' ', '') = k")
def _(s, d):
    n = table(s, d, "nation")
    asked = n.select("n_nationkey", record.company_key(F.concat(F.upper("n_name"), F.lit(", Inc."))).alias("k"))
    return record.unique_match(asked, n.select(record.company_key(F.concat("n_name", F.lit(" LLC"))).alias("k"), F.col("n_nationkey").alias("match")), "k").select("n_nationkey", "match")


@query("r36_trade_reach", "SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal > 0) AS base, count(*) FILTER (WHERE c_acctbal > 0 AND c_nationkey < 10) AS companies FROM customer GROUP BY 1")
def _(s, d):
    place, labor = F.col("c_acctbal") > 0, F.when(F.col("c_nationkey") < 20, F.col("c_nationkey") < 10)
    return table(s, d, "customer").groupBy("c_mktsegment").agg(F.count_if(place).alias("base"), F.count_if(place & F.coalesce(labor, F.lit(False))).alias("companies"))
