"""Queries over the driver's tables, one or more for each operator, with DuckDB SQL for the comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import graph, ledger, packing
from tessera.operators import relational as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under `name`, with its SQL where SQL can express it."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- ledger state ---------------------------------------------------------------------------------------------------


@query("a10_latest_state", "SELECT user_id, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS state FROM events GROUP BY user_id")
def _(s, d):
    return ledger.latest_state(table(s, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query(
    "a11_ledger_legality",
    """WITH r AS (SELECT *, sum(CAST(event_type = 'click' AS INT)) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    v AS (SELECT *, lag(value < 50) OVER w AS m, lag(d) OVER w AS p FROM r WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, user_id, m IS NULL OR (m AND d > p) AS legal FROM v""",
)
def _(s, d):
    c = F.col("event_type")
    return ledger.legality(table(s, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", c == "purchase", F.col("value") < 50, c == "click").select("event_id", "user_id", "legal")


@query(
    "a9_high_water",
    "SELECT l_suppkey % 10 AS part, max(l_orderkey) AS high FROM lineitem GROUP BY 1",
)
def _(s, d):
    return ledger.high_water(table(s, d, "lineitem"), F.col("l_suppkey") % 10, "l_orderkey")


@query(
    "w6_since_marker",
    """WITH m AS (SELECT user_id, max(struct_pack(t := ts, i := event_id)) AS k FROM events WHERE event_type = 'purchase' GROUP BY 1)
    SELECT e.user_id, count(*) AS since FROM events e LEFT JOIN m USING (user_id) WHERE k IS NULL OR struct_pack(t := ts, i := event_id) > k GROUP BY 1""",
)
def _(s, d):
    return ledger.since_marker(table(s, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase").groupBy("user_id").agg(F.count("*").alias("since"))


@query("w10_read_number", "SELECT event_id, CAST(sum(CAST(event_type = 'click' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS read FROM events")
def _(s, d):
    return ledger.read_number(table(s, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "click").select("event_id", "read")


@query("w9_previous_line", "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))


@query("w11_fill_down", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS block FROM events")
def _(s, d):
    return R.fill_down(table(s, d, "events"), ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id"))).select("event_id", "block")


@query("w7_ordinal", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS ordinal FROM orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long").alias("ordinal"))


@query("t5_late_lines", "SELECT count(*) FILTER (WHERE c_custkey IS NULL) AS late, count(*) FILTER (WHERE c_custkey IS NOT NULL) AS carried FROM events LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON c_custkey = user_id")
def _(s, d):
    known = table(s, d, "customer").where("c_acctbal > 0").select("c_custkey")
    return table(s, d, "events").join(known, F.col("c_custkey") == F.col("user_id"), "left").agg(F.count_if(F.col("c_custkey").isNull()).alias("late"), F.count("c_custkey").alias("carried"))


# -- aggregates -----------------------------------------------------------------------------------------------------


@query("a1_ordered_counts", "SELECT p_type AS key, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1")
def _(s, d):
    return R.ordered_counts(table(s, d, "part"), F.col("p_type"), F.col("p_partkey"))


@query("a2_cross_tab", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def _(s, d):
    return R.cross_tab(table(s, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


STEM_SQL = "CASE WHEN contains(p_type, ' ') THEN regexp_extract(p_type, '^(.*) [^ ]*$', 1) ELSE p_type END"


@query(
    "a3_stem_digest",
    f"""WITH t AS (SELECT p_brand, {STEM_SQL} AS stem, p_name, min(p_partkey) AS k, count(*) AS c FROM part GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, stem ORDER BY k) AS rn FROM t)
    SELECT p_brand, stem, CAST(sum(c) AS BIGINT) AS n, string_agg(p_name, '; ' ORDER BY k) FILTER (WHERE rn <= 3) AS titles FROM r GROUP BY 1, 2""",
)
def _(s, d):
    t = table(s, d, "part").groupBy("p_brand", T.stem(F.col("p_type"), " ").alias("stem"), "p_name").agg(F.min("p_partkey").alias("k"), F.count("*").alias("c"))
    r = t.withColumn("rn", F.row_number().over(Window.partitionBy("p_brand", "stem").orderBy("k")))
    names = F.transform(F.sort_array(F.collect_list(F.when(F.col("rn") <= 3, F.struct("k", "p_name")))), lambda x: x["p_name"])
    return r.groupBy("p_brand", "stem").agg(F.sum("c").alias("n"), F.array_join(names, "; ").alias("titles"))


@query("a4_singletons", f"SELECT p_brand FROM (SELECT p_brand, {STEM_SQL} || p_name AS k FROM part) GROUP BY 1 HAVING count(DISTINCT k) = count(*) AND count(*) > 1")
def _(s, d):
    t = table(s, d, "part").select("p_brand", F.concat(T.stem(F.col("p_type"), " "), "p_name").alias("k"))
    return t.groupBy("p_brand").agg(F.countDistinct("k").alias("u"), F.count("*").alias("n")).where("u = n and n > 1").select("p_brand")


@query("a5_keep_first", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def _(s, d):
    keyed = table(s, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return R.keep_first(keyed, ["digest"], ["doc_id"]).select("doc_id", "source")


@query("r18_duplicate_files", "SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS kept FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return table(s, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("kept")).where("copies > 1")


@query("a6_unique_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_partkey) AS one, max(l_partkey) AS other FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("l_partkey").alias("one"), F.max("l_partkey").alias("other")).where("n > 1")


@query("a7_sums", "SELECT p_brand, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def _(s, d):
    return table(s, d, "lineitem").join(table(s, d, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))


@query("a8_tallies", "SELECT count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").agg(*[F.count_if(F.col("l_returnflag") == x).alias(x.lower()) for x in "ANR"])


@query("a12_repeated_groups", "SELECT source, min(doc_id) AS first, count(*) AS members FROM documents WHERE lang <> 'de' GROUP BY 1 HAVING count(*) >= 5")
def _(s, d):
    return table(s, d, "documents").where("lang <> 'de'").groupBy("source").agg(F.min("doc_id").alias("first"), F.count("*").alias("members")).where("members >= 5")


@query("r22_repeated_lines", "WITH l AS (SELECT DISTINCT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT source, md5(line) AS line, count(*) AS pages FROM l GROUP BY source, l.line HAVING count(*) >= 5")
def _(s, d):
    lines = table(s, d, "documents").select("source", F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("l"))
    return lines.groupBy("source", F.md5("l").alias("line")).agg(F.count("*").alias("pages")).where("pages >= 5")


@query("a14_closed_kinds", "WITH k(kind) AS (VALUES ('click'), ('view'), ('purchase'), ('refund')) SELECT kind, count(event_id) AS n FROM k LEFT JOIN events ON event_type = kind GROUP BY 1")
def _(s, d):
    kinds = s.createDataFrame([(k,) for k in ("click", "view", "purchase", "refund")], "kind string")
    n = table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return kinds.join(n, F.col("kind") == F.col("event_type"), "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "a15_multi_membership",
    "WITH o AS (SELECT l_orderkey, count(DISTINCT l_suppkey % 5) AS k FROM lineitem GROUP BY 1) SELECT CAST(sum(k) AS BIGINT) AS memberships, count(*) AS items, count(*) FILTER (WHERE k > 1) AS shared FROM o",
)
def _(s, d):
    o = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.countDistinct(F.col("l_suppkey") % 5).alias("k"))
    return o.agg(F.sum("k").alias("memberships"), F.count("*").alias("items"), F.count_if(F.col("k") > 1).alias("shared"))


@query("a18_quantifiers", "SELECT l_orderkey, bool_and(l_linestatus = 'F') AS all_done, bool_or(l_returnflag = 'R') AS any_returned FROM lineitem GROUP BY 1")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_linestatus") == "F").alias("all_done"), F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"))


@query("a19_known_totals", "SELECT c_nationkey, CASE WHEN count(*) FILTER (WHERE c_acctbal < 0) > 0 THEN NULL ELSE count(*) END AS total FROM customer GROUP BY 1")
def _(s, d):
    return table(s, d, "customer").groupBy("c_nationkey").agg(F.when(F.count_if(F.col("c_acctbal") < 0) == 0, F.count("*")).alias("total"))


@query("a24_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def _(s, d):
    return table(s, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("r33_value_counts", "SELECT state, count(*) AS n FROM (SELECT user_id, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS state FROM events GROUP BY 1) GROUP BY 1")
def _(s, d):
    return ledger.latest_state(table(s, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").groupBy("state").agg(F.count("*").alias("n"))


# -- packing and numbering --------------------------------------------------------------------------------------------


@query(
    "w2_even_split",
    """WITH x AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
    y AS (SELECT *, (n + 11) // 12 AS k FROM x), z AS (SELECT *, n // k AS b, n % k AS e FROM y)
    SELECT c_custkey, c_mktsegment, CAST(CASE WHEN i < e * (b + 1) THEN i // (b + 1) ELSE e + (i - e * (b + 1)) // b END AS BIGINT) AS part FROM z""",
)
def _(s, d):
    return packing.even_split(table(s, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], ["c_custkey"])


@query("w3_batches", "SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 25 AS BIGINT) AS batch FROM orders")
def _(s, d):
    return packing.batches(table(s, d, "orders"), ["o_orderstatus"], ["o_orderkey"], 25).select("o_orderkey", "batch")


@query(
    "w4_fold_small",
    """WITH RECURSIVE p AS (SELECT c_nationkey AS g, o_custkey AS o, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_custkey) AS i
      FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
    f AS (SELECT g, o, i, n AS built, 1 AS pass FROM p WHERE i = 1 UNION ALL
      SELECT p.g, p.o, p.i, CASE WHEN least(f.built, p.n) < 3 AND f.built + p.n <= 12 THEN f.built + p.n ELSE p.n END,
             CASE WHEN least(f.built, p.n) < 3 AND f.built + p.n <= 12 THEN f.pass ELSE f.pass + 1 END FROM f JOIN p ON p.g = f.g AND p.i = f.i + 1)
    SELECT g AS c_nationkey, o AS o_custkey, CAST(pass AS BIGINT) AS pass FROM f""",
)
def _(s, d):
    parts = table(s, d, "orders").join(table(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey", "o_custkey").agg(F.count("*").alias("n"))
    return packing.fold_small(parts, ["c_nationkey"], "o_custkey", "n")


@query(
    "w5_bins",
    """WITH RECURSIVE p AS (SELECT s_nationkey AS g, s_suppkey AS o, 1 + s_suppkey % 4 AS r, 1 + s_suppkey % 4 + s_suppkey % 3 AS u, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier),
    f AS (SELECT g, o, i, r, u, 1 AS bin FROM p WHERE i = 1 UNION ALL
      SELECT p.g, p.o, p.i, CASE WHEN f.r + p.r <= 8 AND f.u + p.u <= 10 THEN f.r + p.r ELSE p.r END, CASE WHEN f.r + p.r <= 8 AND f.u + p.u <= 10 THEN f.u + p.u ELSE p.u END,
             CASE WHEN f.r + p.r <= 8 AND f.u + p.u <= 10 THEN f.bin ELSE f.bin + 1 END FROM f JOIN p ON p.g = f.g AND p.i = f.i + 1)
    SELECT g AS s_nationkey, o AS s_suppkey, CAST(bin AS BIGINT) AS bin FROM f""",
)
def _(s, d):
    k = F.col("s_suppkey")
    g = table(s, d, "supplier").select("s_nationkey", "s_suppkey", (1 + k % 4).alias("r"), (1 + k % 4 + k % 3).alias("u"))
    return packing.bins(g, ["s_nationkey"], "s_suppkey", "r", "u")


@query(
    "w1_bind_ids",
    """WITH l AS (SELECT c_custkey AS k, c_nationkey AS part, c_custkey // 3 AS number FROM customer WHERE c_custkey % 3 = 0),
    p AS (SELECT c_custkey AS k, c_nationkey AS part, c_custkey + 10000000 AS number FROM customer WHERE c_custkey % 2 = 0),
    f AS (SELECT * FROM p WHERE k NOT IN (SELECT k FROM l)), h AS (SELECT part, max(number) AS h FROM (SELECT * FROM l UNION ALL SELECT * FROM p) GROUP BY 1),
    b AS (SELECT c.c_custkey, c.c_nationkey, coalesce(l.number, f.number) AS number, CASE WHEN l.k IS NOT NULL THEN 'ledger' WHEN f.k IS NOT NULL THEN 'plan' ELSE 'new' END AS bound
          FROM customer c LEFT JOIN l ON l.k = c.c_custkey LEFT JOIN f ON f.k = c.c_custkey)
    SELECT c_custkey, bound, CAST(coalesce(number, coalesce(h, 0) + row_number() OVER (PARTITION BY c_nationkey, number IS NULL ORDER BY c_custkey)) AS BIGINT) AS number FROM b LEFT JOIN h ON h.part = c_nationkey""",
)
def _(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_nationkey")
    led = c.where("c_custkey % 3 = 0").withColumn("number", F.floor(F.col("c_custkey") / 3))
    plan = c.where("c_custkey % 2 = 0").withColumn("number", F.col("c_custkey") + 10_000_000)
    return packing.bind_ids(c, "c_custkey", "c_nationkey", "c_custkey", led, plan).select("c_custkey", "bound", "number")


@query("k6_running_cap", "SELECT doc_id, used FROM (SELECT doc_id, CAST(sum(length(text) + 1) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS used FROM documents) WHERE used <= 25000")
def _(s, d):
    return R.running_cap(table(s, d, "documents"), ["source"], ["doc_id"], "text", 25_000).select("doc_id", "used")


# -- joins, sets and graphs -------------------------------------------------------------------------------------------


@query("j2_left_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(s, d):
    return table(s, d, "customer").join(table(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("j3_left_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _(s, d):
    return table(s, d, "customer").join(table(s, d, "orders").where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


PREFIX_SQL = "CASE WHEN NOT regexp_matches(k, '^[0-9]{6}$') OR NOT ends_with(k, '00') THEN k WHEN ends_with(k, '0000') THEN k[1:2] WHEN k[4:4] <> '0' THEN k[1:4] ELSE k[1:3] END"


@query(
    "j4_prefix_join",
    f"""WITH t(k) AS (VALUES ('000000'), ('001000'), ('001200'), ('000800'), ('000123')), c AS (SELECT k, {PREFIX_SQL} AS p FROM t)
    SELECT p_partkey, k AS package FROM part JOIN c ON starts_with(lpad(CAST(p_partkey AS VARCHAR), 6, '0'), p) AND length(p) IN (2, 3, 4, 6)""",
)
def _(s, d):
    packages = s.createDataFrame([(k,) for k in ("000000", "001000", "001200", "000800", "000123")], "package string")
    return graph.prefix_join(table(s, d, "part").select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("code")), "code", packages, "package").select("p_partkey", "package")


@query(
    "j9_reconcile",
    """WITH c AS (SELECT o_orderkey AS k, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS planned FROM orders), f AS (SELECT l_orderkey AS k, count(*) AS counted FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1)
    SELECT k, CASE WHEN counted IS NULL THEN 'missing' WHEN planned IS NULL THEN 'extra' WHEN counted < planned THEN 'below' WHEN counted > planned THEN 'above' ELSE 'same' END AS verdict FROM c FULL JOIN f USING (k)""",
)
def _(s, d):
    plan = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.substring("o_orderpriority", 1, 1).cast("long").alias("planned"))
    found = table(s, d, "lineitem").where("l_returnflag <> 'A'").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("counted"))
    return R.reconcile(plan, found, ["k"], "planned", "counted").select("k", "verdict")


@query(
    "j10_waits",
    """WITH e AS (SELECT c_nationkey AS pass, o_orderstatus AS g, min(substr(o_orderpriority, 1, 1)) AS low, max(substr(o_orderpriority, 1, 1)) AS high FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
    SELECT DISTINCT p.pass, q.pass AS waits_on FROM e p JOIN e q ON p.g = q.g AND q.pass < p.pass AND q.low < p.high""",
)
def _(s, d):
    u = table(s, d, "orders").join(table(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    u = u.select(F.col("c_nationkey").alias("unit_pass"), F.col("c_nationkey").alias("pos"), F.col("o_orderstatus").alias("g"), F.substring("o_orderpriority", 1, 1).alias("rank"))
    return graph.waits(u, "unit_pass", "pos", "g", "rank")


@query(
    "j12_reachable",
    """WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS a, (n_nationkey * 2 + 1) % 25 AS b FROM nation), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a, b FROM r""",
)
def _(s, d):
    e = table(s, d, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 2 + 1) % 25).alias("b")).distinct()
    return graph.reachable(e, "a", "b")


@query("j15_snapshot_diff", """WITH b AS (SELECT l_partkey, l_suppkey, sum(l_linenumber) AS n FROM lineitem WHERE year(l_shipdate) = 1995 GROUP BY 1, 2), a AS (SELECT l_partkey, l_suppkey, sum(l_linenumber) AS n FROM lineitem WHERE year(l_shipdate) = 1996 GROUP BY 1, 2)
    SELECT l_partkey, l_suppkey, CASE WHEN b.n IS NULL THEN 'new' WHEN a.n IS NULL THEN 'gone' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS verdict FROM b FULL JOIN a USING (l_partkey, l_suppkey)""")
def _(s, d):
    of = lambda y: table(s, d, "lineitem").where(F.year("l_shipdate") == y).groupBy("l_partkey", "l_suppkey").agg(F.sum("l_linenumber").alias("n"))
    return R.snapshot_diff(of(1995), of(1996), ["l_partkey", "l_suppkey"], ["n"])


@query("u4_partition_check", "SELECT o_orderkey, 1 AS in_whole, CAST(0 AS BIGINT) AS in_parts FROM orders WHERE o_orderstatus = 'P'")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    bad = R.partition_check(o, [o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'")], ["o_orderkey"])
    return bad.select("o_orderkey", F.col("in_whole").cast("int").alias("in_whole"), "in_parts")


@query("u5_symmetric_difference", "SELECT c_nationkey AS k, 'customer' AS side FROM customer WHERE c_acctbal > 9900 AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) GROUP BY 1 UNION ALL SELECT s_nationkey, 'supplier' FROM supplier WHERE s_acctbal > 9000 AND s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) GROUP BY 1")
def _(s, d):
    c = table(s, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k")).distinct()
    p = table(s, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("k")).distinct()
    return c.join(p, "k", "left_anti").withColumn("side", F.lit("customer")).union(p.join(c, "k", "left_anti").withColumn("side", F.lit("supplier")))


@query("u2_intersection", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(s, d):
    return table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier").select("s_nationkey"))


@query("u3_difference", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def _(s, d):
    return table(s, d, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(s, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


# -- selection, order, scalars ----------------------------------------------------------------------------------------


@query("p6_selection", "SELECT p_partkey FROM part WHERE p_size > 10 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND (p_type GLOB 'S*' OR p_type GLOB '*[!A-M]')")
def _(s, d):
    return R.select_units(table(s, d, "part"), F.col("p_size") > 10, (F.col("p_brand"), ["Brand#11", "Brand#12", "Brand#13"]), (F.col("p_type"), ["S*", "*[!A-M]"])).select("p_partkey")


@query(
    "p11_violations",
    """WITH b AS (SELECT 'size' AS rule, CAST(p_partkey AS VARCHAR) AS k FROM part WHERE NOT p_size < 40 UNION ALL SELECT 'price', CAST(p_partkey AS VARCHAR) FROM part WHERE NOT p_retailprice < 1500),
    r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY k) AS n FROM b) SELECT rule, count(*) AS offenders, string_agg(k, ', ' ORDER BY k) FILTER (WHERE n <= 5) AS named FROM r GROUP BY 1""",
)
def _(s, d):
    return R.violations(table(s, d, "part"), {"size": F.col("p_size") < 40, "price": F.col("p_retailprice") < 1500}, F.col("p_partkey").cast("string")).select("rule", "offenders", "named")


@query("o1_rank_order", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 999 END, o_orderkey) AS BIGINT) AS place FROM orders")
def _(s, d):
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(999)
    return table(s, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(rank, "o_orderkey")).cast("long").alias("place"))


@query("o5_top_five", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 5")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(5)


@query("o6_argmin", "SELECT l_partkey, arg_min(l_suppkey, struct_pack(a := l_extendedprice / l_quantity, b := l_suppkey)) AS best FROM lineitem GROUP BY 1")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_partkey").agg(F.min_by("l_suppkey", F.struct(F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_suppkey"))).alias("best"))


@query("f3_normal_names", "SELECT p_partkey, trim(regexp_replace(lower(p_type || '/' || p_name), '[^0-9a-z]+', ' ', 'g')) AS name FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", T.normal_name(F.concat_ws("/", "p_type", "p_name")).alias("name"))


@query("f2_stem", f"SELECT p_partkey, {STEM_SQL} AS stem FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", T.stem(F.col("p_type"), " ").alias("stem"))


@query("f11_short_digest", "SELECT doc_id, substr(sha256(text), 1, 12) AS digest FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.short_digest(F.col("text")).alias("digest"))


@query("f12_json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# -- record service -----------------------------------------------------------------------------------------------------


@query(
    "r2_current_values",
    """WITH e AS (SELECT event_id AS id, user_id AS subject, event_type AS predicate, ts, CASE WHEN event_id % 5 = 0 THEN lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) END AS old FROM events)
    SELECT subject, predicate, id FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.subject = e.subject AND x.predicate = e.predicate AND x.old = e.id)
    QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY ts DESC, id) = 1""",
)
def _(s, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    e = table(s, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), "ts", F.when(F.col("event_id") % 5 == 0, F.lag("event_id").over(w)).alias("old"))
    return R.current_values(e, ["subject", "predicate"], "id", "old", "ts").select("subject", "predicate", "id")


@query("r4_pivot", "SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS user_turns, count(*) FILTER (WHERE role = 'assistant') AS assistant_turns FROM conversations GROUP BY 1")
def _(s, d):
    return table(s, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("user_turns"), F.count_if(F.col("role") == "assistant").alias("assistant_turns"))


@query("r6_text_search", "SELECT source, least(count(*), 2000) AS pages FROM documents WHERE regexp_matches(lower(text), '\\bthe\\b') GROUP BY 1")
def _(s, d):
    return table(s, d, "documents").where(F.lower("text").rlike(r"\bthe\b")).groupBy("source").agg(F.least(F.count("*"), F.lit(2000)).alias("pages"))


@query("r10_leveling", "SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS bid, CAST(rank() OVER (PARTITION BY l_partkey ORDER BY min(l_extendedprice / l_quantity)) AS BIGINT) AS place FROM lineitem GROUP BY 1, 2")
def _(s, d):
    b = table(s, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("bid"))
    return b.withColumn("place", F.rank().over(Window.partitionBy("l_partkey").orderBy("bid")).cast("long"))


@query("r12_takeoff", "SELECT p_type, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, count(*) AS marks FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def _(s, d):
    return table(s, d, "lineitem").join(table(s, d, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy("p_type").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.count("*").alias("marks"))


@query("r14_prefix_counts", "SELECT substr(o_orderpriority, 1, 1) AS prefix, count(*) AS entries, count(DISTINCT o_custkey) AS subjects FROM orders GROUP BY 1")
def _(s, d):
    return table(s, d, "orders").groupBy(F.substring("o_orderpriority", 1, 1).alias("prefix")).agg(F.count("*").alias("entries"), F.countDistinct("o_custkey").alias("subjects"))


@query("r16_reach", "SELECT r_name, count(DISTINCT c_custkey) AS companies FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 0 GROUP BY 1")
def _(s, d):
    n = table(s, d, "region").join(table(s, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return n.join(table(s, d, "customer").where("c_acctbal > 0"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("r_name").agg(F.countDistinct("c_custkey").alias("companies"))


@query("r17_newest_twenty", "SELECT user_id, event_id, cut FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY user_id) > 20 AS cut FROM events) WHERE n <= 20")
def _(s, d):
    w = Window.partitionBy("user_id")
    e = table(s, d, "events").withColumn("n", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id")))).withColumn("cut", F.count("*").over(w) > 20)
    return e.where("n <= 20").select("user_id", "event_id", "cut")


@query("r20_tombstones", "SELECT user_id FROM (SELECT user_id, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS s FROM events GROUP BY 1) WHERE s <> 'refund'")
def _(s, d):
    return ledger.latest_state(table(s, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").where("state <> 'refund'").select("user_id")


@query("r34_sections", "SELECT c_nationkey // 5 AS division, count(*) FILTER (WHERE c_acctbal >= 0) AS confirmed, count(*) FILTER (WHERE c_acctbal < 0) AS listed FROM customer GROUP BY 1")
def _(s, d):
    return table(s, d, "customer").groupBy(F.floor(F.col("c_nationkey") / 5).cast("int").alias("division")).agg(F.count_if(F.col("c_acctbal") >= 0).alias("confirmed"), F.count_if(F.col("c_acctbal") < 0).alias("listed"))
