"""Cohorts: joins, two-level aggregation, grouping sets, dedupe, role separation and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.dates import quarter_end, quarter_index, quarter_start
from sedimenta.functions.hashing import digest_modulo, drawn, nul_digest
from sedimenta.operators import relational as R
from sedimenta.operators import sampling as P
from sedimenta.queries import query, r6, table


@query(
    """WITH i AS (SELECT o_custkey AS cust, o_orderkey, sum(greatest(0, CAST(l_quantity - 5 AS BIGINT))) AS n, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey)
SELECT cust, CAST(sum(n) AS BIGINT) AS lines, count(*) AS items, min(lo) AS first_at, max(hi) AS last_at, string_agg(o_orderkey || ':' || CAST(n AS BIGINT), ',' ORDER BY o_orderkey) AS by_item FROM i GROUP BY cust HAVING sum(n) >= 600"""
)
def candidate_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.col("o_custkey").alias("cust"), "o_orderkey", (F.col("l_quantity") - 5).cast("long").alias("added"), "l_shipdate")
    out = R.candidate_units(rows, keys=["cust"], item="o_orderkey", additions="added", at="l_shipdate", least=600)
    return out.withColumn("by_item", F.array_join(F.transform("by_item", lambda x: F.concat_ws(":", x["item"], x["lines"])), ","))


@query(
    """SELECT n_name, c_mktsegment, count(*) AS n_lines, count(DISTINCT o_orderkey) AS n_orders, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag IN ('R', 'A') GROUP BY n_name, c_mktsegment"""
)
def star_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "nation")}
    joined = t["lineitem"].filter(F.col("l_returnflag").isin("R", "A")).join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n_lines"), F.count_distinct("o_orderkey").alias("n_orders"), F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).cast("decimal(18,4)")).cast("double").alias("revenue"))


@query(
    """WITH p AS (SELECT DISTINCT o_orderpriority AS p FROM orders), s AS (SELECT unnest(['F', 'O', 'P', 'X']) AS s),
cells AS (SELECT 0 AS set_id, NULL AS p, NULL AS s UNION ALL SELECT 1, p, NULL FROM p UNION ALL SELECT 2, NULL, s FROM s UNION ALL SELECT 3, p, s FROM p, s),
f AS (SELECT CASE WHEN grouping(o_orderpriority) = 1 AND grouping(o_orderstatus) = 1 THEN 0 WHEN grouping(o_orderstatus) = 1 THEN 1 WHEN grouping(o_orderpriority) = 1 THEN 2 ELSE 3 END AS set_id, o_orderpriority AS p, o_orderstatus AS s, count(*) AS n, round(sum(o_totalprice), 2) AS total
  FROM orders GROUP BY GROUPING SETS ((), (o_orderpriority), (o_orderstatus), (o_orderpriority, o_orderstatus)))
SELECT c.set_id, c.p AS o_orderpriority, c.s AS o_orderstatus, f.n, f.total FROM cells c LEFT JOIN f ON c.set_id = f.set_id AND c.p IS NOT DISTINCT FROM f.p AND c.s IS NOT DISTINCT FROM f.s"""
)
def stratum_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    p = orders.select("o_orderpriority").distinct()
    s = spark.createDataFrame([("F",), ("O",), ("P",), ("X",)], "o_orderstatus string")
    none = F.lit(None).cast("string")
    cells = spark.range(1).select(F.lit(0).alias("set_id"), none.alias("o_orderpriority"), none.alias("o_orderstatus"))
    cells = cells.union(p.select(F.lit(1), "o_orderpriority", none)).union(s.select(F.lit(2), none, "o_orderstatus")).union(p.crossJoin(s).select(F.lit(3), "o_orderpriority", "o_orderstatus"))
    return R.grouping_cells(orders, cells, sets=[[], ["o_orderpriority"], ["o_orderstatus"], ["o_orderpriority", "o_orderstatus"]], aggregates={"n": F.count("*"), "total": F.round(F.sum("o_totalprice"), 2)})


ROLE = "CASE WHEN source IN ('src0', 'src1') THEN 'target' WHEN source < 'src15' THEN 'agent' ELSE 'human' END"


@query(
    f"""WITH d AS (SELECT doc_id, source, {ROLE} AS role, sha256(text) AS h FROM documents),
c AS (SELECT h, max((role = 'target')::INT) AS t, min(source) FILTER (role <> 'target') AS lo, max(source) FILTER (role <> 'target') AS hi FROM d GROUP BY h)
SELECT doc_id, role, CASE WHEN role = 'target' THEN NULL WHEN t = 1 THEN 'target_overlap' WHEN lo <> hi THEN 'across_groups' END AS dropped FROM d LEFT JOIN c ON d.h = c.h"""
)
def role_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.expr(ROLE).alias("role"), F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return R.separate_roles(docs, partition="role", group="source", content="h", target="target").select("doc_id", "role", "dropped")


@query("SELECT sha256(text) AS content, array_to_string(list_sort(list(DISTINCT source)), ',') AS partitions FROM documents GROUP BY content HAVING count(DISTINCT source) > 1")
def content_in_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", F.sha2(F.col("text").cast("binary"), 256).alias("content"))
    return R.role_violations(docs, partition="source", entity="content").withColumn("partitions", F.array_join("partitions", ","))


@query(
    """WITH a AS (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45), b AS (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45), c AS (SELECT k FROM a INTERSECT SELECT k FROM b)
SELECT 'left' AS side, k, count(*) AS n FROM a WHERE k NOT IN (SELECT k FROM c) GROUP BY k UNION ALL SELECT 'right', k, count(*) FROM b WHERE k NOT IN (SELECT k FROM c) GROUP BY k"""
)
def exclusive_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("k"), "l_returnflag")
    left, right = R.without_common(lines.filter("l_returnflag = 'R'"), lines.filter("l_returnflag = 'A'"), "k")
    return left.withColumn("side", F.lit("left")).unionByName(right.withColumn("side", F.lit("right"))).groupBy("side", "k").agg(F.count("*").alias("n"))


@query(
    """SELECT l_orderkey, l_linenumber, row_number() OVER w = 1 AS kept, first_value(l_orderkey) OVER w AS retained_order, first_value(l_linenumber) OVER w AS retained_line
FROM lineitem WINDOW w AS (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber)"""
)
def first_of_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = R.keep_first(rows, keys=["l_partkey", "l_suppkey"], order=["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "kept", F.col("retained.l_orderkey").alias("retained_order"), F.col("retained.l_linenumber").alias("retained_line"))


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS versions FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1")
def evidence_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.collisions(table(spark, sf_dir, "lineitem"), key="l_partkey", evidence="l_suppkey")


@query(
    """WITH u AS (SELECT c_custkey, event_type FROM customer, (SELECT DISTINCT event_type FROM events)), x AS (SELECT DISTINCT user_id AS c_custkey, event_type FROM events)
SELECT u.c_custkey, u.event_type, sha256(u.c_custkey || chr(0) || u.event_type) AS unit_id FROM u ANTI JOIN x ON u.c_custkey = x.c_custkey AND u.event_type = x.event_type"""
)
def planned_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    excluded = events.select(F.col("user_id").alias("c_custkey"), "event_type").distinct()
    return R.planned_units(table(spark, sf_dir, "customer").select("c_custkey"), events.select("event_type").distinct(), excluded, on=["c_custkey", "event_type"], unit_id=nul_digest(F.col("c_custkey"), F.col("event_type")))


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' ELSE 'left' END AS side FROM (SELECT DISTINCT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def inventory_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.outer_differences(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query(
    """WITH a AS (SELECT o_custkey AS k, max(o_orderstatus) AS status FROM orders WHERE o_totalprice > 400000 GROUP BY o_custkey), b AS (SELECT o_custkey AS k, min(o_orderstatus) AS status FROM orders GROUP BY o_custkey)
SELECT c_custkey AS k, coalesce(a.status, b.status, 'none') AS status, CASE WHEN a.status IS NOT NULL THEN 'sequential' WHEN b.status IS NOT NULL THEN 'anchor' ELSE 'none' END AS basis FROM customer LEFT JOIN a ON c_custkey = a.k LEFT JOIN b ON c_custkey = b.k"""
)
def decision_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    first = orders.filter("o_totalprice > 400000").groupBy("k").agg(F.max("o_orderstatus").alias("status"))
    second = orders.groupBy("k").agg(F.min("o_orderstatus").alias("status"))
    return R.precedence(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), [("sequential", first), ("anchor", second)], key="k", value="status", default="none")


@query("SELECT l_orderkey, array_to_string(list_sort(list(l_linenumber)), ',') AS horizons FROM lineitem GROUP BY l_orderkey HAVING list_sort(list(l_linenumber)) <> [1, 2, 3, 4]")
def incomplete_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.missing_horizons(table(spark, sf_dir, "lineitem"), key="l_orderkey", horizon="l_linenumber", expected=[1, 2, 3, 4])
    return out.withColumn("horizons", F.array_join(F.col("horizons").cast("array<string>"), ","))


KEY = "sha256(c_mktsegment || chr(0) || c_nationkey || chr(0) || c_custkey)"


@query(
    f"""WITH c AS (SELECT *, {KEY} AS k, c_acctbal < 0 AS free FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey, free ORDER BY k) AS i FROM c)
SELECT c_custkey, c_mktsegment, c_nationkey FROM r WHERE free OR i <= 2"""
)
def capped_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.capped(table(spark, sf_dir, "customer"), strata=["c_mktsegment", "c_nationkey"], key=nul_digest(F.col("c_mktsegment"), F.col("c_nationkey"), F.col("c_custkey")), cap=2, exempt=F.col("c_acctbal") < 0)
    return out.select("c_custkey", "c_mktsegment", "c_nationkey")


@query(
    """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(source || chr(0) || doc_id)) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, round(least(7, n) / n, 6) AS inclusion, round(n / least(7, n), 6) AS weight FROM r WHERE i <= 7"""
)
def weighted_file_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    out = P.weighted_top(docs, by=["source"], key=nul_digest(F.col("source"), F.col("doc_id")), n=7)
    return out.select("doc_id", "source", r6(F.col("inclusion")).alias("inclusion"), r6(F.col("weight")).alias("weight"))


@query(
    """WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT c_custkey, c_nationkey FROM r WHERE n <= 7 OR i IN (SELECT floor(j * r.n / 7) FROM (SELECT unnest(range(7)) AS j))"""
)
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.stride(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), by=["c_nationkey"], order=["c_custkey"], k=7)


@query(
    """WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders), g AS (SELECT o_orderkey, o_custkey FROM r WHERE i <= 1),
t AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM r WHERE i > 1)
SELECT o_orderkey, o_custkey, 'group' AS picked FROM g UNION ALL SELECT o_orderkey, o_custkey, 'fill' FROM t WHERE place <= greatest(0, 2000 - (SELECT count(*) FROM g)) AND place <= 2000"""
)
def supplemented_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.supplemented(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), by="o_custkey", key="o_orderkey", per_group=1, total=2000)


@query(
    """WITH u AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey) AS u FROM orders),
c AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS c FROM u WHERE u = 1)
SELECT o_custkey, o_orderkey, o_orderstatus FROM c WHERE c <= 60"""
)
def adjudication_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.one_per_unit(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), unit="o_custkey", label="o_orderstatus", first="F", key="o_orderkey", per_class=60)


@query("SELECT o_orderkey FROM orders WHERE CAST(('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16)) AS UBIGINT) % 10000 < 500")
def audit_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(drawn(nul_digest(F.col("o_orderkey")), 500)).select("o_orderkey")


@query(
    """SELECT c_custkey, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 65), lambda i: CAST(('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), i, 1)) AS BIGINT))), lambda a, b: (a * 16 + b) % 7) AS fold FROM customer"""
)
def digest_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", digest_modulo(nul_digest(F.col("c_custkey")), 7).alias("fold"))


@query("SELECT o_custkey, (row_number() OVER (ORDER BY o_custkey) - 1) % 5 AS fold FROM (SELECT DISTINCT o_custkey FROM orders)")
def sorted_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sorted_folds(table(spark, sf_dir, "orders"), group="o_custkey", k=5).select("o_custkey", F.col("fold").cast("long").alias("fold"))


@query("SELECT lang, source, (row_number() OVER (PARTITION BY lang ORDER BY source) - 1) % 2 AS side FROM (SELECT DISTINCT lang, source FROM documents)")
def alternate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.alternate_split(table(spark, sf_dir, "documents"), stratum="lang", group="source").select("lang", "source", F.col("side").cast("long").alias("side"))


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n, CAST(least(count(*), 3, greatest(1, ceil(count(*) * 10 / 100))) AS INTEGER) AS size FROM customer GROUP BY c_nationkey, c_mktsegment")
def audit_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")).withColumn("size", P.audit_size(F.col("n")))


@query(
    """WITH q AS (SELECT o_custkey, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS q, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2)
SELECT o_custkey, CAST(q AS INTEGER) AS quarter, CAST(make_date(q // 4, q % 4 * 3 + 1, 1) AS VARCHAR) AS first_day, CAST(CAST(make_date(q // 4, q % 4 * 3 + 1, 1) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS VARCHAR) AS last_day, n, total FROM q"""
)
def quarter_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy("o_custkey", quarter_index(F.col("o_orderdate")).alias("quarter")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return per.select("o_custkey", "quarter", quarter_start(F.col("quarter")).cast("string").alias("first_day"), quarter_end(F.col("quarter")).cast("string").alias("last_day"), "n", "total")
