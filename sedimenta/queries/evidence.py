"""Joins of evidence over the test tables: customers as repositories, orders as changes, line items as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.functions import identity as I
from sedimenta.operators import evidence as V
from sedimenta.queries import query, r6, table


@query(
    "SELECT c_custkey, sha256(lower(c_mktsegment) || chr(0) || lower(trim(c_name)) || chr(0) || lower(c_name || '@' || c_mktsegment)) AS identity, sha256('{\"balance\":' || CAST(c_acctbal * 100 AS BIGINT) || ',\"name\":\"' || c_name || '\"}') AS record FROM customer"
)
def customer_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    cents = (F.col("c_acctbal") * 100).cast("decimal(20,4)")
    record = I.canonical_digest(("record_sha256",), name=name, balance=F.round(cents, 0).cast("long"), record_sha256=F.lit("own"))
    return table(spark, sf_dir, "customer").select("c_custkey", I.identity_hash(segment, F.concat(F.lit(" "), name), F.concat(name, F.lit("@"), segment)).alias("identity"), record.alias("record"))


@query(
    r"SELECT doc_id, lower(nfc_normalize(regexp_replace(trim(source), '\s+', ' ', 'g'))) AS name, lower(regexp_replace(source || ' @ ' || coalesce(lang, 'x'), '\s+', '', 'g')) AS email FROM documents"
)
def author_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", I.author_name(F.concat(F.lit("  "), F.col("source"))).alias("name"), I.author_email(F.concat("source", F.lit(" @ "), F.coalesce("lang", F.lit("x")))).alias("email"))


@query(
    """WITH l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 30 GROUP BY l_orderkey), o AS (SELECT o_orderkey AS k, o_orderkey % 4 + 1 AS n FROM orders WHERE o_orderstatus <> 'P')
SELECT coalesce(o.k, l.k) AS k, CASE WHEN o.k IS NULL THEN 'missing_left' WHEN l.k IS NULL THEN 'missing_right' WHEN o.n <> l.n THEN 'time_differs' END AS problem FROM o FULL JOIN l ON o.k = l.k"""
)
def joined_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 30").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 4 + 1).alias("n"))
    return V.one_to_one(orders, lines, key="k", at="n").select("k", "problem")


@query(
    """SELECT o_orderpriority, coalesce(x.status, 'pending') AS status, count(*) AS n FROM orders LEFT JOIN (SELECT l_orderkey, 'enriched' AS status FROM lineitem WHERE l_discount > 0.08 GROUP BY 1) x ON o_orderkey = l_orderkey GROUP BY 1, 2
UNION ALL SELECT 'unused', 'unused', count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_discount > 0.08 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))"""
)
def pending_enrichments(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k")
    found = table(spark, sf_dir, "lineitem").filter("l_discount > 0.08").select(F.col("l_orderkey").alias("k"), F.lit("enriched").alias("status")).distinct()
    out = V.with_pending(orders, found, on=["k"], status="status").groupBy("o_orderpriority", "status").agg(F.count("*").alias("n"))
    left = V.unused(orders.filter("o_orderstatus = 'F'"), found, on=["k"]).agg(F.lit("unused").alias("o_orderpriority"), F.lit("unused").alias("status"), F.count("*").alias("n"))
    return out.unionByName(left)


@query(
    """WITH m AS (SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem), e AS (SELECT l_partkey % 50 AS path, l_suppkey AS exact, min(l_quantity) AS value, count(*) AS n FROM lineitem WHERE l_tax < 0.001 AND l_quantity > 45 GROUP BY 1, 2),
p AS (SELECT path, sum(n) AS n, min(value) AS value FROM e GROUP BY path)
SELECT basis, count(*) AS n, round(sum(value), 2) AS value FROM (SELECT CASE WHEN e.n = 1 THEN 'exact' WHEN p.n = 1 THEN 'path' ELSE 'missing' END AS basis, CASE WHEN e.n = 1 THEN e.value WHEN p.n = 1 THEN p.value END AS value
  FROM lineitem l LEFT JOIN e ON l.l_partkey % 50 = e.path AND l.l_suppkey = e.exact LEFT JOIN p ON l.l_partkey % 50 = p.path) GROUP BY basis"""
)
def fallback_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("path"), F.col("l_suppkey").alias("exact"), "l_tax", "l_quantity")
    seen = lines.filter("l_tax < 0.001 and l_quantity > 45").withColumnRenamed("l_quantity", "value")
    out = V.fallback_match(lines.select("path", "exact"), seen.select("path", "exact", "value"), path="path", exact="exact", value="value")
    return out.groupBy("basis").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query(
    """SELECT l_suppkey, count(*) AS rows, count(DISTINCT l_linenumber) AS lines, count(*) = 4 * count(DISTINCT l_linenumber) AS complete FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) GROUP BY l_suppkey"""
)
def matched_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return V.kept_lines(table(spark, sf_dir, "lineitem"), keys, on=["l_suppkey"], line="l_linenumber", horizons=4)


@query(
    """WITH u AS (SELECT c_nationkey AS k, 'customer' AS f, c_custkey % 2 AS s FROM customer WHERE c_custkey < 60 UNION ALL SELECT s_nationkey, 'supplier', CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 1 END FROM supplier UNION ALL SELECT n_nationkey, 'nation', NULL FROM nation)
SELECT k, array_to_string(list_sort(list(DISTINCT f)), ',') AS frames, CASE WHEN min(s) = max(s) THEN min(s) END AS snapshot, coalesce(min(s) < max(s), false) AS conflict FROM u GROUP BY k"""
)
def frame_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").filter("c_custkey < 60").select(F.col("c_nationkey").alias("k"), (F.col("c_custkey") % 2).alias("s"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.when(F.col("s_suppkey") % 3 != 0, F.lit(1).cast("long")).alias("s"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.lit(None).cast("long").alias("s"))
    out = V.memberships({"customer": customers, "supplier": suppliers, "nation": nations}, key="k", snapshot="s")
    return out.withColumn("frames", F.array_join("frames", ","))


@query(
    """WITH b AS (SELECT o_orderkey AS k, o_totalprice AS v, o_orderstatus <> 'P' AS ok FROM orders WHERE o_orderkey % 10 < 8), r AS (SELECT o_orderkey AS k, -o_totalprice AS v FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus = 'P' OR o_orderkey % 97 = 0)
SELECT coalesce(b.k, r.k) AS k, round(CASE WHEN b.ok THEN b.v ELSE r.v END, 2) AS v, CASE WHEN b.ok THEN 'base' ELSE 'recovery' END AS basis, CASE WHEN b.k IS NULL THEN 'orphan' WHEN b.ok AND r.k IS NOT NULL THEN 'recovered_though_valid' WHEN NOT b.ok AND r.k IS NULL THEN 'missing_recovery' END AS problem FROM b FULL JOIN r ON b.k = r.k"""
)
def effective_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderkey": "k", "o_totalprice": "v"})
    recovered = orders.filter("k % 3 = 0 and o_orderstatus = 'P' or k % 97 = 0").select("k", (-F.col("v")).alias("v"))
    out = V.effective_units(orders.filter("k % 10 < 8").select("k", "v", "o_orderstatus"), recovered, key="k", valid=F.col("o_orderstatus") != "P", value="v")
    return out.withColumn("v", F.round("v", 2))


@query(
    """SELECT c_custkey, coalesce(array_to_string(ids, ','), '') AS candidates FROM customer LEFT JOIN (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS ids FROM orders WHERE o_totalprice > 400000 GROUP BY 1) ON c_custkey = o_custkey"""
)
def linked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    out = V.linked_candidates(table(spark, sf_dir, "customer").select("c_custkey"), big, key="c_custkey", candidate="o_orderpriority")
    return out.withColumn("candidates", F.array_join("candidates", ","))


@query(
    """WITH a AS (SELECT doc_id, CASE WHEN n_chars > 900 THEN 'good' ELSE 'bad' END AS answer FROM documents), b AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS truth FROM labels),
j AS (SELECT CASE WHEN a.doc_id IS NULL OR b.doc_id IS NULL THEN 'unpaired' ELSE answer END AS answer, answer = truth AS ok, a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AS paired FROM a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT answer, count(*) AS cases, count(*) FILTER (paired AND ok) AS "right", CASE WHEN answer <> 'unpaired' THEN round(count(*) FILTER (paired AND ok) / count(*), 6) END AS precision FROM j GROUP BY answer"""
)
def review_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 900, "good").otherwise("bad").alias("answer"))
    truths = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("truth"))
    return V.class_rates(answers, truths, key="doc_id", answer="answer", truth="truth").withColumn("precision", r6(F.col("precision")))


@query(
    """SELECT o_custkey, count(DISTINCT o_orderkey) AS items, CAST(sum(l_quantity) AS BIGINT) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY o_custkey HAVING sum(l_quantity) >= 200"""
)
def reachable_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    frame = orders.join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity"), "o_orderkey").drop("o_orderstatus")
    out = V.reachable(frame, orders, unit="o_custkey", item="o_orderkey", lines="l_quantity", ok=F.col("o_orderstatus") == "F", least=200)
    return out.withColumn("lines", F.col("lines").cast("long"))


@query(
    """WITH r AS (SELECT DISTINCT user_id, event_id FROM events), o AS (SELECT user_id, event_id, event_type, ts, value FROM events WHERE event_id % 7 <> 0)
SELECT r.user_id, CASE WHEN o.event_id IS NULL THEN 'missing' WHEN event_type = 'error' THEN 'not_merged' WHEN ts > TIMESTAMP '2024-01-20' THEN 'after_cutoff' WHEN value < 5 THEN 'too_small' ELSE 'eligible' END AS reason, count(*) AS n, min(r.event_id) AS first FROM r LEFT JOIN o ON r.user_id = o.user_id AND r.event_id = o.event_id GROUP BY 1, 2"""
)
def eligibility_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts", "value")
    rules = [(F.col("event_type") == "error", "not_merged"), (F.col("ts") > F.lit("2024-01-20").cast(events.schema["ts"].dataType), "after_cutoff"), (F.col("value") < 5, "too_small")]
    return V.reasons_by_unit(events, events.filter("event_id % 7 <> 0"), unit="user_id", item="event_id", rules=rules)


@query(
    """SELECT l_orderkey, count(DISTINCT l_linenumber) AS packets, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS families, count(DISTINCT l_suppkey % 3) = 1 AS consistent FROM lineitem GROUP BY l_orderkey"""
)
def event_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("meta", F.col("l_suppkey") % 3)
    return V.bundles(lines, key="l_orderkey", item="l_linenumber", same=["meta"], family="l_returnflag").withColumn("families", F.array_join("families", ","))


@query(
    """SELECT l_suppkey, l_returnflag, array_to_string(list_sort(list(DISTINCT l_linenumber + 1)), ',') AS lines, sha256(l_suppkey || chr(0) || l_returnflag || chr(0) || array_to_string(list_sort(list(DISTINCT l_linenumber + 1)), ',')) AS group_id FROM lineitem WHERE l_tax > 0.05 GROUP BY 1, 2"""
)
def pending_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.pending_groups(table(spark, sf_dir, "lineitem").filter("l_tax > 0.05"), keys=["l_suppkey", "l_returnflag"], line="l_linenumber")
    return out.withColumn("lines", F.array_join(F.col("lines").cast("array<string>"), ","))


@query(
    """SELECT p, CAST(sum(n) AS BIGINT) AS rows, count(*) AS "distinct", count(*) FILTER (c > 1) AS shared FROM (SELECT l_suppkey % 10 AS p, l_partkey, count(*) AS n, count(DISTINCT l_suppkey) AS c FROM lineitem GROUP BY 1, 2) GROUP BY p"""
)
def partition_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.overlaps(table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_suppkey") % 10), parent="p", child="l_suppkey", result="l_partkey")


@query(
    """SELECT f AS frame, count(*) AS expected, count(*) FILTER (k IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)) AS included FROM (SELECT DISTINCT c_mktsegment AS f, c_nationkey AS k FROM customer) GROUP BY f"""
)
def frame_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("frame"), F.col("c_nationkey").alias("k"))
    return V.frame_coverage(frames, table(spark, sf_dir, "supplier").filter("s_acctbal > 8000").select(F.col("s_nationkey").alias("k")), frame="frame", key="k")


@query(
    """SELECT u AS user_id, c AS event_id, l AS landing, p AS position FROM (SELECT user_id AS u, event_id AS c FROM events WHERE event_type <> 'click') LEFT JOIN
(SELECT a.user_id AS u, a.event_id AS c, min(b.event_id) AS l, min(b.event_id) AS p FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'click' AND b.event_id BETWEEN a.event_id AND a.event_id + 400 GROUP BY 1, 2) USING (u, c)"""
)
def landings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    clicks = events.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("container"), F.floor(F.col("event_id") / 400).alias("band"))
    # containers lie at most 400 events later, in the same band or the next
    near = events.withColumn("band", F.explode(F.array(F.floor(F.col("event_id") / 400), F.floor(F.col("event_id") / 400) + 1)))
    ancestry = near.join(clicks, ["user_id", "band"]).filter("container between event_id and event_id + 400").withColumn("position", F.col("container"))
    return V.landings(events.filter("event_type <> 'click'"), ancestry, repository="user_id", commit="event_id", position="position")


@query(
    """WITH a AS (SELECT user_id, min((ts, event_id)) AS m FROM events WHERE value > 80 GROUP BY user_id)
SELECT e.user_id, e.event_id, CAST(row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS INTEGER) AS position FROM events e JOIN a ON e.user_id = a.user_id WHERE (e.ts, e.event_id) <= a.m"""
)
def candidate_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return V.candidate_sequence(events, by="user_id", order=["ts", "event_id"], anchor=F.col("value") > 80).select("user_id", "event_id", "position")


@query(
    """WITH e AS (SELECT o_custkey AS k, min(o_orderkey) AS decision FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), t AS (SELECT o_custkey AS k, min(o_orderkey) AS decision FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT k, decision, 1 AS tranche, false AS rejected FROM e UNION ALL SELECT k, decision, 2, k IN (SELECT k FROM e) FROM t"""
)
def decision_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = lambda s: table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("decision"))
    return V.ledger(per("F").withColumn("tranche", F.lit(1)), per("O"), key="k", number=2)


@query(
    """WITH RECURSIVE c AS (SELECT user_id AS u, event_id AS c, event_type AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
b AS (SELECT *, CASE WHEN k % 5 < 3 THEN 0 ELSE k % 5 - 2 END AS b FROM c),
l AS (SELECT *, max(k) FILTER (b = 0) OVER w AS k0, max(k) FILTER (b = 1) OVER w AS k1, max(k) FILTER (b = 2) OVER w AS k2 FROM b WINDOW w AS (PARTITION BY u ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT u, k, CASE b WHEN 0 THEN k0 WHEN 1 THEN k1 ELSE k2 END AS p FROM l UNION ALL SELECT u, k, k1 FROM l WHERE b = 0 AND e = 'click' UNION ALL SELECT u, k, k2 FROM l WHERE b = 1 AND e = 'view' UNION ALL SELECT u, k, k1 FROM l WHERE b = 2 AND e = 'error'),
m AS (SELECT u, k, c, row_number() OVER (PARTITION BY u ORDER BY k) - 1 AS position FROM b WHERE b = 0),
r AS (SELECT u, k, position FROM m UNION SELECT r.u, e.p, r.position FROM r JOIN e ON e.u = r.u AND e.k = r.k WHERE e.p IS NOT NULL),
f AS (SELECT u, k, min(position) AS position FROM r GROUP BY u, k)
SELECT b.u AS user_id, b.c AS event_id, m.c AS landing, f.position FROM b LEFT JOIN f ON f.u = b.u AND f.k = b.k LEFT JOIN m ON m.u = f.u AND m.position = f.position"""
)
def graph_landings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every event of a user lands on the main line, of three branches that merge each other; events stand for commits."""
    from sedimenta.operators import graph

    run = W.partitionBy("u").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    k, b, e = F.col("k"), F.col("b"), F.col("e")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("u"), F.col("event_id").alias("c"), F.col("event_type").alias("e"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("k"))
    own = events.withColumn("b", F.when(k % 5 < 3, 0).otherwise(k % 5 - 2))
    last = own.select("u", "c", "e", "b", *[F.max_by(F.when(b == i, F.col("c")), F.when(b == i, k)).over(run).alias(f"c{i}") for i in range(3)])
    first = F.when(b == 0, F.col("c0")).when(b == 1, F.col("c1")).otherwise(F.col("c2"))
    second = F.when((b == 0) & (e == "click"), F.col("c1")).when((b == 1) & (e == "view"), F.col("c2")).when((b == 2) & (e == "error"), F.col("c1"))
    parents = last.select(F.col("u").alias("repository"), F.col("c").alias("commit"), F.posexplode(F.array(first, second)).alias("number", "parent"))
    heads = own.filter("b = 0").groupBy(F.col("u").alias("repository")).agg(F.max_by("c", "k").alias("commit"))
    out = graph.landings(parents, heads)
    return out.select(F.col("repository").alias("user_id"), F.col("commit").alias("event_id"), "landing", "position")


@query(
    """WITH g AS (SELECT l_suppkey, l_returnflag, list(DISTINCT l_linenumber) AS lines, min(l_linestatus) AS mode FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_returnflag, mode, unnest(lines) AS line FROM g"""
)
def expanded_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line status of a supplier and flag, for each line number it has."""
    groups = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.collect_set("l_linenumber").alias("lines"), F.min("l_linestatus").alias("mode"))
    return V.expanded(groups, members="lines", member="line")
