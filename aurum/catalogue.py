"""Every registered query of the mastering engine, with the SQL that checks it.

The driver's tables stand in for the engine's: events are a change log (user_id the entity, event_type the path), documents and
labels two sources of golden entities, customer entities with alternate keys, orders references and their promises."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .operators import history as H, lifecycle as L, merge as M, predicates as C, query as Q, references as P, resolve as R, rules as U, writes as X
from .plans.expression import evaluate
from .sources.files import data_table

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "first_time_merge"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


KEYS_SQL = """SELECT c_custkey, unnest([{'Key': 'crm.customer', 'Value': CAST(c_custkey AS VARCHAR)}, {'Key': 'erp.' || lower(c_mktsegment), 'Value': c_name}, {'Key': 'crm.nation', 'Value': CAST(c_nationkey AS VARCHAR)}]) AS k FROM customer"""


def customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers with three alternate keys each."""
    keys = F.array(
        F.struct(F.lit("crm.customer").alias("Key"), F.col("c_custkey").cast("string").alias("Value")),
        F.struct(F.concat(F.lit("erp."), F.lower("c_mktsegment")).alias("Key"), F.col("c_name").alias("Value")),
        F.struct(F.lit("crm.nation").alias("Key"), F.col("c_nationkey").cast("string").alias("Value")),
    )
    return read(spark, d, "customer").withColumn("alternateKeys", keys)


def keys_of(rows: DataFrame) -> DataFrame:
    return Q.alternate_keys(rows, "c_custkey")


@query('SELECT event_type AS "EntityType", count(*) AS "Count" FROM events GROUP BY 1')
def entity_type_counts(spark, d):
    return Q.type_counts(read(spark, d, "events"), "event_type")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000 ORDER BY o_totalprice, o_orderkey LIMIT 100")
def entities_where_page(spark, d):
    return Q.entities_where(read(spark, d, "orders"), "x.o_orderstatus = :status AND x.o_totalprice > :least", "x.o_orderkey, x.o_totalprice, x.o_orderstatus", "x.o_totalprice", 100, None, {"status": "O", "least": 1000}, "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 97 <> 0 THEN o_totalprice END AS price, coalesce(o_orderstatus, 'x') AS status FROM orders ORDER BY price NULLS FIRST, o_orderkey LIMIT 200 OFFSET 10")
def entities_next_page(spark, d):
    """The page behind a row whose sort key is null, over a key that some rows lack."""
    rows = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 97 != 0, F.col("o_totalprice")).alias("price"), "o_orderstatus")
    last = Q.entities_where(rows, None, None, "price", 10, None, None, "o_orderkey").select("o_orderkey", "price").tail(1)[0].asDict()
    return Q.entities_where(rows, None, "o_orderkey, price, coalesce(o_orderstatus, 'x') AS status", "price", 200, Q.next_token(last, "price", "o_orderkey"), None, "o_orderkey")


@query("SELECT event_id, ts, user_id FROM events WHERE ts >= (SELECT min(ts) + INTERVAL 1 DAY FROM events)")
def entities_updated_since(spark, d):
    events = read(spark, d, "events")
    since = events.agg(F.min("ts")).first()[0]
    return Q.updated_since(events, F.lit(since) + F.expr("interval 1 day"), "ts", "event_id").select("event_id", "ts", "user_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def entities_by_id(spark, d):
    ids = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return Q.by_ids(read(spark, d, "orders"), ids, "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT count(*) AS total FROM customer WHERE lower(c_mktsegment) = 'building'")
def entities_total_count(spark, d):
    return Q.total_count(read(spark, d, "customer"), "lower(x.c_mktsegment) = :segment", {"segment": "building"})


@query(f'SELECT c_custkey, k.Key AS "Key", k.Value AS "Value" FROM ({KEYS_SQL})')
def alternate_keys_unnest(spark, d):
    return keys_of(customers(spark, d))


@query("SELECT c_custkey, c_name FROM customer WHERE CAST(c_nationkey AS VARCHAR) = '7'")
def entities_with_alternate_key(spark, d):
    return Q.with_alternate_key(customers(spark, d), "crm.nation", "7").select("c_custkey", "c_name")


@query(f"""SELECT c_custkey, k.Key AS "Key", k.Value AS "Value" FROM ({KEYS_SQL}) WHERE (k.Key = 'crm.nation' AND k.Value IN ('3','5')) OR (k.Key = 'crm.customer' AND k.Value = '12')""")
def entities_by_alternate_keys(spark, d):
    wanted = spark.createDataFrame([("crm.nation", "3"), ("crm.nation", "5"), ("crm.customer", "12"), ("crm.nation", "5")], "Key string, Value string")
    return Q.by_alternate_keys(customers(spark, d), wanted, "c_custkey").select("c_custkey", "Key", "Value")


@query("""SELECT d.event_id, d.event_type, d.value FROM events d WHERE d.event_type = 'error' AND d.value > 10 AND d.event_id <> 5""")
def log_failures_where(spark, d):
    logs = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("Type"), F.struct("value").alias("Data"))
    got = Q.log_where(logs, "error", "x.value > 10 AND x.Id <> 5", ["value"])
    return got.select(F.col("id").alias("event_id"), F.col("Type").alias("event_type"), F.col("Data.value").alias("value"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 42)")
def trace_correlated(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("OperationId"), F.col("l_partkey").cast("string").alias("CorrelationId"), F.col("l_shipdate").alias("TimeGenerated"), "l_linenumber", "l_returnflag")
    got = Q.trace([("returned", rows.where("l_returnflag = 'R'")), ("other", rows.where("l_returnflag != 'R'"))], "42", 1_000_000, 1_000_000)
    return got.select(F.col("OperationId").alias("l_orderkey"), "l_linenumber", F.col("CorrelationId").cast("long").alias("l_partkey"), "l_returnflag")


@query("""WITH t AS (SELECT 'r' || r_regionkey AS id, 0 AS depth, r_regionkey AS a, -1 AS b, -1 AS c FROM region
 UNION ALL SELECT 'n' || n_nationkey, 1, n_regionkey, n_nationkey, -1 FROM nation
 UNION ALL SELECT 's' || s_suppkey, 2, n_regionkey, n_nationkey, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT 'o' || c_custkey, 0, 1000000, c_custkey, -1 FROM customer WHERE c_custkey < 20)
 SELECT id, depth, row_number() OVER (ORDER BY a, b, c) AS ordinal FROM t""")
def trace_span_tree(spark, d):
    """Regions are roots, nations their children, suppliers theirs; a few customers are spans without a parent."""
    region = read(spark, d, "region").selectExpr("concat('r', r_regionkey) AS id", "CAST(NULL AS STRING) AS parent", "CAST(r_regionkey AS BIGINT) AS start", "r_name AS name")
    nation = read(spark, d, "nation").selectExpr("concat('n', n_nationkey) AS id", "concat('r', n_regionkey) AS parent", "CAST(n_nationkey AS BIGINT) AS start", "n_name AS name")
    supplier = read(spark, d, "supplier").selectExpr("concat('s', s_suppkey) AS id", "concat('n', s_nationkey) AS parent", "CAST(s_suppkey AS BIGINT) AS start", "s_name AS name")
    orphan = read(spark, d, "customer").where("c_custkey < 20").selectExpr("concat('o', c_custkey) AS id", "'gone' AS parent", "CAST(c_custkey AS BIGINT) AS start", "c_name AS name")
    return Q.span_tree(region.union(nation).union(supplier).union(orphan)).select("id", "depth", F.col("ordinal").cast("long").alias("ordinal"))


@query("SELECT DISTINCT source AS \"DataSource\", lang AS \"EntityType\" FROM documents WHERE trim(source) <> '' AND trim(lang) <> ''")
def tracked_identities(spark, d):
    return Q.identities(read(spark, d, "documents").select(F.col("source").alias("DataSource"), F.col("lang").alias("EntityType")))


@query("SELECT event_type, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def marker_latest(spark, d):
    return Q.latest_markers(read(spark, d, "events").select("event_type", "event_id", "ts"), ["event_type"], "ts").select("event_type", "event_id", "ts")


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 100000) AND ((o_orderpriority = '1-URGENT' AND NOT (o_totalprice < 50000)) OR (NOT (o_orderpriority = '1-URGENT') AND o_totalprice < 50000)) ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 50""")
def virtual_table_page(spark, d):
    where = {"and": [{"or": [{"property": "o_orderstatus", "operator": "eq", "value": "F"}, {"property": "o_totalprice", "operator": "gt", "value": 100000}]}, {"xor": [{"property": "o_orderpriority", "operator": "eq", "value": "1-URGENT"}, {"property": "o_totalprice", "operator": "lt", "value": 50000}]}]}
    return evaluate(read(spark, d, "orders"), {"columns": ["o_orderkey", "o_custkey", "o_totalprice"], "where": where, "orders": [("o_totalprice", True), ("o_orderkey", False)], "page": (2, 50)})


@query("""WITH refs AS (SELECT DISTINCT lang AS e, source AS k, CAST(length(text) % 50 AS VARCHAR) AS v FROM documents),
 keys AS (SELECT lang AS e, source AS k, CAST(doc_id % 50 AS VARCHAR) AS v, doc_id AS id FROM documents)
 SELECT r.e AS "EntityType", r.k AS "Key", r.v AS "Value", count(DISTINCT id) AS matches, min(id) AS resolved FROM refs r LEFT JOIN keys USING (e, k, v) GROUP BY ALL""")
def resolve_references(spark, d):
    docs = read(spark, d, "documents")
    refs = docs.select(F.col("lang").alias("EntityType"), F.col("source").alias("Key"), (F.char_length("text") % 50).cast("string").alias("Value"))
    keys = docs.select(F.col("lang").alias("EntityType"), F.col("source").alias("Key"), (F.col("doc_id") % 50).cast("string").alias("Value"), F.col("doc_id").alias("EntityId"))
    return R.resolve_references(refs, keys)


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'new' ELSE 'existing' END AS state, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def new_vs_existing(spark, d):
    new, old = R.split_new(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), ["doc_id"])
    both = new.withColumn("state", F.lit("new")).unionByName(old.withColumn("state", F.lit("existing")))
    return both.groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, count(DISTINCT (l_suppkey, l_partkey)) AS sources FROM lineitem GROUP BY 1 HAVING count(DISTINCT (l_suppkey, l_partkey)) > 1")
def merge_conflicts(spark, d):
    return R.merge_conflicts(read(spark, d, "lineitem"), "l_orderkey", ["l_suppkey", "l_partkey"])


@query("""WITH p AS (SELECT o_orderkey, o_custkey, CAST(o_custkey % 30 AS INT) AS ref FROM orders),
 o AS (SELECT c_custkey, CAST(c_custkey % 30 AS INT) AS at_path, [CAST(c_nationkey AS INT), CAST(c_custkey % 30 AS INT)] AS refs FROM customer WHERE c_acctbal > 0),
 t AS (SELECT n_nationkey AS ref, count(*) AS n, min(n_name) AS target FROM nation WHERE n_nationkey <> 3 GROUP BY 1)
 SELECT o_orderkey AS promise, CASE WHEN c_custkey IS NULL THEN 'Stale' WHEN at_path <> p.ref AND list_contains(refs, p.ref) THEN 'Unresolved' WHEN at_path <> p.ref THEN 'Stale' WHEN n IS NULL THEN 'Unresolved' WHEN n > 1 THEN 'Failed' ELSE 'Resolved' END AS status,
 CASE WHEN c_custkey IS NOT NULL AND n = 1 THEN target END AS target
 FROM p LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN t ON p.ref = t.ref""")
def promise_status(spark, d):
    promises = read(spark, d, "orders").select(F.col("o_orderkey").alias("promise"), F.col("o_custkey").alias("owner"), (F.col("o_custkey") % 30).cast("int").alias("ref"), F.lit("nation").alias("path"))
    at = (F.col("c_custkey") % 30).cast("int")
    owners = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("owner"), at.alias("ref_at_path"), F.array(F.col("c_nationkey").cast("int"), at).alias("refs"))
    targets = read(spark, d, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").cast("int").alias("ref"), F.col("n_name").alias("target"))
    return R.settle_promises(promises, owners, targets)


@query("""SELECT a.doc_id, CASE WHEN arg_max(b.doc_id % 7 = 0, b.doc_id) THEN NULL ELSE max(b.doc_id) END AS match FROM documents a JOIN documents b ON lower(a.text) = lower(b.text) AND a.lang = b.lang GROUP BY 1""")
def duplicate_match(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text", "lang")
    return R.block_match(docs, docs, [("text", True), ("lang", False)], "doc_id", "doc_id", "doc_id", F.col("best.doc_id") % 7 == 0)


@query("""SELECT event_id, CASE WHEN value > 50 THEN 'RejectMerge' WHEN event_type = 'error' THEN 'SilentlyReject' WHEN user_id % 2 = 0 THEN 'AllowMerge' END AS action FROM events""")
def premerge_outcome(spark, d):
    action = U.pre_merge_action([("value > 50", "RejectMerge"), ("event_type = 'error'", "SilentlyReject"), ("user_id % 2 = 0", "AllowMerge")])
    return read(spark, d, "events").select("event_id", action.alias("action"))


@query("""WITH r(rule, idx, ds, st, cx) AS (VALUES ('any', 0, '*', '*', '*'), ('click', 1, '*', 'CLICK', '*'), ('even', 2, 'EVEN', '*', '*'), ('evenview', 3, 'even', 'view', '*'), ('any2', 4, '*', '*', '*')),
 e AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'Even' ELSE 'Odd' END AS ds, event_type AS st FROM events),
 s AS (SELECT event_id, rule, idx, CASE WHEN r.ds <> '*' THEN 4 ELSE 0 END + CASE WHEN r.st <> '*' THEN 2 ELSE 0 END AS score FROM e JOIN r ON (r.ds = '*' OR lower(r.ds) = lower(e.ds)) AND (r.st = '*' OR lower(r.st) = lower(e.st)))
 SELECT event_id, rule, score FROM s QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY score DESC, idx) = 1""")
def merge_rule_select(spark, d):
    rules = spark.createDataFrame([("any", 0, "*", "*", "*"), ("click", 1, "*", "CLICK", "*"), ("even", 2, "EVEN", "*", "*"), ("evenview", 3, "even", "view", "*"), ("any2", 4, "*", "*", "*")], "rule string, idx int, data_source string, source_entity_type string, context string")
    events = read(spark, d, "events").select("event_id", F.when(F.col("user_id") % 2 == 0, "Even").otherwise("Odd").alias("data_source"), F.col("event_type").alias("source_entity_type"), F.lit("MergeUpdatedEntity").alias("context"))
    return U.select_merge_rules(events, rules, ["event_id"])


@query("""SELECT p_partkey, CASE WHEN lower(p_brand) = 'brand#13' AND p_type = 'SMALL' THEN 'ITEM.brand#13.small' WHEN lower(p_brand) = 'brand#13' THEN 'Item.Brand#13' WHEN p_size % 2 = 0 THEN 'Item' ELSE '*' END AS rule FROM part""")
def property_rule_resolve(spark, d):
    """Paths of brand, type and a leaf below an item, or below something else where the size is odd."""
    rules = spark.createDataFrame([(0, "*", "a"), (1, "Item", "b"), (2, "Item.Brand#13", "c"), (3, "ITEM.brand#13.small", "d"), (4, "item", "e"), (5, "Other.Brand#13.SMALL", "f"), (6, "Other.Brand#13", "g")], "idx int, name string, action string")
    top = F.when((F.col("p_size") % 2 == 0) | (F.lower("p_brand") == "brand#13"), "iTem").otherwise("Itemised")
    parts = read(spark, d, "part").select("p_partkey", F.concat_ws(".", top, "p_brand", "p_type", F.lit("Weight")).alias("path"))
    found = U.resolve_property_rules(parts.select("path").distinct(), rules)
    return parts.join(found, "path").select("p_partkey", "rule")


@query("""SELECT event_id, action, CASE action WHEN 'AlwaysOverwrite' THEN true WHEN 'OverwriteIfNewer' THEN NOT (user_id % 10 > event_id % 10) WHEN 'OverwriteIfEmpty' THEN user_id % 3 = 0 WHEN 'OverwriteIfNotEmpty' THEN true WHEN 'NeverOverwrite' THEN false WHEN 'DoNotUpdate' THEN false ELSE true END AS applies
 FROM (SELECT *, ['AlwaysOverwrite','OverwriteIfNewer','OverwriteIfEmpty','OverwriteIfNotEmpty','NeverOverwrite','DoNotUpdate',NULL][1 + event_id % 7] AS action FROM events)""")
def property_actions(spark, d):
    names = F.array(*[F.lit(a) for a in U.ACTIONS], F.lit(None).cast("string"))
    rows = read(spark, d, "events").withColumn("action", F.get(names, (F.col("event_id") % 7).cast("int")))
    old = F.when(F.col("user_id") % 3 != 0, F.col("user_id"))
    return rows.select("event_id", "action", U.action_allows(F.col("action"), old, F.col("value"), F.col("user_id") % 10, F.col("event_id") % 10, F.lit(False)).alias("applies"))


@query("""SELECT d.doc_id, d.lang, CASE WHEN l.doc_id IS NULL THEN d.n_chars ELSE coalesce(l.quality, d.n_chars) END AS n_chars, coalesce(d.source, CAST(l.toxic AS VARCHAR)) AS source,
 CASE WHEN l.doc_id IS NULL THEN 'New Entity Created' ELSE 'Entity Matched And Updated' END AS outcome FROM documents d LEFT JOIN labels l USING (doc_id)""")
def first_time_merge(spark, d):
    target = read(spark, d, "documents").select("doc_id", "lang", "n_chars", "source")
    source = read(spark, d, "labels").select("doc_id", F.lit("xx").alias("lang"), F.col("quality").cast("long").alias("n_chars"), F.col("toxic").cast("string").alias("source"))
    return M.first_time_merge(target, source, "doc_id", {"lang": None, "n_chars": "AlwaysOverwrite", "source": "OverwriteIfEmpty"})


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events")
def version_order(spark, d):
    return Q.version_order(read(spark, d, "events"), ["user_id"], "ts", "event_id").select("event_id", "user_id", F.col("version").cast("long").alias("version"))


@query("SELECT event_id, user_id, event_type, value, old FROM (SELECT *, lag(value) OVER w AS old, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE value IS DISTINCT FROM old OR n = 1")
def change_delta(spark, d):
    return H.change_deltas(read(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value").select("event_id", "user_id", "event_type", "value", "old")


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def replay_current(spark, d):
    return H.replay_leaves(read(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value")


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_id <= 5000 GROUP BY 1, 2")
def replay_asof(spark, d):
    return H.replay_leaves(read(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value", F.col("event_id") <= 5000)


@query("""SELECT user_id, event_type, current, reverted FROM (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS current, arg_max(value, (ts, event_id)) FILTER (WHERE event_id <= 5000) AS reverted FROM events GROUP BY 1, 2) WHERE current IS DISTINCT FROM reverted""")
def revert_diff(spark, d):
    return H.revert_deltas(read(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value", F.col("event_id") <= 5000)


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) FILTER (WHERE event_id <= 5000) AS baseline, count(*) FILTER (WHERE event_id <= 5000) AS archived, count(*) FILTER (WHERE NOT event_id <= 5000) AS kept FROM events GROUP BY 1, 2")
def rebase_compaction(spark, d):
    return H.compaction(read(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value", F.col("event_id") <= 5000)


@query("SELECT l_orderkey, min(l_shipdate) AS conflict_at FROM (SELECT l_orderkey, l_shipdate FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) > 1) GROUP BY 1")
def baseline_conflicts(spark, d):
    return H.baseline_conflicts(read(spark, d, "lineitem"), ["l_orderkey"], "l_shipdate", "l_suppkey")


@query("SELECT CAST(user_id AS VARCHAR) AS \"EntityId\", CAST(arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'click') AS DOUBLE) AS click, max(event_id) AS last_event FROM events GROUP BY 1")
def replay_documents(spark, d):
    """The strict fold of JSON deltas, one Init and then an Update for each event."""
    events = read(spark, d, "events")
    inits = events.groupBy("user_id").agg(F.min("ts").alias("ts")).select("user_id", F.col("ts").alias("Timestamp"), F.lit("Init").alias("EntryType"), F.lit("{}").alias("Data"), F.lit(0).cast("long").alias("_ts"), F.lit("").alias("id"))
    data = F.concat(F.lit('{"'), F.col("event_type"), F.lit('":['), F.to_json(F.array("value")).substr(F.lit(2), F.length(F.to_json(F.array("value"))) - 2), F.lit('],"last":['), F.col("event_id").cast("string"), F.lit("]}"))
    updates = events.select("user_id", F.col("ts").alias("Timestamp"), F.lit("Update").alias("EntryType"), data.alias("Data"), (F.col("event_id") + 1).alias("_ts"), F.col("event_id").cast("string").alias("id"))
    log = inits.unionByName(updates).withColumn("Timestamp", F.col("Timestamp").cast("timestamp")).withColumn("EntityId", F.col("user_id").cast("string")).withColumn("DataSource", F.lit("Events")).withColumn("EntityType", F.lit("User")).drop("user_id")
    got = H.replay_documents(log)
    return got.select("EntityId", F.get_json_object("state", "$.click").cast("double").alias("click"), F.get_json_object("state", "$.last").cast("long").alias("last_event"))


@query("SELECT c_custkey, regexp_replace(c_name, 'Customer', 'Client', 'g') AS name, 0 AS failures FROM customer")
def patch_documents(spark, d):
    docs = read(spark, d, "customer").select("c_custkey", F.to_json(F.struct("c_name", "c_mktsegment")).alias("doc"))
    ops = [{"Operation": "set", "Path": "c_name", "Regex": "Customer", "Value": "Client"}, {"Operation": "add", "Path": "extra.level", "Value": 1}, {"Operation": "remove", "Path": "c_mktsegment"}]
    return X.patch_documents(docs, ops, "c_custkey").select("c_custkey", F.get_json_object("doc", "$.c_name").alias("name"), F.size("errors").alias("failures"))


@query(f"""SELECT c_custkey, count(*) AS keys FROM ({KEYS_SQL}) WHERE NOT starts_with(lower(k.Key), 'crm.') GROUP BY 1""")
def detach_source(spark, d):
    return customers(spark, d).select("c_custkey", F.size(X.detach(F.col("alternateKeys"), "CRM")).cast("long").alias("keys"))


@query(f"""SELECT c_custkey, 'crm.nation' AS "Key", 'n' || c_nationkey AS "Value" FROM customer UNION ALL SELECT c_custkey, k.Key, k.Value FROM ({KEYS_SQL}) WHERE k.Key <> 'crm.nation'""")
def register_alternate_key(spark, d):
    new = X.register_key(F.col("alternateKeys"), F.lit("crm.nation"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), replace=True)
    return keys_of(customers(spark, d).withColumn("alternateKeys", new))


@query(f"""SELECT CASE WHEN c_custkey = 7 AND k.Key = 'crm.customer' THEN -1 ELSE c_custkey END AS c_custkey, k.Key AS "Key", k.Value AS "Value" FROM ({KEYS_SQL})""")
def split_alternate_key(spark, d):
    """Customer 7 gets a second key of the same value first, so that the split is allowed; that key is left out of the result."""
    twin = F.struct(F.lit("web.customer").alias("Key"), F.lit("7").alias("Value"))
    rows = customers(spark, d).withColumn("alternateKeys", F.when(F.col("c_custkey") == 7, F.array_append("alternateKeys", twin)).otherwise(F.col("alternateKeys")))
    got = X.split_key(rows.withColumn("c_custkey", F.col("c_custkey").cast("long")), "crm.customer", "7", "-1", "c_custkey")
    return keys_of(got.withColumn("c_custkey", F.col("c_custkey").cast("long"))).where("Key != 'web.customer'")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 AND p_partkey % 20 = 0 THEN 'changed' ELSE p_name END AS p_name FROM part UNION ALL SELECT p_partkey + 10000000, 'changed' FROM part WHERE p_partkey % 50 = 0""")
def import_upsert(spark, d):
    part = read(spark, d, "part").select("p_partkey", "p_name")
    changed = part.where("p_partkey % 10 = 0").select("p_partkey", F.lit("changed").alias("p_name"), (F.col("p_partkey") % 20 == 0).alias("overwrite"))
    fresh = part.where("p_partkey % 50 = 0").select((F.col("p_partkey") + 10000000).alias("p_partkey"), F.lit("changed").alias("p_name"), F.lit(False).alias("overwrite"))
    return X.import_entities(part, changed.unionByName(fresh), ["p_partkey"], overwrite=True)


@query("SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'Entity already exists' END AS error FROM documents d LEFT JOIN labels l USING (doc_id)")
def create_entities(spark, d):
    return X.create_only(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), ["doc_id"])


@query("SELECT n_nationkey, NULL AS error FROM nation WHERE n_nationkey % 2 = 1 UNION ALL SELECT * FROM (VALUES (900, 'Key not found'), (902, 'Key not found')) t")
def delete_entities(spark, d):
    nation = read(spark, d, "nation")
    ids = nation.where("n_nationkey % 2 = 0").select("n_nationkey").unionByName(spark.createDataFrame([(900,), (902,)], "n_nationkey int"))
    left, missing = X.delete_entities(nation, ids, "n_nationkey")
    return left.select("n_nationkey", F.lit(None).cast("string").alias("error")).unionByName(missing)


@query("SELECT o_orderkey, o_orderstatus, 100 + 5 * (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) AS number, 'N-' || lpad(CAST(100 + 5 * (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) AS VARCHAR), 8, '0') || '/x' AS text FROM orders")
def auto_numbers(spark, d):
    return X.auto_numbers(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], ["o_orderkey"], start=100, step=5, prefix="N-", suffix="/x", padding=8)


@query("""SELECT event_id, event_type FROM events WHERE event_type = 'error' AND event_id <= 3000 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id > 3000) UNION ALL SELECT event_id, event_type FROM events WHERE event_id > 3000 AND event_type = 'error'""")
def failure_log_latest(spark, d):
    events = read(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") == "error", M.FAILED).otherwise(M.UPDATED).alias("Outcome"))
    before = events.where("event_id <= 3000").where(F.col("Outcome") == M.FAILED)
    return M.failure_log(before, events.where("event_id > 3000"), ["user_id"]).select("event_id", F.lit("error").alias("event_type"))


@query("SELECT source, lang, count(DISTINCT doc_id) AS ids, min(doc_id) AS first_id, 'Ready' AS status FROM documents GROUP BY 1, 2")
def retry_failures(spark, d):
    return X.retry_failures(read(spark, d, "documents"), ["source", "lang"], "doc_id").select("source", "lang", "ids", "first_id", "status")


@query("SELECT count(*) AS \"Matched\", count(*) FILTER (WHERE o_orderpriority <> '1-URGENT') AS \"Updated\" FROM orders WHERE o_orderstatus = 'P'")
def bulk_update_preview(spark, d):
    return X.bulk_update(read(spark, d, "orders"), F.col("o_orderstatus") == "P", "o_orderpriority", F.lit("1-URGENT"), dry_run=True)[1]


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 5 = 4 THEN NULL WHEN c_nationkey % 5 = 0 THEN 'merge,read' ELSE 'read' END AS permissions FROM customer""")
def user_permissions(spark, d):
    names = F.array(F.when(F.col("c_nationkey") % 5 == 0, "admin").when(F.col("c_nationkey") % 5 == 4, "ghost").otherwise("reader"), F.lit("reader"))
    users = read(spark, d, "customer").select(F.col("c_custkey").alias("user"), names.alias("roles"))
    roles = spark.createDataFrame([("admin", ["read", "merge"]), ("reader", ["read"])], "role string, permissions array<string>")
    return X.effective_permissions(users, roles).select(F.col("user").alias("c_custkey"), F.array_join("permissions", ",").alias("permissions"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path_read(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT coalesce(json_extract_string(props, '$.k'), '') AS k, coalesce(json_extract_string(props, '$.none'), '') AS none FROM events")
def entities_data_table(spark, d):
    return data_table(read(spark, d, "events"), ["k", "none"], "props")


@query("SELECT o_orderkey, o_orderstatus, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def entity_document(spark, d):
    """An order with its nested lines; an order bounds its lines."""
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("BookingLines"))
    text = F.array_join(F.transform("BookingLines", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",")
    return read(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderstatus", text.alias("lines"))


@query("SELECT CAST(user_id AS VARCHAR) AS \"EntityId\", CASE WHEN n = 1 THEN 'New Entity Created' ELSE 'Entity Matched And Updated' END AS outcome FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)")
def merge_batch(spark, d):
    """The tracked fold: each event is a version of its user with a counter that always changes."""
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    data = F.to_json(F.struct(F.col("event_id").alias("Counter"), F.col("event_type").alias("Kind"), at.alias("createdOn"), at.alias("lastUpdated")))
    events = read(spark, d, "events")
    requests = events.select(F.col("user_id").cast("string").alias("EntityId"), F.lit("User").alias("EntityType"), F.lit("Web").alias("DataSource"), F.lit("Visitor").alias("SourceEntityType"), F.col("user_id").cast("string").alias("SourceEntityId"), "ts", F.col("event_id").alias("ord"), data.alias("Data"))
    stored = spark.createDataFrame([], "EntityId string, doc string")
    got = M.merge_batch(requests, stored, [{"name": "*", "action": "AlwaysOverwrite"}], datetime(2030, 1, 1))
    return got.where("kind = 'result'").select("EntityId", F.get_json_object("payload", "$.Outcome").alias("outcome"))


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def stream_merge(spark, d):
    from .streaming.streams import latest_values

    events = read(spark, d, "events")
    base = scratch(spark)
    folder = f"{base}/in"
    events.write.parquet(folder)
    return latest_values(spark, folder, events.schema, f"{base}/state", f"{base}/checkpoint", ["user_id", "event_type"], ["ts", "event_id"], "value").select("user_id", "event_type", "value")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, d):
    from .streaming.streams import windowed_counts

    events = read(spark, d, "events")
    folder = f"{scratch(spark)}/in"
    events.write.parquet(folder)
    return windowed_counts(spark, folder, events.schema, "ts", "event_type", "1 day", "1 hour", f"{scratch(spark)}/windows")


@query("""SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) WHERE before IS NULL OR ts - before >= INTERVAL 1 HOUR GROUP BY 1""")
def session_counts(spark, d):
    rows = read(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return rows.groupBy("user_id", F.session_window("at", "1 hour")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"))


VERSIONS = """v AS (SELECT user_id, event_id, ts, event_type, event_id % 2 AS src, event_id % 3 AS x FROM events)"""


def versions(events: DataFrame, data: list[Column], source: Column) -> DataFrame:
    """Events as merge requests of their user, from a data source."""
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    body = F.to_json(F.struct(*data, at.alias("createdOn"), at.alias("lastUpdated")))
    return events.select(F.col("user_id").cast("string").alias("EntityId"), F.lit("User").alias("EntityType"), source.alias("DataSource"), F.lit("Visitor").alias("SourceEntityType"), F.col("user_id").cast("string").alias("SourceEntityId"), "ts", F.col("event_id").alias("ord"), body.alias("Data"))


@query(f"""WITH {VERSIONS}, c AS (SELECT *, lag(x) OVER w AS px, row_number() OVER w AS n FROM v WINDOW w AS (PARTITION BY user_id, src ORDER BY ts, event_id))
 SELECT CAST(user_id AS VARCHAR) AS "EntityId", arg_max(x, (ts, event_id)) AS x, count(*) AS said FROM c WHERE n = 1 OR x <> px GROUP BY 1""")
def merge_two_sources(spark, d):
    """Two sources change one property of the same entities in turn, in two batches: a change counts only if it differs from
    what its own source said before, also in the batch before. said: entries that the sources' histories end up with."""
    events = read(spark, d, "events")
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    cut = F.lit(lo + (hi - lo) / 2)
    source = F.when(F.col("event_id") % 2 == 0, "Web").otherwise("App")
    requests = versions(events, [(F.col("event_id") % 3).alias("x")], source)
    rules, now = [{"name": "*", "action": "AlwaysOverwrite"}], datetime(2030, 1, 1)
    base = scratch(spark)
    M.merge_batch(requests.where(F.col("ts") < cut), spark.createDataFrame([], "EntityId string, doc string"), rules, now).write.parquet(f"{base}/first")
    first = spark.read.parquet(f"{base}/first")
    stored = first.where("kind = 'entity'").select("EntityId", F.col("payload").alias("doc"))
    said = first.where("kind = 'source'").select("EntityId", "payload")
    fields = ("DataSource", "SourceEntityType", "SourceEntityId", "EntryType", "Timestamp", "id", "Data")
    entry = F.to_json(F.struct(*[F.get_json_object("payload", f"$.{c}").alias(c) for c in fields], F.get_json_object("payload", "$._ts").cast("long").alias("_ts")))
    M.merge_batch(requests.where(F.col("ts") >= cut), stored, rules, now, history=said.select("EntityId", entry.alias("entry"))).write.parquet(f"{base}/second")
    second = spark.read.parquet(f"{base}/second")
    golden = X.upsert(stored, second.where("kind = 'entity'").select("EntityId", F.col("payload").alias("doc")), ["EntityId"])
    entries = said.unionByName(second.where("kind = 'source'").select("EntityId", "payload")).groupBy("EntityId").agg(F.count("*").alias("said"))
    return golden.join(entries, "EntityId").select("EntityId", F.get_json_object("doc", "$.x").cast("long").alias("x"), "said")


@query("""SELECT CAST(user_id AS VARCHAR) AS "EntityId", CASE WHEN n = 1 THEN 'New Entity Created' WHEN event_type = 'error' THEN 'Merge Rejected' WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'Merge Silently Rejected' ELSE 'Entity Matched And Updated' END AS outcome
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)""")
def merge_contexts(spark, d):
    """Pre-merge rules by context inside the fold: errors are rejected, even clicks silently, but only of existing entities."""
    requests = versions(read(spark, d, "events"), [F.col("event_id").alias("Counter"), (F.col("event_id") % 2).alias("Odd"), F.col("event_type").alias("Kind")], F.lit("Web"))
    kind = lambda k: {"property": "incoming.Kind", "operator": "eq", "value": k}
    before = [
        {"context": "ExistingEntityPreMerge", "predicate": kind("error"), "action": "RejectMerge"},
        {"data_source": "WEB", "context": "ExistingEntityPreMerge", "predicate": {"and": [kind("click"), {"property": "incoming.Odd", "operator": "eq", "value": 0}]}, "action": "SilentlyRejectMerge"},
        {"data_source": "Other", "predicate": None, "action": "RejectMerge"},
    ]
    rules = U.Rules([{"data_source": "Other", "properties": [{"name": "*", "action": "NeverOverwrite"}]}, {"context": "MergeUpdatedEntity", "properties": [{"name": "*", "action": "AlwaysOverwrite"}]}], before)
    got = M.merge_batch(requests, spark.createDataFrame([], "EntityId string, doc string"), rules, datetime(2030, 1, 1))
    return got.where("kind = 'result'").select("EntityId", F.get_json_object("payload", "$.Outcome").alias("outcome"))


@query("""SELECT CAST(user_id AS VARCHAR) AS "EntityId", arg_min(event_id, (ts, event_id)) AS counter, arg_min(event_type, (ts, event_id)) AS fixed, arg_max(event_id, (ts, event_id)) AS note FROM events GROUP BY 1""")
def untracked_merge(spark, d):
    """Without history: the entity was written now, so no event is newer and Counter stays; Fixed is never overwritten."""
    requests = versions(read(spark, d, "events"), [F.col("event_id").alias("Counter"), F.col("event_type").alias("Fixed"), F.col("event_id").alias("Note")], F.lit("Web"))
    rules = [{"name": "Counter", "action": "OverwriteIfNewer"}, {"name": "Fixed", "action": "NeverOverwrite"}, {"name": "Note", "action": "OverwriteIfEmpty"}]
    got = M.merge_batch(requests, spark.createDataFrame([], "EntityId string, doc string"), rules, datetime(2030, 1, 1, tzinfo=timezone.utc), tracked=False).where("kind = 'entity'")
    return got.select("EntityId", F.get_json_object("payload", "$.Counter").cast("long").alias("counter"), F.get_json_object("payload", "$.Fixed").alias("fixed"), F.get_json_object("payload", "$.Note").cast("long").alias("note"))


KEY_TYPE = "array<struct<Key:string,Value:string>>"


def referring(spark: SparkSession, d: str) -> DataFrame:
    """Customers with a reference to their nation, and nations as entities: nation 3 is not there, nation 5 is there twice."""
    tag = F.struct(F.lit("ExternalEntityReference").alias("@Tag"), F.lit("Nation").alias("EntityType"), F.lit("Geo").alias("DataSource"), F.lit("Country").alias("SourceEntityType"), F.col("c_nationkey").cast("string").alias("EntityId"))
    doc = F.when(F.col("c_custkey") % 5 == 0, F.to_json(F.struct("c_name"))).otherwise(F.to_json(F.struct(F.struct(F.array(tag).alias("Places")).alias("Home"))))
    people = read(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("Person").alias("entityType"), F.array().cast(KEY_TYPE).alias("alternateKeys"), doc.alias("doc"))
    nation = read(spark, d, "nation").where("n_nationkey != 3")
    keys = F.array(F.struct(F.lit("geo.country").alias("Key"), F.col("n_nationkey").cast("string").alias("Value")))
    lands = lambda rows, letter: rows.select(F.concat(F.lit(letter), "n_nationkey").alias("id"), F.lit("Nation").alias("entityType"), keys.alias("alternateKeys"), F.lit("{}").alias("doc"))
    return people.unionByName(lands(nation, "n")).unionByName(lands(nation.where("n_nationkey = 5"), "m"))


@query("""SELECT 'c' || c_custkey AS id, CASE WHEN c_nationkey IN (3, 5) THEN NULL ELSE 'n' || c_nationkey END AS target, CASE WHEN c_nationkey = 3 THEN 'promised' WHEN c_nationkey = 5 THEN 'failed' ELSE 'resolved' END AS state FROM customer WHERE c_custkey % 5 <> 0""")
def external_references(spark, d):
    entities = referring(spark, d)
    changed, promises, failures = P.resolve_documents(entities, entities)
    none = F.lit(None).cast("string").alias("target")
    done = changed.select("id", F.get_json_object("doc", "$.Home.Places[0].EntityId").alias("target"), F.lit("resolved").alias("state"))
    return done.unionByName(promises.select(F.col("owner").alias("id"), none, F.lit("promised").alias("state"))).unionByName(failures.select(F.col("owner").alias("id"), none, F.lit("failed").alias("state")))


@query("""WITH s AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'Stale' WHEN c_custkey % 4 = 0 THEN 'Unresolved' WHEN c_nationkey = 3 THEN 'Unresolved' WHEN c_nationkey = 5 THEN 'Failed' ELSE 'Resolved' END AS status FROM customer UNION ALL SELECT 'Stale' FROM nation)
 SELECT count(*) FILTER (WHERE status = 'Resolved') AS "Resolved", count(*) FILTER (WHERE status = 'Unresolved') AS "Unresolved", count(*) FILTER (WHERE status = 'Stale') AS "Stale", count(*) FILTER (WHERE status = 'Failed') AS "Failed" FROM s""")
def promise_settlement(spark, d):
    """A promise of each customer (every fourth at a path where the reference no longer is) and some of owners that are gone."""
    path = F.when(F.col("c_custkey") % 4 == 0, "Work").otherwise("Home.Places[0]")
    named = lambda owner, path, ref: [F.concat(F.lit("p-"), owner).alias("promise"), owner.alias("owner"), F.lit("Person").alias("ownerType"), path.alias("path"), F.lit("Nation").alias("EntityType"), F.lit("GEO").alias("DataSource"), F.lit("country").alias("SourceEntityType"), ref.cast("string").alias("RefId")]
    mine = read(spark, d, "customer").select(*named(F.concat(F.lit("c"), "c_custkey"), path, F.col("c_nationkey")))
    gone = read(spark, d, "nation").select(*named(F.concat(F.lit("gone"), "n_nationkey"), F.lit("Home"), F.col("n_nationkey")))
    return P.rollup(P.settle(mine.unionByName(gone), referring(spark, d))[0])


def change_log(events: DataFrame) -> DataFrame:
    """A source history of each user: an Init before the first event, then an Update for each."""
    inits = events.groupBy("user_id").agg(F.min("ts").alias("Timestamp")).select("user_id", F.col("Timestamp") - F.expr("interval 1 second"), F.lit("Init").alias("EntryType"), F.lit('{"last":-1}').alias("Data"), F.lit(0).cast("long").alias("_ts"), F.concat(F.lit("i"), "user_id").alias("id")).toDF("user_id", "Timestamp", "EntryType", "Data", "_ts", "id")
    updates = events.select("user_id", F.col("ts").alias("Timestamp"), F.lit("Update").alias("EntryType"), F.concat(F.lit('{"last":[0,'), "event_id", F.lit("]}")).alias("Data"), (F.col("event_id") + 1).alias("_ts"), F.concat(F.lit("u"), "event_id").alias("id"))
    return inits.unionByName(updates).select(F.lit("Web").alias("DataSource"), F.lit("Visitor").alias("EntityType"), F.col("user_id").cast("string").alias("EntityId"), "id", "EntryType", F.col("Timestamp").cast("timestamp").alias("Timestamp"), "_ts", "Data")


@query("""WITH e AS (SELECT *, (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) AS cut FROM events)
 SELECT CAST(user_id AS VARCHAR) AS "EntityId", CASE WHEN user_id % 2 = 0 AND count(*) FILTER (WHERE ts <= cut) > 0 THEN arg_max(event_id, (ts, event_id)) FILTER (WHERE ts <= cut) END AS baseline,
 CASE WHEN user_id % 2 = 0 AND count(*) FILTER (WHERE ts <= cut) > 0 THEN count(*) FILTER (WHERE ts > cut) ELSE count(*) + 1 END AS kept FROM e GROUP BY user_id""")
def rebase_source(spark, d):
    """Histories of every second user compacted up to the middle of the time; asked for in another case than stored."""
    events = read(spark, d, "events")
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    log = change_log(events)
    wanted = events.where("user_id % 2 = 0").select(F.lit("WEB").alias("DataSource"), F.lit("visitor").alias("EntityType"), F.col("user_id").cast("string").alias("EntityId")).distinct()
    new, _ = L.rebase_sources(log, wanted, (lo + (hi - lo) / 2).replace(tzinfo=timezone.utc))
    base = F.max(F.when(F.col("action") == "baseline", F.get_json_object("Data", "$.last").cast("long")))
    return new.groupBy("EntityId").agg(base.alias("baseline"), F.count_if(F.col("action") == "keep").alias("kept"))


@query("""SELECT CAST(0 AS BIGINT) AS n, 'Init' AS kind, CAST(NULL AS BIGINT) AS last UNION ALL SELECT row_number() OVER (ORDER BY ts, event_id), 'Update', event_id FROM events WHERE user_id = 7""")
def split_history(spark, d):
    """The history of user 7 again for a split-off copy, in replay order with new ids."""
    log = change_log(read(spark, d, "events"))
    got = L.split_history(log, "7", "7b", {"Key": "web.visitor", "Value": "7"})
    data = F.when(F.col("EntryType") == "Update", F.get_json_object("Data", "$.last[1]").cast("long"))
    order = W.partitionBy("EntityId").orderBy("Timestamp", F.when(F.col("_ts") == 0, F.lit(2**63 - 1)).otherwise(F.col("_ts")))
    return got.where("EntityId = '7b' AND length(id) = 64").select((F.row_number().over(order) - 1).cast("long").alias("n"), F.col("EntryType").alias("kind"), data.alias("last"))


@query("""SELECT event_id, user_id FROM events WHERE event_type = 'click' AND user_id IN (3, 5, 8, 13) AND ts >= (SELECT min(ts) + INTERVAL 2 DAY FROM events) AND ts <= (SELECT min(ts) + INTERVAL 20 DAY FROM events) AND value > 5 ORDER BY ts, event_id LIMIT 100""")
def tracking_where(spark, d):
    events = read(spark, d, "events")
    first = events.agg(F.min("ts")).first()[0]
    log = events.select(F.col("event_id").alias("id"), F.col("event_type").alias("DataSource"), F.lit("User").alias("EntityType"), F.col("user_id").cast("string").alias("EntityId"), F.col("ts").alias("Timestamp"), "value")
    rows = L.tracking(log, "click", "User", first + timedelta(days=2), first + timedelta(days=20), ["3", "5", "8", "13"])
    return Q.entities_where(rows, "x.value > :least", "x.id AS event_id, CAST(x.EntityId AS BIGINT) AS user_id", "Timestamp", 100, None, {"least": 5})


@query("SELECT lang, source, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1, 2")
def distinct_first(spark, d):
    return L.distinct_first(read(spark, d, "documents").select("lang", "source", "doc_id", "n_chars"), ["lang", "source"], "doc_id")


@query("""WITH s AS (SELECT 'Doc|' || source || '|' || doc_id AS s, doc_id, lang, n_chars FROM documents), f AS (SELECT lang, n_chars, arg_min(s, doc_id) AS first FROM s GROUP BY 1, 2)
 SELECT s.s AS source, substr(sha256(first), 1, 32) AS match FROM s JOIN f USING (lang, n_chars) WHERE s.s <> first""")
def in_batch_duplicates(spark, d):
    """New sources that agree in language and length join the first of them, in a batch that no entity is stored for."""
    docs = read(spark, d, "documents")
    source = F.concat_ws("|", F.lit("Doc"), "source", F.col("doc_id").cast("string"))
    new = docs.select(source.alias("source"), F.concat_ws(".", "source", F.col("doc_id").cast("string")).alias("Key"), F.substring(F.sha2(source, 256), 1, 32).alias("fresh"), F.lit(0).alias("ts"), F.col("doc_id").alias("ord"), F.lit("Doc").alias("EntityType"), F.to_json(F.struct("lang", "n_chars")).alias("Data"))
    return R.match_sources(new, spark.createDataFrame([], f"id string, entityType string, createdOn timestamp, alternateKeys {KEY_TYPE}, doc string"), ["lang", "n_chars"])


@query(f"""SELECT c_custkey, k.Key AS "Key", k.Value AS "Value", CASE WHEN k.Key = 'crm.customer' AND c_custkey % 3 = 0 THEN 'failed' END AS "Error" FROM ({KEYS_SQL}) UNION ALL SELECT c_custkey, 'web.customer', CAST(c_custkey AS VARCHAR), NULL FROM customer WHERE c_custkey % 6 = 0""")
def sync_events(spark, d):
    rows = customers(spark, d).select(F.col("c_custkey").alias("id"), "alternateKeys")
    event = lambda key, at, error: [F.col("c_custkey").alias("id"), F.lit(key).alias("Key"), F.col("c_custkey").cast("string").alias("Value"), F.lit(at).alias("synced"), F.lit(error).cast("string").alias("error")]
    c = read(spark, d, "customer").where("c_custkey % 3 = 0")
    events = c.select(*event("crm.customer", 1, None)).unionByName(c.select(*event("crm.customer", 2, "failed"))).unionByName(c.where("c_custkey % 6 = 0").select(*event("web.customer", 1, None)))
    got = L.record_sync(rows, events)
    return got.select(F.col("id").alias("c_custkey"), F.explode("alternateKeys").alias("k")).select("c_custkey", "k.Key", "k.Value", "k.Error")


@query("""SELECT p_partkey, p_partkey % 3 = 0 AS success, CASE p_partkey % 3 WHEN 1 THEN 'bad' WHEN 2 THEN 'Not processed' END AS error FROM part""")
def item_results(spark, d):
    part = read(spark, d, "part").select("p_partkey")
    return L.item_results(part, part.where("p_partkey % 3 = 0"), part.where("p_partkey % 3 = 1").withColumn("error", F.lit("bad")), ["p_partkey"])


@query("""SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery') AND c_nationkey IN (1, 2, 3, 4) AND c_name <> 'Customer#000000003' AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <= 2)""")
def predicate_builders(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", "c_nationkey", F.to_json(F.struct(F.col("c_name").alias("Name"), F.struct("c_mktsegment", "c_nationkey").alias("Home"))).alias("doc"))
    rows = rows.where(C.path_in("Home.c_mktsegment", ["Building", "MACHINERY", None]) & C.path_in("Home.c_nationkey", [1, 2, 3, 4]) & ~C.name_equals("CUSTOMER#000000003") & ~C.path_in("Name", [None]))
    return C.in_values(rows, "c_nationkey", read(spark, d, "nation").where("n_regionkey <= 2").select("n_nationkey"), text=False).select("c_custkey")


def scratch(spark: SparkSession) -> str:
    """A new folder where all executors can write: below spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="aurum-")
    return f"{base.rstrip('/')}/aurum-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
