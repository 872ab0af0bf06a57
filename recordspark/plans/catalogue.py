"""The queries of the record and document engine, one for each operator, with equal SQL.

`events` are records: key = event_type:user_id, ts in microseconds, seq = event_id. TPC-H tables are document stores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordspark.functions import paths
from recordspark.operators import records
from recordspark.operators.documents import Direction, Documents
from recordspark.operators.ordering import with_ordinals
from recordspark.operators.overlay import conflicts, existing, overlay
from recordspark.plans.model import NEVER, Bound, KeyRange, Op, ScanRange, StoreDef

QUERIES: dict = {}
ORACLE: dict = {}

DAY = 86_400_000_000
#: 2024-01-10, 2024-01-20 and the moment "now" of the queries on expiry, 2024-01-25 (microseconds).
T1, T2, NOW = 1_704_844_800_000_000, 1_705_708_800_000_000, 1_706_140_800_000_000
#: Half of the events' numbers, of which a snapshot is.
MIDDLE = "(SELECT (min(event_id) + max(event_id)) // 2 FROM events)"
#: (low, high, seq) of range tombstones.
RANGES = (("click:2", "click:4", 6000), ("purchase:", "purchase:3", 2500), ("view:7", "view:8", 100_000_000))


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Records

R = "(SELECT event_type || ':' || CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS ts, event_id AS seq, value, event_type, user_id FROM events)"


def log(spark: SparkSession, sf_dir: str, key: Column | None = None, ts: Column | None = None, op: Column | None = None, expire_at: Column | None = None) -> DataFrame:
    e = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = e.withColumn("_ts", micros)
    return e.select(
        (F.concat_ws(":", "event_type", "user_id") if key is None else key).alias("key"), (F.col("_ts") if ts is None else ts).alias("ts"),
        (F.lit(NEVER) if expire_at is None else expire_at).alias("expire_at"), "value", F.col("event_id").alias("seq"),
        (F.lit(int(Op.PUT)) if op is None else op).cast("tinyint").alias("op"), F.lit(None).cast("string").alias("range_end"),
    )


def shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("key", "ts", "seq", "value", *more)


def scanned(spark: SparkSession, sf_dir: str, at: ScanRange) -> DataFrame:
    return shown(records.scan(log(spark, sf_dir), at, NOW))


SHOWN = "SELECT key, ts, seq, value FROM"


@query(f"{SHOWN} {R}")
def scan_all(spark, d):
    return scanned(spark, d, ScanRange.all())


@query(f"{SHOWN} {R} WHERE starts_with(key, 'click:')")
def scan_prefix(spark, d):
    return scanned(spark, d, ScanRange.of_prefix("click:"))


@query(f"{SHOWN} {R} WHERE key BETWEEN 'click:10' AND 'purchase:5'")
def scan_key_range(spark, d):
    return scanned(spark, d, ScanRange.key_range("click:10", "purchase:5"))


@query(f"{SHOWN} {R} WHERE ts BETWEEN {T1} AND {T2}")
def scan_time_range(spark, d):
    return scanned(spark, d, ScanRange.time_range(T1, T2))


@query(f"{SHOWN} {R} WHERE starts_with(key, 'view:') AND ts BETWEEN {T1} AND {T2}")
def scan_prefix_time(spark, d):
    return scanned(spark, d, ScanRange.prefix_time_range("view:", T1, T2))


@query(f"{SHOWN} {R} WHERE key BETWEEN 'click:10' AND 'purchase:5' AND ts BETWEEN {T1} AND {T2}")
def scan_key_time(spark, d):
    return scanned(spark, d, ScanRange.key_time_range("click:10", "purchase:5", T1, T2))


@query(f"{SHOWN} {R} WHERE key > 'click:10' AND key <= 'view:5' AND ts >= {T1} AND ts < {T2}")
def scan_bounds_open(spark, d):
    return scanned(spark, d, ScanRange(key_low=Bound("click:10", False), key_high=Bound("view:5"), ts_low=Bound(T1), ts_high=Bound(T2, False)))


@query(f"SELECT key, ts, seq, value, row_number() OVER (ORDER BY key, ts) AS rn FROM {R}")
def scan_natural_order(spark, d):
    return with_ordinals(scanned(spark, d, ScanRange.all()), F.col("key"), F.col("ts"))


DAILY = f"(SELECT CAST(user_id AS VARCHAR) AS key, ts // {DAY} * {DAY} AS ts, seq, value, event_type FROM {R})"
FIRST_DAY = 1_704_067_200_000_000


def daily(spark, d, op=None, **kw):
    """Keyed by user and day, so that keys have several versions."""
    return log(spark, d, F.col("user_id").cast("string"), F.expr(f"_ts div {DAY}") * F.lit(DAY), op, **kw)


def middle(spark, d) -> int:
    return table(spark, d, "events").agg(F.expr("(min(event_id) + max(event_id)) div 2").alias("m")).first()["m"]


LWW = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, ts ORDER BY seq DESC) AS n FROM {DAILY}) WHERE n = 1"


@query(f"{SHOWN} ({LWW}) WHERE key = '7' AND ts = {FIRST_DAY}")
def point_get(spark, d):
    return shown(records.get(daily(spark, d), "7", FIRST_DAY, NOW))


@query(f"SELECT key, ts, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key, ts ORDER BY seq DESC) AS n FROM {DAILY} WHERE seq <= {MIDDLE}) WHERE n = 1 AND key = '7' AND ts = {FIRST_DAY}")
def point_get_snapshot(spark, d):
    return shown(records.get(daily(spark, d), "7", FIRST_DAY, NOW, middle(spark, d)))


LATEST = "SELECT key, ts, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS n FROM {}) WHERE n = 1"


@query(LATEST.format(R))
def get_latest_all(spark, d):
    return shown(records.latest(records.visible(log(spark, d), NOW)))


@query(LATEST.format(R) + " AND key = 'click:10'")
def get_latest_key(spark, d):
    return shown(records.get_latest(log(spark, d), "click:10", NOW))


@query(LATEST.format(R) + " AND starts_with(key, 'click:')")
def get_latest_prefix(spark, d):
    return shown(records.latest(records.scan(log(spark, d), ScanRange.of_prefix("click:"), NOW)))


@query(f"{SHOWN} ({LWW})")
def lww_dedup(spark, d):
    return shown(records.visible(daily(spark, d), NOW))


@query(f"{SHOWN} ({LWW}) WHERE event_type <> 'error'")
def point_tombstone(spark, d):
    op = F.when(F.col("event_type") == "error", int(Op.DELETE)).otherwise(int(Op.PUT))
    return shown(records.visible(daily(spark, d, op), NOW))


def ranges_log(spark) -> DataFrame:
    rows = [(low, 0, NEVER, None, seq, int(Op.DELETE_RANGE), high) for low, high, seq in RANGES]
    return spark.createDataFrame(rows, "key string, ts long, expire_at long, value double, seq long, op tinyint, range_end string")


COVERED = " AND ".join(f"NOT (key >= '{a}' AND key < '{b}' AND {s} > seq)" for a, b, s in RANGES)


@query(f"{SHOWN} {R} WHERE {COVERED}")
def range_tombstone(spark, d):
    return shown(records.visible(log(spark, d).unionByName(ranges_log(spark)), NOW))


@query(f"{SHOWN} {R} WHERE {COVERED}")
def range_tombstone_many(spark, d):
    """As when there are more ranges than may be broadcast."""
    return shown(records.visible(log(spark, d).unionByName(ranges_log(spark)), NOW, max_broadcast=1))


@query(f"SELECT key, ts, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key, ts ORDER BY seq DESC) AS n FROM {DAILY} WHERE seq <= {MIDDLE}) WHERE n = 1")
def snapshot_scan(spark, d):
    return shown(records.scan(daily(spark, d), ScanRange.all(), NOW, middle(spark, d)))


@query(f"SELECT key, ts, seq, value, ts + {10 * DAY} AS expire_at FROM {R} WHERE ts + {10 * DAY} > {NOW}")
def ttl_visible(spark, d):
    return shown(records.visible(log(spark, d, expire_at=F.col("_ts") + F.lit(10 * DAY)), NOW), "expire_at")


@query(f"SELECT key, ts, seq, value, ts + CASE WHEN event_type = 'click' THEN {5 * DAY} ELSE {10 * DAY} END AS expire_at FROM {R} WHERE ts + CASE WHEN event_type = 'click' THEN {5 * DAY} ELSE {10 * DAY} END > {NOW}")
def ttl_default_override(spark, d):
    """The default ttl replaces what records say; a batch's own ttl replaces the default."""
    rows = log(spark, d)
    ttl = lambda days: paths.with_ttl(F.col("ts"), days * 86_400, F.col("expire_at"))
    rows = rows.withColumn("expire_at", F.when(F.col("key").startswith("click:"), ttl(5)).otherwise(ttl(10)))
    return shown(records.visible(rows, NOW), "expire_at")


@query(f"SELECT ts // {DAY} AS bucket, CAST(count(*) AS BIGINT) AS n, max(ts + {3 * DAY}) AS max_expire FROM {R} GROUP BY 1 HAVING max(ts + {3 * DAY}) < {NOW}")
def gc_candidates(spark, d):
    rows = log(spark, d, expire_at=F.col("_ts") + F.lit(3 * DAY))
    return records.time_buckets(rows, DAY).where(F.col("max_expire") < F.lit(NOW)).select("bucket", "n", "max_expire")


@query(f"SELECT key, ts, seq, value FROM ({LWW}) WHERE event_type <> 'error' AND NOT (key >= '2' AND key < '3' AND 4000 > seq)")
def compaction_output(spark, d):
    """A merge of all parts: tombstones are applied and dropped."""
    op = F.when(F.col("event_type") == "error", int(Op.DELETE)).otherwise(int(Op.PUT))
    ranges = spark.createDataFrame([("2", "3", 4000)], "low string, high string, at long")
    return shown(records.without_ranges(records.newest(daily(spark, d, op)), ranges).where(F.col("op") == Op.PUT))


CHANGED = "(SELECT key, ts, seq, value FROM {r} UNION ALL SELECT key, ts, seq + 1000000000, value * 2 FROM {r} WHERE seq % 10 = 0)".format(r=R)


@query(f"SELECT key, ts, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key, ts ORDER BY seq DESC) AS n FROM {CHANGED}) WHERE n = 1")
def upsert_batch(spark, d):
    base = log(spark, d)
    batch = base.where("seq % 10 = 0").withColumns({"seq": F.col("seq") + 1_000_000_000, "value": F.col("value") * 2})
    return shown(records.visible(base.unionByName(batch), NOW))


@query(f"SELECT key, ts, seq + CASE WHEN starts_with(key, 'error:') THEN 1000000000 ELSE 0 END AS seq, CASE WHEN starts_with(key, 'error:') THEN 0.5 ELSE value END AS value FROM {R}")
def patch_value(spark, d):
    """Read, replace what the patch gives, append."""
    base = log(spark, d)
    patch = records.scan(base, ScanRange.of_prefix("error:"), NOW).withColumns({"seq": F.col("seq") + 1_000_000_000, "value": F.coalesce(F.lit(0.5), F.col("value"))})
    return shown(records.visible(base.unionByName(patch.select(*base.columns)), NOW))


@query(f"SELECT key, ts, seq, value FROM {R} WHERE seq % 7 <> 0 AND NOT (key >= 'click:3' AND key < 'click:5') UNION ALL SELECT key, ts, seq + 2000000000, 1.25 FROM {R} WHERE seq % 70 = 1")
def put_delete_mix(spark, d):
    """One atomic batch of deletes, a range delete and puts after it."""
    base = log(spark, d).where("seq % 70 <> 1")
    deletes = base.where("seq % 7 = 0").withColumns({"seq": F.col("seq") + 1_000_000_000, "op": F.lit(int(Op.DELETE)).cast("tinyint")})
    span = spark.createDataFrame([("click:3", 0, NEVER, None, 1_500_000_000, int(Op.DELETE_RANGE), "click:5")], "key string, ts long, expire_at long, value double, seq long, op tinyint, range_end string")
    puts = log(spark, d).where("seq % 70 = 1").withColumns({"seq": F.col("seq") + 2_000_000_000, "value": F.lit(1.25)})
    return shown(records.visible(base.unionByName(deletes).unionByName(span).unionByName(puts), NOW))


ORACLE["put_delete_mix"] = (
    f"SELECT key, ts, seq, value FROM {R} WHERE seq % 70 <> 1 AND seq % 7 <> 0 AND NOT (key >= 'click:3' AND key < 'click:5') UNION ALL SELECT key, ts, seq + 2000000000, 1.25 FROM {R} WHERE seq % 70 = 1"
)


@query(f"SELECT key, ts, seq, value FROM {R} WHERE NOT (key >= 'view:' AND key < 'view;') UNION ALL SELECT key, ts, seq + 2000000000, value FROM {R} WHERE starts_with(key, 'view:1')")
def clear_store(spark, d):
    """All keys under a prefix go; what is put again afterwards shows."""
    base = log(spark, d)
    gone = spark.createDataFrame([("view:", 0, NEVER, None, 1_000_000_000, int(Op.DELETE_RANGE), "view;")], "key string, ts long, expire_at long, value double, seq long, op tinyint, range_end string")
    again = base.where(F.col("key").startswith("view:1")).withColumn("seq", F.col("seq") + 2_000_000_000)
    return shown(records.visible(base.unionByName(gone).unionByName(again), NOW))


@query(f"SELECT ts // 3600000000 AS bucket, min(ts) AS min_ts, max(ts) AS max_ts, min(key) AS min_key, max(key) AS max_key, CAST(count(*) AS BIGINT) AS n FROM {R} GROUP BY 1")
def time_bucket_stats(spark, d):
    return records.time_buckets(log(spark, d), 3_600_000_000).drop("max_expire")


@query("SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    p = lambda q: F.percentile("value", F.lit(q))
    return table(spark, d, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"))


@query(f"SELECT key, ts, 31 + strlen(key) + strlen(CAST(seq AS VARCHAR)) AS bytes FROM {R}")
def record_size(spark, d):
    rows = log(spark, d)
    return rows.select("key", "ts", paths.record_size(F.col("key"), F.col("seq").cast("string").cast("binary")).cast("long").alias("bytes"))


@query(f"SELECT count(DISTINCT key) AS keys, CAST(count(*) AS BIGINT) AS records, sum(31 + strlen(key)) / count(*) AS mean_bytes FROM {R}")
def table_counters(spark, d):
    rows = log(spark, d)
    return rows.agg(F.count_distinct("key").alias("keys"), F.count("*").alias("records"), (F.sum(F.lit(31) + F.octet_length("key")) / F.count("*")).alias("mean_bytes"))


# Documents

ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
O = f"(SELECT {ORDER_COLUMNS}, CAST(o_orderkey AS VARCHAR) AS pk FROM orders)"
C = "(SELECT *, CAST(c_custkey AS VARCHAR) AS pk FROM customer)"


def orders(spark, d) -> Documents:
    store = StoreDef("orders", "o_orderkey").with_index("by_status_priority", ["o_orderstatus", "o_orderpriority"]).with_index("by_price", "o_totalprice").with_index("by_customer", "o_custkey", unique=True)
    return Documents.typed(table(spark, d, "orders").select(*ORDER_COLUMNS.split(", ")), store)


def customers(spark, d) -> Documents:
    store = StoreDef("customer", "c_custkey").with_index("by_segment_nation", ["c_mktsegment", "c_nationkey"]).with_index("by_segment", "c_mktsegment")
    return Documents.typed(table(spark, d, "customer"), store)


def sparse_customers(spark, d) -> Documents:
    docs = customers(spark, d)
    return docs.with_df(docs.df.withColumn("c_nationkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey"))))


SPARSE = "(SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS c_nationkey, c_acctbal, c_mktsegment, CAST(c_custkey AS VARCHAR) AS pk FROM customer)"


@query(f"SELECT * FROM {O} WHERE pk = '77'")
def doc_get(spark, d):
    return orders(spark, d).get(77)


@query(f"SELECT pk FROM {O} WHERE pk = '77'")
def doc_get_key(spark, d):
    return orders(spark, d).get_key(77)


@query(f"SELECT pk, c_name, row_number() OVER (ORDER BY pk) AS rn FROM {C}")
def doc_scan(spark, d):
    return with_ordinals(customers(spark, d).df.select("pk", "c_name"), F.col("pk"))


@query("SELECT CAST(event_id AS VARCHAR) AS pk, props, epoch_us(ts) // 1000 AS \"_tsMs\", CASE WHEN event_id % 2 = 0 THEN (epoch_us(ts) + 5000) // 1000 END AS \"_expireAtMs\" FROM events")
def doc_scan_meta(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("expire_at", F.when(F.col("event_id") % 2 == 0, F.col("ts") + 5000).otherwise(F.lit(NEVER)))
    return Documents.typed(e, StoreDef("events", "event_id")).scan_with_meta().select("pk", "props", "_tsMs", "_expireAtMs")


@query(f"SELECT * FROM {O} WHERE pk >= '10' AND pk <= '20' ORDER BY pk LIMIT 50")
def get_all_limit(spark, d):
    return orders(spark, d).get_all(KeyRange.bound(10, 20), 50)


@query(f"SELECT pk FROM {O} WHERE pk >= '10' AND pk <= '20' ORDER BY pk LIMIT 50")
def get_all_keys(spark, d):
    return orders(spark, d).get_all_keys(KeyRange.bound(10, 20), 50)


@query(f"SELECT CAST(count(*) AS BIGINT) AS n FROM {O}")
def count_all(spark, d):
    return orders(spark, d).count()


@query(f"SELECT CAST(count(*) AS BIGINT) AS n FROM {O} WHERE pk >= '10' AND pk < '20'")
def count_keyrange(spark, d):
    return orders(spark, d).count(KeyRange.bound(10, 20, upper_open=True))


@query(f"SELECT pk FROM {O} WHERE pk >= '42' AND pk <= '42'")
def keyrange_only(spark, d):
    return orders(spark, d).in_range(KeyRange.only(42)).select("pk")


@query(f"SELECT pk FROM {O} WHERE pk >= '10' AND pk <= '20'")
def keyrange_closed(spark, d):
    return orders(spark, d).in_range(KeyRange.bound(10, 20)).select("pk")


@query(f"SELECT pk FROM {O} WHERE pk > '10' AND pk < '20'")
def keyrange_open(spark, d):
    return orders(spark, d).in_range(KeyRange.bound(10, 20, True, True)).select("pk")


@query(f"SELECT pk FROM {O} WHERE pk >= '95'")
def keyrange_lower(spark, d):
    return orders(spark, d).in_range(KeyRange.lower_bound(95)).select("pk")


@query(f"SELECT pk FROM {O} WHERE pk < '11'")
def keyrange_upper(spark, d):
    return orders(spark, d).in_range(KeyRange.upper_bound(11, True)).select("pk")


@query(f"SELECT * FROM {O} WHERE o_orderstatus = 'F'")
def where_eq(spark, d):
    return orders(spark, d).query().where_eq("o_orderstatus", "F").to_df()


@query(f"SELECT * FROM {O} WHERE o_totalprice >= 1000.0 AND o_totalprice < 50000.0")
def where_range(spark, d):
    return orders(spark, d).query().where_range("o_totalprice", 1000.0, 50000.0).to_df()


@query(f"SELECT * FROM {O} WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def where_in(spark, d):
    return orders(spark, d).query().where_in("o_orderpriority", ["1-URGENT", "5-LOW"]).to_df()


@query(f"SELECT * FROM {O} WHERE o_orderstatus = 'O' AND o_totalprice >= 1000.0 AND o_totalprice < 50000.0")
def where_eq_range(spark, d):
    return orders(spark, d).query().where_eq("o_orderstatus", "O").where_range("o_totalprice", 1000.0, 50000.0).to_df()


@query(f"SELECT pk, c_name, c_nationkey FROM {SPARSE} WHERE c_nationkey IS NULL")
def where_eq_null(spark, d):
    return sparse_customers(spark, d).query().where_eq("c_nationkey", None).to_df().select("pk", "c_name", "c_nationkey")


@query(f"SELECT pk, c_nationkey, row_number() OVER (ORDER BY c_nationkey ASC NULLS FIRST, pk) AS rn FROM {SPARSE}")
def order_asc(spark, d):
    q = sparse_customers(spark, d).query().order_by("c_nationkey")
    return with_ordinals(q.docs.df.select("pk", "c_nationkey"), *q.order)


@query(f"SELECT pk, c_nationkey, row_number() OVER (ORDER BY c_nationkey DESC NULLS LAST, pk) AS rn FROM {SPARSE}")
def order_desc(spark, d):
    q = sparse_customers(spark, d).query().order_by("c_nationkey", descending=True)
    return with_ordinals(q.docs.df.select("pk", "c_nationkey"), *q.order)


@query(f"SELECT * FROM {O} WHERE o_orderstatus = 'O' AND o_totalprice >= 1000.0 AND o_totalprice < 50000.0 ORDER BY o_totalprice ASC NULLS FIRST, pk LIMIT 10 OFFSET 5")
def limit_offset(spark, d):
    return orders(spark, d).query().where_eq("o_orderstatus", "O").where_range("o_totalprice", 1000.0, 50000.0).order_by("o_totalprice").offset(5).limit(10).to_df()


@query(f"SELECT * FROM {O} ORDER BY o_totalprice DESC NULLS LAST, pk LIMIT 20")
def top_k(spark, d):
    return orders(spark, d).query().order_by("o_totalprice", descending=True).limit(20).to_df()


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_totalprice >= 100000.0 GROUP BY 1")
def count_by_status(spark, d):
    return orders(spark, d).df.where("o_totalprice >= 100000.0").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(f"SELECT * FROM {C} WHERE c_mktsegment = 'BUILDING'")
def index_eq(spark, d):
    return customers(spark, d).get_by_index("by_segment", "BUILDING")


@query(f"SELECT * FROM {O} WHERE o_totalprice >= 20000.0 AND o_totalprice < 30000.0")
def index_range(spark, d):
    return orders(spark, d).range_by_index("by_price", 20000.0, 30000.0)


@query(f"SELECT * FROM {C} WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def composite_eq(spark, d):
    return customers(spark, d).get_by_index("by_segment_nation", ["BUILDING", 7])


@query(f"SELECT * FROM {O} WHERE o_orderstatus = 'P'")
def composite_prefix(spark, d):
    return orders(spark, d).get_by_index("by_status_priority", "P")


@query(f"SELECT * FROM {C} WHERE (c_mktsegment > 'BUILDING' OR c_mktsegment = 'BUILDING' AND c_nationkey >= 5) AND (c_mktsegment < 'HOUSEHOLD' OR c_mktsegment = 'HOUSEHOLD' AND c_nationkey < 3)")
def composite_range(spark, d):
    return customers(spark, d).range_by_index("by_segment_nation", ["BUILDING", 5], ["HOUSEHOLD", 3])


@query(f"SELECT * FROM {SPARSE} WHERE c_mktsegment = 'MACHINERY' AND c_nationkey IS NOT NULL")
def index_sparse(spark, d):
    """A document without a later path of the index isn't in it."""
    return sparse_customers(spark, d).get_by_index("by_segment_nation", "MACHINERY")


P = "(SELECT p_partkey, p_name, string_split(p_name, ' ') AS tags, CAST(p_partkey AS VARCHAR) AS pk FROM part)"


def parts(spark, d) -> Documents:
    df = table(spark, d, "part").select("p_partkey", "p_name", F.split("p_name", " ").alias("tags"))
    return Documents.typed(df, StoreDef("part", "p_partkey").with_index("by_tag", "tags", multi_entry=True))


@query(f"SELECT p_partkey, p_name, pk FROM {P} WHERE list_contains(tags, split_part((SELECT min(p_name) FROM part), ' ', 1))")
def multi_entry(spark, d):
    tag = table(spark, d, "part").agg(F.split_part(F.min("p_name"), F.lit(" "), F.lit(1)).alias("t")).first()["t"]
    return parts(spark, d).get_by_index("by_tag", tag).drop("tags")


@query(f"SELECT tag, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT pk, unnest(tags) AS tag FROM {P}) GROUP BY 1")
def multi_entry_counts(spark, d):
    docs = parts(spark, d)
    rows, _ = docs.entries(docs.store.index("by_tag"))
    return rows.groupBy(F.col("_k0").alias("tag")).agg(F.count("*").alias("n"))


def json_events(spark, d) -> Documents:
    df = table(spark, d, "events").select(F.col("event_id").cast("string").alias("pk"), F.col("props").alias("doc"))
    return Documents(df, StoreDef("events", "id").with_index("by_k", "k"), doc="doc")


J = "(SELECT CAST(event_id AS VARCHAR) AS pk, props AS doc, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


@query(f"SELECT pk, doc FROM {J} WHERE k = 7")
def json_path_eq(spark, d):
    return json_events(spark, d).query().where_eq("k", 7).to_df()


@query(f"SELECT pk, doc FROM {J} WHERE k >= 10 AND k < 20")
def json_path_range(spark, d):
    return json_events(spark, d).query().where_range("k", 10, 20).to_df()


@query(f"SELECT pk, doc FROM {J} ORDER BY k DESC, pk LIMIT 30")
def json_order(spark, d):
    return json_events(spark, d).query().order_by("k", descending=True).limit(30).to_df()


@query(f"SELECT pk, k FROM {J}")
def json_typed(spark, d):
    from pyspark.sql import types as T

    return json_events(spark, d).decoded(T.StructType([T.StructField("k", T.LongType())]))


def cursor_rows(cursor, *columns: str) -> DataFrame:
    return cursor.with_ordinals().select(*columns, "rn")


@query(f"SELECT pk, row_number() OVER (ORDER BY pk) AS rn FROM {C} WHERE pk >= '3' AND pk <= '5'")
def cursor_next(spark, d):
    return cursor_rows(customers(spark, d).cursor(KeyRange.bound(3, 5)), "pk")


@query(f"SELECT pk, row_number() OVER (ORDER BY pk DESC) AS rn FROM {C} WHERE pk >= '3' AND pk <= '5'")
def cursor_prev(spark, d):
    return cursor_rows(customers(spark, d).cursor(KeyRange.bound(3, 5), Direction.PREV), "pk")


@query("SELECT CAST(o_custkey AS VARCHAR) AS pk, row_number() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) AS rn FROM (SELECT DISTINCT o_custkey FROM orders) WHERE CAST(o_custkey AS VARCHAR) <= '5'")
def cursor_nextunique(spark, d):
    df = table(spark, d, "orders").select("o_custkey")
    return cursor_rows(Documents.typed(df, StoreDef("by_customer", "o_custkey")).cursor(KeyRange.upper_bound(5), Direction.NEXT_UNIQUE), "pk")


@query("SELECT CAST(o_custkey AS VARCHAR) AS pk, row_number() OVER (ORDER BY CAST(o_custkey AS VARCHAR) DESC) AS rn FROM (SELECT DISTINCT o_custkey FROM orders) WHERE CAST(o_custkey AS VARCHAR) <= '5'")
def cursor_prevunique(spark, d):
    df = table(spark, d, "orders").select("o_custkey")
    return cursor_rows(Documents.typed(df, StoreDef("by_customer", "o_custkey")).cursor(KeyRange.upper_bound(5), Direction.PREV_UNIQUE), "pk")


@query(f"SELECT pk, c_name FROM {C} ORDER BY pk LIMIT 1 OFFSET 5")
def cursor_advance(spark, d):
    return customers(spark, d).cursor().advance(5).select("pk", "c_name")


@query(f"SELECT c_mktsegment AS \"_k0\", c_nationkey AS \"_k1\", pk, row_number() OVER (ORDER BY c_mktsegment, c_nationkey, pk) AS rn FROM {C} WHERE c_mktsegment <= 'BUILDING'")
def index_cursor(spark, d):
    return cursor_rows(customers(spark, d).index_cursor("by_segment_nation", KeyRange.upper_bound("BUILDING")), "_k0", "_k1", "pk")


@query(f"SELECT c_mktsegment AS \"_k0\", pk, row_number() OVER (ORDER BY c_mktsegment DESC, pk DESC) AS rn FROM {C} WHERE c_mktsegment >= 'HOUSEHOLD'")
def index_cursor_prev(spark, d):
    return cursor_rows(customers(spark, d).index_cursor("by_segment", KeyRange.lower_bound("HOUSEHOLD"), Direction.PREV), "_k0", "pk")


@query("SELECT c_mktsegment AS \"_k0\", min(CAST(c_custkey AS VARCHAR)) AS pk, row_number() OVER (ORDER BY c_mktsegment) AS rn FROM customer GROUP BY 1")
def index_cursor_unique(spark, d):
    return cursor_rows(customers(spark, d).index_cursor("by_segment", None, Direction.NEXT_UNIQUE, unique_on="index_key"), "_k0", "pk")


@query("SELECT o_custkey AS \"_k0\", CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def unique_violations(spark, d):
    return orders(spark, d).violations("by_customer")


@query("SELECT CAST(n.c_custkey AS VARCHAR) AS pk FROM customer c JOIN customer n ON n.c_custkey = 2 * c.c_custkey")
def add_conflicts(spark, d):
    """Every customer is to be added again under twice its number: those whose key is taken."""
    df = customers(spark, d).df
    return existing(df.select((F.col("c_custkey") * 2).cast("string").alias("pk")), df)


@query("SELECT 1000 + row_number() OVER (ORDER BY s_suppkey) AS id, s_suppkey FROM supplier")
def auto_increment(spark, d):
    rows = with_ordinals(table(spark, d, "supplier").select("s_suppkey"), F.col("s_suppkey"))
    return rows.select((F.col("rn") + 1000).alias("id"), "s_suppkey")


def transaction_view(spark, d) -> Documents:
    """Customers with a transaction's buffer on top: every 10th is deleted, every 10th + 1 put with another segment."""
    docs = customers(spark, d)
    base = docs.df.select("pk", "c_custkey", "c_mktsegment", "c_nationkey")
    deletes = base.where("c_custkey % 10 = 0").withColumn("op", F.lit(1))
    puts = base.where("c_custkey % 10 = 1").withColumns({"c_mktsegment": F.lit("NEW"), "op": F.lit(0)})
    return docs.with_df(overlay(base, deletes.unionByName(puts)))


TX = "(SELECT CAST(c_custkey AS VARCHAR) AS pk, c_custkey, CASE WHEN c_custkey % 10 = 1 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 10 <> 0)"


@query(f"SELECT * FROM {TX}")
def tx_overlay_scan(spark, d):
    return transaction_view(spark, d).scan()


@query(f"SELECT CAST(count(*) AS BIGINT) AS n FROM {TX}")
def tx_overlay_count(spark, d):
    return transaction_view(spark, d).count()


@query(f"SELECT * FROM {TX} WHERE c_mktsegment = 'NEW' AND c_nationkey IS NOT NULL")
def tx_overlay_index(spark, d):
    return transaction_view(spark, d).get_by_index("by_segment_nation", "NEW")


@query("SELECT CAST(c_custkey AS VARCHAR) AS pk FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'MACHINERY'")
def occ_conflicts(spark, d):
    """Read: all. Since then those with a negative balance have changed, and one segment is gone."""
    base = customers(spark, d).df.select("pk", "c_acctbal", "c_mktsegment", F.col("c_name").alias("doc"))
    now = base.where("c_mktsegment <> 'MACHINERY'").withColumn("doc", F.when(F.col("c_acctbal") < 0, F.concat("doc", F.lit("!"))).otherwise(F.col("doc")))
    return conflicts(base.select("pk", "doc"), now)


@query("SELECT turn_key AS pk, role, text FROM (SELECT CAST(conv_id AS VARCHAR) AS turn_key, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS n FROM conversations) WHERE n = 1")
def latest_turn(spark, d):
    t = table(spark, d, "conversations")
    newest = t.groupBy("conv_id").agg(F.max(F.struct("turn", "role", "text")).alias("m"))
    return newest.select(F.col("conv_id").cast("string").alias("pk"), "m.role", "m.text")
