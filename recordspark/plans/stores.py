"""Queries of the catalogue that go through record tables and document databases: write, reopen, read.

Each works in a new folder of the shared one, which goes when the driver ends.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordspark.functions import paths
from recordspark.operators.documents import Direction, Documents
from recordspark.plans.catalogue import C, DAY, DAILY, FIRST_DAY, LWW, NOW, P, R, T1, T2, daily, log, query, table
from recordspark.plans.model import NEVER, AlreadyExists, Config, InvalidArgument, InvalidConfig, ScanRange, StoreDef, TransactionConflict, object_store
from recordspark.sources.docdb import DocDB
from recordspark.sources.table import RecordTable
from recordspark.sources.workdir import removed_at_exit, shared_dir

MERGE = Config(compaction_threshold=2, compaction_ratio=1_000_000)


def folder(spark: SparkSession) -> str:
    return removed_at_exit(spark, f"{shared_dir(spark)}/stores-{uuid.uuid4().hex}")


def records_at(spark: SparkSession, at: str, config: Config = MERGE) -> RecordTable:
    return RecordTable(spark, at, config, clock=lambda: NOW)


def batch(rows: DataFrame) -> DataFrame:
    """Records of a change log as a batch: the value as bytes, later seqs win."""
    return rows.select("key", "ts", "expire_at", F.col("value").cast("string").cast("binary").alias("value"), F.col("seq").alias("ordinal"))


def read(live: DataFrame) -> DataFrame:
    return live.select("key", "ts", F.col("value").cast("string").cast("double").alias("value"))


# Record tables

READ = "SELECT key, ts, value FROM"


@query(f"{READ} {R} WHERE NOT (key >= 'click:2' AND key < 'click:4') OR starts_with(key, 'click:3')")
def table_write_reopen(spark, d):
    """Two batches and a range delete between them, read by a table opened anew."""
    at, rows = folder(spark), log(spark, d)
    t = records_at(spark, at)
    t.write_batch(batch(rows))
    t.delete_range("click:2", "click:4")
    t.write_batch(batch(rows.where(F.col("key").startswith("click:3"))))
    t.flush()
    return read(records_at(spark, at).scan())


@query(f"{READ} ({LWW})")
def table_compacted(spark, d):
    """Versions in batches by kind of event, merged into one part that is read without a shuffle."""
    at, rows = folder(spark), daily(spark, d)
    t = records_at(spark, at)
    middle = rows.agg(((F.min("seq") + F.max("seq")) / 2).cast("long").alias("m")).first()["m"]
    for part in (rows.where(F.col("seq") <= middle), rows.where(F.col("seq") > middle)):
        t.write_batch(batch(part))
    if not t.compact():
        raise RuntimeError("two parts should have been merged")
    return read(records_at(spark, at).scan())


@query(f"{READ} (SELECT *, row_number() OVER (PARTITION BY key, ts ORDER BY seq DESC) AS n FROM {DAILY} WHERE seq <= (SELECT (min(event_id) + max(event_id)) // 2 FROM events)) WHERE n = 1")
def table_snapshot(spark, d):
    """What a snapshot sees after further batches and deletes."""
    at, rows = folder(spark), daily(spark, d)
    t = records_at(spark, at)
    middle = rows.agg(((F.min("seq") + F.max("seq")) / 2).cast("long").alias("m")).first()["m"]
    seq = t.write_batch(batch(rows.where(F.col("seq") <= middle))).last_seq
    t.write_batch(batch(rows.where(F.col("seq") > middle)))
    t.delete_range("", None)
    return read(records_at(spark, at).scan(snapshot_seq=seq))


@query(f"SELECT key, ts, CASE WHEN n = 1 THEN 0.5 ELSE value END AS value, CASE WHEN n = 1 THEN ts + 60000000 ELSE {NEVER} END AS expire_at FROM (SELECT *, row_number() OVER (ORDER BY key, ts) AS n FROM {R}) WHERE n <> 2")
def table_patch_and_delete(spark, d):
    """The first record gets another value and a ttl, the second goes, point by point."""
    at = folder(spark)
    t = RecordTable(spark, at, MERGE, clock=lambda: FIRST_DAY)
    t.write_batch(batch(log(spark, d)))
    first, second = t.scan().select("key", "ts").orderBy("key", "ts").limit(2).collect()
    t.patch_record(first["key"], first["ts"], b"0.5", ttl_s=60)
    t.delete_batch([(second["key"], second["ts"])])
    if t.get(second["key"], second["ts"]) is not None or t.get_latest(first["key"]) is None:
        raise RuntimeError("point reads should follow the writes")
    live = RecordTable(spark, at, clock=lambda: FIRST_DAY).scan()
    return live.select("key", "ts", F.col("value").cast("string").cast("double").alias("value"), "expire_at")


@query(f"{READ} {R} WHERE event_type <> 'error' AND ts + {20 * DAY} > {NOW}")
def table_maintained(spark, d):
    """One batch that has expired as a whole, one whose records expire one by one: merged, purged, old files removed."""
    at, rows = folder(spark), log(spark, d)
    t = records_at(spark, at, Config(compaction_threshold=99))
    t.write_batch(batch(rows.where(F.col("key").startswith("error:")).withColumn("expire_at", F.lit(1))))
    t.write_batch(batch(rows.where(~F.col("key").startswith("error:"))), ttl_s=20 * 86_400)
    done = t.maintain(NOW)
    if done["purged"] != rows.where(F.col("key").startswith("error:")).count() or len(t.files.list("data")) != 1:
        raise RuntimeError("the expired part should have gone")
    return read(records_at(spark, at).scan())


@query(f"{READ} {R} WHERE ts BETWEEN {T1} AND {T2} AND NOT (key >= 'view:7' AND key < 'view:8')")
def table_time_pruned(spark, d):
    """Files by day: a scan of some days opens theirs alone, and still sees range deletes of other days."""
    at, rows = folder(spark), log(spark, d)
    t = records_at(spark, at, Config(ts_bucket_us=DAY))
    t.write_batch(batch(rows))
    t.delete_range("view:7", "view:8")
    return read(records_at(spark, at, Config(ts_bucket_us=DAY)).scan(ScanRange.time_range(T1, T2)))


@query(f"SELECT CAST(count(*) + 1 AS BIGINT) AS records_written, CAST(1 AS BIGINT) AS records_deleted, CAST(count(*) AS BIGINT) AS records_read, CAST(3 AS BIGINT) AS batches, CAST(1 AS BIGINT) AS compactions, CAST(1 AS BIGINT) AS parts, CAST(count(*) AS BIGINT) AS live_entries, true AS timed, true AS sized FROM {R}")
def table_stats(spark, d):
    """What a table has counted, and how long its operations took: a percentile for each kind, in order."""
    t, rows = records_at(spark, folder(spark)), log(spark, d)
    for kind in (F.col("key") < "p", F.col("key") >= "p"):
        t.write_batch(batch(rows.where(kind)))
    t.delete_range("~", None)
    t.compact()
    read_rows = len(t.query(ScanRange.all()))
    s, steps = t.stats, [[t.stats.latency[x].percentile(q) for q in (0.5, 0.9, 0.99)] for x in ("write", "read", "compaction")]
    timed = all(0 < a <= b <= c for a, b, c in steps) and s.latency["write"].n == 3
    sized = s.bytes_written > 0 and s.live_bytes > 0 and s.ratios()["write_amplification"] > 1 and s.records_read == read_rows
    counts = (s.records_written, s.records_deleted, s.records_read, s.batches, s.compactions, s.parts, s.live_entries)
    return spark.createDataFrame([(*counts, timed, sized)], "records_written long, records_deleted long, records_read long, batches long, compactions long, parts long, live_entries long, timed boolean, sized boolean")


@query("SELECT setting FROM (VALUES ('default_ttl_s'), ('compaction_threshold'), ('compaction_ratio'), ('compression'), ('compression_level'), ('ts_bucket_us'), ('manifest_snapshot_every'), ('max_broadcast_bytes')) AS t(setting)")
def configs_refused(spark, d):
    """Settings that are checked, each with a value that no table may have."""
    def refused(name: str, value) -> bool:
        try:
            Config(**{name: value}).validate()
        except InvalidConfig:
            return True
        return False

    odd = {"default_ttl_s": 0, "compaction_threshold": 0, "compaction_ratio": 0, "compression": "rar", "compression_level": 99, "ts_bucket_us": 0, "manifest_snapshot_every": 0, "max_broadcast_bytes": -1, "extra": {}}
    return spark.createDataFrame([(n,) for n, v in odd.items() if refused(n, v)], "setting string")


@query(f"SELECT CAST(count(*) AS BIGINT) AS rows, 1 AS versions, 2 AS parts FROM {R}")
def table_manifest_snapshot(spark, d):
    """Old versions are removed, the newest still holds all parts."""
    at, rows = folder(spark), log(spark, d)
    t = records_at(spark, at)
    for kind in (F.col("key") < "p", F.col("key") >= "p"):
        t.write_batch(batch(rows.where(kind)))
    t.manifest.snapshot(keep=1)
    again = records_at(spark, at)
    return again.scan().agg(F.count("*").alias("rows")).select("rows", F.lit(len(again.manifest.versions())).alias("versions"), F.lit(again.part_stats().count()).alias("parts"))


@query(f"{READ} {R}")
def table_torn_manifest(spark, d):
    """A manifest that was cut off never was a version: the table is read as before, and written on."""
    at, rows = folder(spark), log(spark, d)
    t = records_at(spark, at)
    t.write_batch(batch(rows.where(F.col("key") < "p")))
    t.files.create(f"{t.manifest.FOLDER}/{t.manifest.current().number + 1:020d}.json", '{"number": 2, "last_s')
    records_at(spark, at).write_batch(batch(rows.where(F.col("key") >= "p")))
    return read(records_at(spark, at).scan())


@query(f"{READ} {R}")
def stream_into_table(spark, d):
    """The events as a stream, in micro-batches of one commit each."""
    from recordspark.streaming.ingest import ingest

    at = folder(spark)
    e = table(spark, d, "events")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(d)
    rows = stream.select(F.concat_ws(":", "event_type", "user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("value").cast("string").cast("binary").alias("value"), "event_id")
    t = records_at(spark, f"{at}/table")
    ingest(rows, t, f"{at}/stream", ["event_id"]).awaitTermination()
    return read(records_at(spark, f"{at}/table").scan())


@query(f"SELECT key, 'click\N{REPLACEMENT CHARACTER}' AS odd FROM {R}")
def key_as_text(spark, d):
    """Binary keys as text; bytes that aren't UTF-8 show as replacement characters."""
    return log(spark, d).select(paths.key_text(F.col("key").cast("binary")).alias("key"), paths.key_text(F.unhex(F.lit("636C69636BFF"))).alias("odd"))


# Document databases


def customers_in(spark: SparkSession, d: str, at: str) -> DocDB:
    db = DocDB(spark, at)
    db.create_object_store("customer", "id")
    db.create_index("customer", "by_segment_nation", ["segment", "home.nation"])
    c = table(spark, d, "customer")
    doc = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.struct(F.col("c_nationkey").alias("nation")).alias("home")))
    db.write_frame("customer", c.select(doc.alias("doc"), F.col("c_custkey").alias("ordinal")))
    return db


CUSTOMER = T.StructType([T.StructField("name", T.StringType()), T.StructField("segment", T.StringType())])
NAMED = f"SELECT pk, c_name AS name, c_mktsegment AS segment FROM {C}"


def named(docs: Documents) -> DataFrame:
    return docs.decoded(CUSTOMER).select("pk", "name", "segment")


@query(NAMED)
def store_put_reopen(spark, d):
    at = folder(spark)
    customers_in(spark, d, at)
    return named(DocDB(spark, at).documents("customer"))


@query(f"SELECT pk, c_name AS name FROM {C} WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def store_index_eq(spark, d):
    """By a stored database's composite index over JSON paths."""
    at = folder(spark)
    customers_in(spark, d, at)
    db = DocDB(spark, at)
    found = db.documents("customer").with_df(db.get_by_index("customer", "by_segment_nation", ["BUILDING", 7]))
    return named(found).select("pk", "name")


@query(NAMED + " WHERE c_custkey NOT IN (1, 2, 3) UNION ALL SELECT '2', 'again', 'NEW' UNION ALL SELECT 'new', 'first', 'NEW'")
def store_put_add_delete(spark, d):
    """Keys go, one comes back, one is added; adding what is there is refused and changes nothing."""
    at = folder(spark)
    db = customers_in(spark, d, at)
    db.delete("customer", 1, 2, 3)
    db.put("customer", {"id": 2, "name": "again", "segment": "NEW"})
    db.add("customer", {"id": "new", "name": "first", "segment": "NEW"})
    try:
        db.add("customer", {"id": "other"}, {"id": 4})
        raise RuntimeError("key 4 exists")
    except AlreadyExists:
        pass
    if db.get("customer", 1) is not None or db.get("customer", 2)["name"] != "again":
        raise RuntimeError("reads by key should follow the writes")
    return named(DocDB(spark, at).documents("customer"))


@query("SELECT CAST(count(*) AS BIGINT) AS cleared, '\U0001f600' AS pk FROM customer")
def store_clear(spark, d):
    """All documents go, whatever their keys; what is put afterwards is there."""
    at = folder(spark)
    db = customers_in(spark, d, at)
    db.put("customer", {"id": "\U0010ffff"})
    db.delete("customer", "\U0010ffff")
    n = db.clear("customer")
    db.put("customer", {"id": "\U0001f600"})
    return DocDB(spark, at).documents("customer").scan().select(F.lit(n).cast("long").alias("cleared"), "pk")


@query("SELECT CAST(row_number() OVER (ORDER BY r_regionkey) AS VARCHAR) AS pk, r_name AS name FROM region")
def store_auto_keys(spark, d):
    """Numbers from 1 in the order of the documents, in two calls."""
    at = folder(spark)
    db = DocDB(spark, at)
    db.create_object_store("region", "id", auto_increment=True)
    names = [r["r_name"] for r in table(spark, d, "region").orderBy("r_regionkey").collect()]
    db.put_auto("region", *({"name": n} for n in names[:2]))
    DocDB(spark, at).put_auto("region", *({"name": n} for n in names[2:]))
    return DocDB(spark, at).documents("region").decoded(T.StructType([T.StructField("name", T.StringType())])).select("pk", "name")


@query(
    "SELECT * FROM (VALUES ('kept', 'id', 'by_a', 'a', false, false), ('kept', 'id', 'by_tags', 'tags', false, true), ('kept', 'id', 'by_x_y', 'x,y.z', true, false), ('numbered', 'n', NULL, NULL, NULL, NULL))"
    " AS t(store, key_path, index, paths, is_unique, multi_entry)"
)
def store_catalog(spark, d):
    """Stores and indexes made, dropped and applied as schemas, as a database opened anew has them."""
    at = folder(spark)
    db = DocDB(spark, at)
    for name in ("kept", "gone"):
        db.create_object_store(name, "id")
    db.create_object_store("kept", "id")
    db.create_index("kept", "by_a", "a")
    db.create_index("kept", "dropped", "b")
    db.delete_index("kept", "dropped")
    db.delete_object_store("gone")
    wanted = StoreDef("kept", "id").with_index("by_a", "a").with_index("by_tags", "tags", multi_entry=True).with_index("by_x_y", ["x", "y.z"], unique=True)
    db.apply_schemas(wanted, StoreDef("numbered", "n", auto_increment=True))
    again, rows = DocDB(spark, at), []
    for name in again.store_names():
        store = again.get_store(name)
        rows += [(name, store.key_path, i.name, ",".join(i.key_paths), i.unique, i.multi_entry) for i in store.indexes] or [(name, store.key_path, None, None, None, None)]
    return spark.createDataFrame(rows, "store string, key_path string, index string, paths string, is_unique boolean, multi_entry boolean")


@query(
    "SELECT form, store, key_path, index, paths, is_unique FROM (VALUES ('built'), ('decorated')) AS f(form),"
    " (VALUES ('part', 'p_partkey', 'by_brand', 'p_brand', false), ('part', 'p_partkey', 'p_name', 'p_name', true)) AS t(store, key_path, index, paths, is_unique)"
)
def store_schema_forms(spark, d):
    """The same store stated step by step and as a decorated class, applied to a database each."""

    @object_store("p_partkey", name="part")
    @dataclass
    class Part:
        p_partkey: int
        p_name: str = field(metadata={"index": True, "unique": True})
        p_brand: str = field(metadata={"index": "by_brand"})

    forms = {"built": StoreDef("part", "p_partkey").with_index("p_name", "p_name", unique=True).with_index("by_brand", "p_brand"), "decorated": Part}
    rows = []
    for form, schema in forms.items():
        at = folder(spark)
        DocDB(spark, at).apply_schemas(schema)
        store = DocDB(spark, at).get_store("part")
        rows += [(form, store.name, store.key_path, i.name, ",".join(i.key_paths), i.unique) for i in store.indexes]
    return spark.createDataFrame(rows, "form string, store string, key_path string, index string, paths string, is_unique boolean")


@query("SELECT * FROM (VALUES ('NEXT', false, false), ('prev', true, false), ('nextUnique', false, true), ('PREVUNIQUE', true, true), ('sideways', NULL, NULL)) AS t(name, down, is_unique)")
def cursor_directions(spark, d):
    """What a direction's name means; one that there isn't is refused."""
    rows = []
    for name in ("NEXT", "prev", "nextUnique", "PREVUNIQUE", "sideways"):
        try:
            rows.append((name, Direction.parse(name).down, Direction.parse(name).unique))
        except InvalidArgument:
            rows.append((name, None, None))
    return spark.createDataFrame(rows, "name string, down boolean, is_unique boolean")


@query("SELECT invalid FROM (VALUES ('a b'), ('a/b'), ('é'), ('')) AS t(invalid)")
def names_refused(spark, d):
    """Of some names those that no store may have."""
    def refused(name: str) -> bool:
        try:
            StoreDef(name, "id")
        except InvalidArgument:
            return True
        return False

    return spark.createDataFrame([(n,) for n in ("ok", "A-1_z", "a b", "a/b", "é", "") if refused(n)], "invalid string")


def two_stores(spark: SparkSession, d: str, at: str) -> DocDB:
    db = DocDB(spark, at)
    for name, key in (("nation", "n_nationkey"), ("region", "r_regionkey")):
        db.create_object_store(name, key)
        t = table(spark, d, name)
        db.write_frame(name, t.select(F.to_json(F.struct(*t.columns)).alias("doc"), F.col(key).alias("ordinal")))
    return db


def both_stores(db: DocDB) -> DataFrame:
    names = [(n, T.StructType([T.StructField(c, T.StringType())]), c) for n, c in (("nation", "n_name"), ("region", "r_name"))]
    nation, region = (db.documents(n).decoded(s).select(F.lit(n).alias("store"), "pk", F.col(c).alias("name")) for n, s, c in names)
    return nation.unionByName(region)


BOTH = "SELECT 'nation' AS store, CAST(n_nationkey AS VARCHAR) AS pk, n_name AS name FROM nation UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), r_name FROM region"


@query(f"SELECT store, pk, CASE WHEN store = 'region' AND pk = '1' THEN name || '!' ELSE name END AS name FROM ({BOTH}) WHERE NOT (store = 'nation' AND pk = '3') UNION ALL SELECT 'nation', '100', 'NEW'")
def tx_commit(spark, d):
    """A put, an add, a delete over two stores, in one commit, with reads of the transaction's own writes before it."""
    at = folder(spark)
    db = two_stores(spark, d, at)
    with db.transaction(["nation", "region"]) as tx:
        tx.add("nation", {"n_nationkey": 100, "n_name": "NEW"})
        tx.delete("nation", 3)
        one = tx.get("region", 1)
        tx.put("region", one | {"r_name": one["r_name"] + "!"})
        if tx.get("nation", 3) is not None or not tx.get("region", 1)["r_name"].endswith("!") or db.get("nation", 3) is None:
            raise RuntimeError("a transaction sees its own writes, others don't")
    return both_stores(DocDB(spark, at))


@query(f"SELECT store, pk, CASE WHEN store = 'region' AND pk = '1' THEN 'OTHER' ELSE name END AS name FROM ({BOTH})")
def tx_conflict(spark, d):
    """A conflict in one store leaves both as they were; so does an end without a commit."""
    at = folder(spark)
    db = two_stores(spark, d, at)
    tx, left = db.transaction(["nation", "region"]), db.transaction(["nation"])
    tx.put("nation", {"n_nationkey": 101, "n_name": "LOST"})
    tx.put("region", tx.get("region", 1) | {"r_name": "LOST"})
    left.clear("nation")
    left.abort()
    db.put("region", {"r_regionkey": 1, "r_name": "OTHER"})
    try:
        tx.commit()
        raise RuntimeError("the transaction read what has changed")
    except TransactionConflict:
        pass
    return both_stores(DocDB(spark, at))


@query(f"SELECT tag, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT pk, unnest(tags) AS tag FROM {P}) GROUP BY 1")
def json_multi_entry_counts(spark, d):
    """The entries of a multi-entry index over JSON arrays."""
    p = table(spark, d, "part")
    doc = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("tags")))
    docs = Documents(p.select(F.col("p_partkey").cast("string").alias("pk"), doc.alias("doc")), StoreDef("part", "id").with_index("by_tag", "tags", multi_entry=True), doc="doc")
    rows, _ = docs.entries(docs.store.index("by_tag"))
    return rows.groupBy(F.col("_k0.s").alias("tag")).agg(F.count("*").alias("n"))


@query(f"SELECT pk, row_number() OVER (ORDER BY pk) AS rn FROM {C}")
def cursor_walk(spark, d):
    """A cursor over a stored database, fetched in pages by key."""
    at = folder(spark)
    cursor = customers_in(spark, d, at).open_cursor("customer")
    return spark.createDataFrame([(r["pk"], i + 1) for i, r in enumerate(cursor)], "pk string, rn long")
