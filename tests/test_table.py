"""The record table: commits, deletes, patches, compaction, expiry, recovery."""

import pytest

from recordspark.plans.model import NEVER, Config, InvalidArgument, NotFound, ScanRange, TransactionConflict
from recordspark.sources.manifest import Files
from recordspark.sources.table import Latency, RecordTable

V = b"\1\2\3"


@pytest.fixture
def table(spark, tmp_path):
    return RecordTable(spark, str(tmp_path / "t"), Config(compaction_threshold=2, compaction_ratio=1000), clock=lambda: 1_000_000)


def keys(table, at=None, **kw):
    return [(r["key"], r["ts"]) for r in table.query(at or ScanRange.all(), **kw)]


def test_batches_and_deletes(table):
    table.write_batch([("a", 100, V), ("b", 200, V), ("c", 300, V), ("d", 400, V)])
    table.delete_range("b", "d")
    assert keys(table, ScanRange.key_range("a", "d")) == [("a", 100), ("d", 400)]
    table.write_batch([("b", 200, b"x"), ("b", 200, b"y")])
    assert bytes(table.get("b", 200)["value"]) == b"y" and table.last_seq == 7
    table.delete_batch([("b", 200)])
    assert table.get("b", 200) is None
    assert bytes(table.get("b", 200, snapshot_seq=7)["value"]) == b"y"
    assert table.get("a", 1) is None and table.get_latest("a")["ts"] == 100


def test_ttl_replaces_expiry_and_counts_from_ts(table):
    table.write_batch([("k", 0, V, 5)], ttl_s=2)
    assert table.get("k", 0)["expire_at"] == 2_000_000
    assert table.get("k", 0, now_us=2_000_000) is None
    table.write_batch([("far", NEVER - 10, V)], ttl_s=100)
    assert table.get("far", NEVER - 10)["expire_at"] == NEVER
    with pytest.raises(InvalidArgument):
        table.write_batch([("k", 0, V)], ttl_s=0)


def test_patch(table):
    table.write_batch([("k", 1, V)])
    table.patch_record("k", 1, ttl_s=60)
    got = table.get("k", 1)
    assert bytes(got["value"]) == V and got["expire_at"] == 60_000_001
    table.patch_record("k", 1, value=b"n")
    assert (bytes(table.get("k", 1)["value"]), table.get("k", 1)["expire_at"]) == (b"n", 60_000_001)
    with pytest.raises(NotFound, match="not found"):
        table.patch_record("none", 1)


def test_frames_need_an_ordinal(table, spark):
    df = spark.createDataFrame([("a", 1, bytearray(b"1"), 1), ("a", 1, bytearray(b"2"), 2)], "key string, ts long, value binary, ordinal long")
    table.write_batch(df)
    assert bytes(table.get("a", 1)["value"]) == b"2"
    with pytest.raises(InvalidArgument):
        table.write_batch(df.drop("ordinal"))


def test_compaction_does_not_resurrect(table):
    table.write_batch([(f"k{i}", 1, V) for i in range(6)])
    table.write_batch([("k0", 1, b"new"), ("z", 5, V)])
    table.delete_range("k1", "k3")
    table.delete_batch([("k4", 1)])
    before = keys(table)
    assert table.compact() and keys(table) == before == [("k0", 1), ("k3", 1), ("k5", 1), ("z", 5)]
    version = table.manifest.current()
    assert len(version.parts) == 1 and version.parts[0].tombstones == 0 and table.stats.compactions == 1
    table.write_batch([("k1", 1, b"again")])
    assert ("k1", 1) in keys(table)
    assert table.vacuum() >= 4 and keys(table)[0] == ("k0", 1)


def test_partial_compaction_keeps_tombstones(spark, tmp_path):
    table = RecordTable(spark, str(tmp_path / "t"), Config(compaction_threshold=2, compaction_ratio=3), clock=lambda: 0)
    table.write_batch([(f"big{i:05d}", 1, bytes([i % 251] * 50 + list(i.to_bytes(4)))) for i in range(4000)])
    table.delete_batch([("big00000", 1)])
    table.delete_range("big00001", "big00003")
    assert table.compact() and len(table.manifest.current().parts) == 2
    assert keys(table, ScanRange.key_range("big00000", "big00004")) == [("big00003", 1), ("big00004", 1)]


def test_gc_drops_whole_parts(table):
    table.write_batch([("old", 1, V, 10), ("old2", 1, V, 20)])
    table.write_batch([("mixed", 1, V, 10), ("lives", 1, V)])
    assert table.gc(now_us=50) == 2 and keys(table, now_us=50) == [("lives", 1)]


def test_gc_keeps_an_expired_version_that_hides_an_older_one(table):
    table.write_batch([("k", 1, b"old")])
    table.write_batch([("k", 1, b"new", 10)])
    assert table.gc(now_us=50) == 0 and keys(table, now_us=50) == []


def test_reopen_and_two_writers(table, spark):
    table.write_batch([("a", 1, V)])
    other = RecordTable(spark, table.path, clock=lambda: 0)
    base = other.manifest.current()
    table.write_batch([("b", 1, V)])
    with pytest.raises(TransactionConflict, match="conflict"):
        other.append(other.entries([(0, "c", 1, NEVER, V, None)]), base)
    assert keys(other) == [("a", 1), ("b", 1)] and other.last_seq == 2


def test_a_commit_that_was_cut_off_never_was(table):
    table.write_batch([("a", 1, V)])
    with open(f"{table.path}/_manifest/{2:020d}.json", "w") as f:
        f.write('{"number": 2, "last')
    assert keys(table) == [("a", 1)]
    assert table.write_batch([("b", 1, V)]).number == 3 and keys(table) == [("a", 1), ("b", 1)]
    table.write_batch([("c", 1, V)])
    assert keys(RecordTable(table.spark, table.path, clock=lambda: 0)) == [("a", 1), ("b", 1), ("c", 1)]
    assert table.vacuum() == 0 and len(keys(table)) == 3


def test_manifests_on_a_store_of_hadoop(spark, tmp_path):
    """As on a path that only Hadoop's file systems read: files appear whole, and never in place of another."""
    files = Files(spark, f"file://{tmp_path}/h")
    files.local = None
    assert files.create("x/1.json", "{}") and not files.create("x/1.json", "[]") and files.read("x/1.json") == "{}"
    assert files.list("x") == [n for n in files.list("x") if n in ("1.json", ".1.json.crc")] and files.list("none") == []
    table = RecordTable(spark, f"file://{tmp_path}/h/t", clock=lambda: 0)
    table.files.local = None
    table.write_batch([("a", 1, V)])
    base = table.manifest.current()
    table.write_batch([("é", 1, V)])
    with pytest.raises(TransactionConflict):
        table.append(table.entries([(0, "c", 1, NEVER, V, None)]), base)
    assert keys(table) == [("a", 1), ("é", 1)]


def test_a_commit_between_reading_and_publishing(table, spark, monkeypatch):
    """Another writer's commit just after this one has looked is never lost."""
    table.write_batch([("a", 1, V)])
    other, base = RecordTable(spark, table.path, clock=lambda: 0), table.manifest.current()
    new = table.staged(table.entries([(0, "c", 1, NEVER, V, None)]), base)
    look = table.manifest.newest

    def looked():
        seen = look()
        other.write_batch([("b", 1, V)])
        return seen

    monkeypatch.setattr(table.manifest, "newest", looked)
    with pytest.raises(TransactionConflict):
        table.manifest.publish(base, new)
    monkeypatch.undo()
    assert keys(table) == [("a", 1), ("b", 1)]


def test_a_range_without_an_end(table):
    table.write_batch([("a", 1, V), ("b", 1, V), ("\U0010ffff", 1, V)])
    table.delete_range("b", None)
    assert keys(table) == [("a", 1)]
    assert table.compact() and keys(table) == [("a", 1)]


def test_time_partitions_are_pruned(spark, tmp_path):
    table = RecordTable(spark, str(tmp_path / "t"), Config(ts_bucket_us=100), clock=lambda: 0)
    table.write_batch([("a", t, V) for t in (5, 150, 250, 950)])
    table.write_batch([("b", 151, V)])
    df = table.scan(ScanRange.time_range(100, 299))
    assert sorted((r["key"], r["ts"]) for r in df.collect()) == [("a", 150), ("a", 250), ("b", 151)]
    assert "ts_bucket" in df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    table.compact()


def test_key_filters_reach_the_scan(table):
    table.write_batch([("a", 1, V)])
    plan = table.scan(ScanRange.prefix_time_range("a", 0, 9))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(key,a)" in plan and "GreaterThanOrEqual(ts,0)" in plan


def test_stats(table):
    table.write_batch([("a", 1, V), ("b", 1, V)])
    table.query(ScanRange.all())
    assert table.stats.records_written == 2 and table.stats.records_read == 2
    assert "recordspark_records_written 2" in table.stats.metrics_text()
    assert table.part_stats().first()["rows"] == 2 and table.maintain(0)["purged"] == 0
    table.write_batch([("a", 1, V)])
    table.delete_batch([("b", 1)])
    assert table.compact()
    s = table.stats
    assert (s.queries, s.batches, s.records_deleted, s.parts, s.live_entries) == (1, 3, 1, 1, 1) and s.bytes_written > s.live_bytes > 0
    assert s.latency["write"].n == 3 and 0 < s.latency["write"].percentile(0.5) <= s.latency["write"].percentile(0.99)
    assert s.ratios()["write_amplification"] > 1 and 'recordspark_read_latency_us{quantile="0.9"}' in s.metrics_text()


def test_latency_percentiles_are_near_the_values():
    x = Latency()
    for v in range(1, 10_001):
        x.add(v)
    for q in (0.5, 0.9, 0.99):
        assert 10_000 * q <= x.percentile(q) <= 10_000 * q * 1.2


def test_scans_of_a_merged_table(table, spark):
    rows = [(f"k{i:03d}", t, bytes([i % 256])) for i in range(200) for t in (1, 2)]
    table.write_batch(rows[:200])
    table.write_batch(rows[200:])
    assert table.compact()
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(table.scan(ScanRange.of_prefix("k1")))  # a filtered read and no more
    assert len(keys(table)) == 400
    table.write_batch([("k001", 1, b"new"), ("x", 1, V)])
    table.delete_range("k010", "k020")
    table.delete_batch([("k000", 2)])
    table.write_batch([("k015", 1, b"again")])
    merged = [(r["key"], r["ts"], bytes(r["value"])) for r in table.query(ScanRange.all())]
    whole = table.manifest.current()
    from dataclasses import replace

    unmerged = replace(whole, parts=tuple(replace(p, merged=False) for p in whole.parts))
    want = [(r["key"], r["ts"], bytes(r["value"])) for r in table.scan(version=unmerged).orderBy("key", "ts").collect()]
    assert merged == want and len(want) == 400 - 20 - 1 + 1 + 1
    assert "Exchange hashpartitioning" not in plan(table.scan()).split("Union")[1].split("BroadcastExchange")[0]


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from recordspark.plans.model import InvalidConfig
    from recordspark.sources.workdir import shared_dir

    context = lambda master, **conf: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: None))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(InvalidConfig, match="spark.checkpoint.dir"):
            shared_dir(context(master))
        assert shared_dir(context(master, **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
