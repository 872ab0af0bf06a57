"""Mixing, sharding and URL filters against plain Python and SQL."""

import collections
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from compare import assert_same
from hypothesis import given
from hypothesis import strategies as st

from recordspark.llm import mixing, sharding, urlfilter
from recordspark.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(name, spark, duck, data):
    assert_same(QUERIES[name](spark, data), duck.execute(ORACLE[name]))


# Mixing


def filled(sizes, weights, budget, cap):
    """The targets by the rule as it is told: share, stop at the caps, share the excess again."""
    left, open_, out = budget, set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total >= cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in over)
        open_ -= set(over)
    return out


def test_targets(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 40):
        sizes = [int(x) for x in rng.integers(0, 1000, n) ** 2]
        names = [f"s{i:02d}" for i in range(n - 1)] + [None]
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()}
        want = filled(sizes, [(3, 1, 2)[i % 3] for i in range(n)], 1.5 * sum(sizes), 2.0)
        assert [got[x] for x in names] == pytest.approx(want)


def test_mix_takes_what_it_says(spark, docs):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.pareto(1.2) * 20 + 1), "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert len(out) == 3000 and out.doc_id.is_unique and (out.taken <= 2 * out["size"]).all() and set(out.copies) <= {0, 1, 2}
    for _, own in out.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= own["size"].max()
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(7)).toPandas()
    assert (out.set_index("doc_id").taken.sort_index() == again.set_index("doc_id").taken.sort_index()).all()


def plain_mix(rows, weights, budget, cap, seed=7):
    """The mix in plain Python: the rate by bisection, then each source's documents one after another in Pareto order. rows: (doc_id, text, source)."""
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({r[2] for r in rows}, key=lambda x: (x is None, x))
    whole = [sum(n for n, r in zip(sizes, rows) if r[2] == x) for x in names]
    out, expected = [0] * len(rows), [0.0] * len(rows)
    for name, target in zip(names, filled(whole, [weights[i % len(weights)] for i in range(len(names))], budget * sum(whole), cap)):
        own = [i for i, r in enumerate(rows) if r[2] == name]
        w = {i: sizes[i].bit_length() or 1 for i in own}
        low, high = 0.0, 1e9
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(cap, mid * w[i]) * sizes[i] for i in own) < target - 1e-9 else (low, mid)
        queue, seen, rest = [], defaultdict(int), target
        for i in own:
            expected[i] = min(cap, high * w[i])
            out[i] = int(expected[i] + 1e-7)
            rest -= out[i] * sizes[i]
            if (p := expected[i] - out[i]) > 1e-7:
                seen[rows[i][0], sizes[i]] += 1
                key = f"{seed}:{'null' if rows[i][0] is None else rows[i][0]}:{sizes[i]}:{seen[rows[i][0], sizes[i]]}"
                u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52
                queue.append((u / (1 - u) / (p / (1 - p)), i))
        before = 0
        for _, i in sorted(queue):
            out[i] += before + sizes[i] / 2 <= rest
            before += sizes[i]
    return out, expected


def test_mix_equals_plain_python(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.pareto(1.1) * 30 + 1), "hot" if i % 3 == 0 else f"s{i % 5}" if i % 7 else None) for i in range(1500)]
    rows += [(None, "of no id", "s1")] * 40 + [(7, "again and again", "s2")] * 30 + [(8, None, "s3"), (None, "", "s3")]
    for weights, budget in (((3.0, 1.0, 2.0), 1.5), ((1.0, 8.0), 0.4)):
        want, expected = plain_mix(rows, weights, budget, 2.0)
        out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights, budget).collect()
        key = lambda i, n, s, c: (str(i), n, str(s), c)
        assert sorted(key(r.doc_id, r["size"], r.source, r.copies) for r in out) == sorted(key(i, len((t or "").split()), s, c) for (i, t, s), c in zip(rows, want))
        assert sorted(r.expected for r in out) == pytest.approx(sorted(expected))


def test_documents_are_taken_as_often_as_their_probability_says(spark):
    """Over 30,000 documents of one source, in each length class."""
    rng = np.random.default_rng(6)
    rows = [(i, "w " * int(2 ** rng.uniform(0, 9)), "a" if i < 30_000 else "b") for i in range(60_000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1.0, 3.0), budget=0.5).toPandas()
    own = out[out.source == "a"].groupby("expected").agg(n=("copies", "count"), mean=("copies", "mean")).reset_index()
    assert len(own) >= 8 and own.expected.max() / own.expected.min() > 5
    for expected, n, mean in own.itertuples(index=False):
        p = expected % 1
        assert abs(mean - expected) < 4 * (p * (1 - p) / n) ** 0.5 + 0.01
    assert abs(out[out.source == "a"].taken.sum() / out[out.source == "a"].target.iloc[0] - 1) < 0.001


def test_propensity_favours_documents(spark):
    rows = [(i, "w w w w", "s", 8.0 if i % 2 else 1.0) for i in range(4000)] + [(4000 + i, "w " * 40, "t", None) for i in range(400)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, p double"), weights=(1.0, 9.0), budget=0.4, propensity="p").toPandas()
    own = out[out.source == "s"]
    odd = own.doc_id % 2 == 1
    assert own.expected[odd].iloc[0] == pytest.approx(8 * own.expected[~odd].iloc[0]) and own.copies[odd].mean() == pytest.approx(8 * own.copies[~odd].mean(), rel=0.2)


def test_many_rows_of_one_item(spark, monkeypatch):
    """Rows of an item are numbered in parts, each with a random number of its own."""
    monkeypatch.setattr(mixing, "NUMBERS", 100)
    rows = [(None, "one two three", "s")] * 2500 + [(1, "w " * 9000, "t")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1.0, 3.0), budget=0.5).toPandas()
    own = out[out.source == "s"]
    assert len(own) == 2500 and abs(own.taken.sum() - own.target.iloc[0]) <= 3 and 0 < own.copies.sum() < 2500


def test_mix_odd_rows(docs, no_docs):
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count() and mixing.mix(no_docs).isEmpty()
    size = {r.doc_id: r["size"] for r in out}
    assert (size[2], size[3], size[4], size[5], size[7]) == (0, 0, 0, 3, 60_000)


# Sharding


def best_capacity(sizes, k):
    """By trying every capacity that some run of groups has."""
    runs = {sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)} or {0}

    def fits(c):
        used, left = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > left:
                used, left = used + 1, c
            left -= s
        return used <= k

    return min(c for c in runs if fits(c))


@given(st.lists(st.integers(1, 60), min_size=1, max_size=14), st.integers(1, 6))
def test_smallest_capacity(sizes, k):
    sizes = np.array(sizes)
    c = sharding.smallest_capacity(sizes, k)
    assert c == best_capacity(sizes.tolist(), k)
    cuts = sharding.even_cuts(sizes, c, k)
    assert cuts[0] == 0 and cuts[-1] == len(sizes) and cuts == sorted(cuts) and len(cuts) == k + 1
    assert max(sizes[a:b].sum() for a, b in zip(cuts, cuts[1:])) <= c


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_DIGITS", 1)  # so that prefixes hold many groups and have to be split
    monkeypatch.setattr(sharding, "MORE_DIGITS", 1)
    rng = np.random.default_rng(5)
    rows = [(i, f"text {i // 3 if i % 4 else 'hot'} " + "x" * int(rng.integers(0, 300))) if i % 7 else (i, "a copy") for i in range(2500)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    text = dict(rows)
    groups = defaultdict(int)
    for i, t in rows:
        groups[hashlib.md5(t.encode()).hexdigest()] += len(t) + 8
    order = sorted(groups)
    assert out.groupby("shard")["size"].sum().max() == sharding.smallest_capacity(np.array([groups[g] for g in order]), 24)
    assert (out.text_crc32 == out.doc_id.map(lambda i: zlib.crc32(text[i].encode()))).all()
    at = {hashlib.md5(text[i].encode()).hexdigest(): s for i, s in zip(out.doc_id, out.shard)}
    assert [at[g] for g in order] == sorted(at[g] for g in order)
    assert out.groupby(out.doc_id.map(text))["shard"].nunique().max() == 1
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


def test_shards_odd_rows(docs, no_docs):
    out = sharding.shard(docs).collect()
    assert len(out) == 12 and sharding.shard(no_docs).isEmpty()
    empty = [r for r in out if r["size"] == 8]
    assert len(empty) == 3 and len({r["shard"] for r in empty}) == 1 and {r.text_crc32 for r in empty} == {0}


# URL filters


def test_hosts_paths_and_rules(spark):
    want = {
        "https://A.Example.NET/en/x?q=/de/#y": ("a.example.net", "/en/x", "example.net/en/", "allow"), "http://b.net/": ("b.net", "/", "net/", "block"), "http://net/q": ("net", "/q", "net/", "block"),
        "http://c.net": ("c.net", "", None, "allow"), "ftp://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"), "http://myexample.com/de/": ("myexample.com", "/de/", None, "allow"),
        "http://x.org/fr/a": ("x.org", "/fr/a", "org/fr/", "allow"), "http://x.org/fra": ("x.org", "/fra", None, "allow"), "no url": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "http://É.com?x": ("É.com", "", None, "allow"), "x://y://z/w": ("y:", "//z/w", None, "allow"), "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(want)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())
    assert urlfilter.judge(pages.where("false")).isEmpty()


def test_links_carry_distrust(spark):
    a = lambda *hosts: "".join(f'<p><A class=x HREF="https://{h}/p">x</a> <a href="/local">y</a>' for h in hosts)
    pages = [(1, "http://spam.net/x", a("farm.com")), (2, "http://farm.com/", a("SPAM.net", "farm.com")), (3, "http://good.com/", a("ok.example.net")), (4, "http://ok.example.net/en/", a("friend.com")), (5, "http://friend.com/x", None), (6, "http://far.com/", a("farm.com"))]
    out = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), threshold=0.2).collect()}
    assert out == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block"}


def test_propagation_equals_dense_sums(spark):
    rng = np.random.default_rng(2)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 12, (40, 2)) if a != b}
    seeds = [(str(i), float(i in (0, 1)), float(i in (5, 6))) for i in range(12)]
    got = {r.host: (r.trust, r.distrust) for r in urlfilter.propagate(spark.createDataFrame([(str(a), str(b)) for a, b in edges], "src string, dst string"), spark.createDataFrame(seeds, "host string, trust double, distrust double"), rounds=6, tolerance=0.0).collect()}
    for which, pairs in ((0, edges), (1, {(b, a) for a, b in edges})):
        m = np.zeros((12, 12))
        for a, b in pairs:
            m[b, a] = 1 / sum(x == a for x, _ in pairs)
        flow = np.array([s[1 + which] for s in seeds])
        total = flow.copy()
        for _ in range(6):
            flow = 0.85 * m @ flow
            total += flow
        for i in range(12):
            assert got.get(str(i), (0, 0))[which] == pytest.approx(total[i], abs=1e-9)


def linked_pages(seed=1):
    """Pages of 70 hosts, some of them seeds, that link to each other, with what looks like links but isn't."""
    rnd = random.Random(seed)
    hosts = [f"h{i}.com" for i in range(55)] + [f"bad{i}.net" for i in range(10)] + [f"good{i}.example.net" for i in range(5)]
    pages, links = [], []
    for i in range(400):
        host = rnd.choice(hosts)
        to = rnd.sample(hosts, rnd.choice([0, 1, 1, 2, 3])) + (rnd.sample(hosts[55:65], 2) if host in hosts[:12] else []) + (rnd.sample(hosts[:12], 1) if host in hosts[12:20] else [])
        fake = rnd.choice(hosts)
        body = "".join(rnd.choice([f"<a href='http://{t}/x'>", f'<A class="c" HREF = //{t.upper()}?q>', f'<a\nhref="https://{t}">', f"<a href=http://{t}/y#z>"]) + "t</a>" for t in to)
        body += rnd.choice([f'<a data-href="http://{fake}/">', f"<!-- <a href='http://{fake}/'> -->", f"<script>var x = '<a href=http://{fake}/>';</script>", f'<abbr href="//{fake}">', f"<style><a href='//{fake}'></style>", f"<!-- <a href='http://{fake}/'>"])
        pages.append((i, f"http://{host}/en/{i}", body))
        links += [(host, t) for t in to if t != host]
    return pages, set(links)


def test_verdicts_by_links_equal_dense_sums_and_sql(spark, tmp_path):
    import duckdb

    pages, edges = linked_pages()
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    assert {(r.src, r.dst) for r in urlfilter.host_edges(spark.read.parquet(f"{tmp_path}/pages.parquet")).collect()} == edges
    hosts = sorted({u.split("/")[2] for _, u, _ in pages} | {h for e in edges for h in e})
    at, score = {h: i for i, h in enumerate(hosts)}, []
    seen = {u.split("/")[2] for _, u, _ in pages}
    for good, pairs in ((True, edges), (False, {(b, a) for a, b in edges})):
        m = np.zeros((len(hosts), len(hosts)))
        for a, b in pairs:
            m[at[b], at[a]] = 1 / sum(x == a for x, _ in pairs)
        seed = np.array([float(h in seen and h.endswith("example.net" if good else ".net") and (good or "example" not in h)) for h in hosts])
        score.append(np.linalg.solve(np.eye(len(hosts)) - 0.85 * m, seed))
    apart = score[1] - score[0]
    assert np.abs(apart - 0.5).min() > 1e-6
    out = QUERIES["op10_link_graph"](spark, str(tmp_path))
    by_links = collections.Counter()
    for r in out.collect():
        if r.rule is None:
            assert r.verdict == ("block" if apart[at[r.host]] >= 0.5 else "allow"), r
            by_links[r.verdict] += 1
    assert min(by_links["block"], by_links["allow"]) > 20
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert_same(out, c.execute(ORACLE["op10_link_graph"]))


def test_walk_goes_on_until_verdicts_are_settled(spark):
    """Distrust that circles between two hosts passes the threshold after 20 rounds only: 0.85 * s / (1 - 0.85 ** 2)."""
    edges = spark.createDataFrame([("x", "seed"), ("x", "y"), ("y", "x")], "src string, dst string")
    seeds = spark.createDataFrame([("seed", 0.0, 0.164)], "host string, trust double, distrust double")
    short, judged = ({r.host: r.distrust for r in urlfilter.propagate(edges, seeds, **k).collect()} for k in ({"rounds": 20}, {"threshold": 0.5}))
    assert short["x"] < 0.5 <= judged["x"] <= 0.164 * 0.85 / (1 - 0.85**2)


def test_small_flows_add_up(spark):
    seeds = spark.createDataFrame([(str(i), 0.0, 8e-7) for i in range(1000)], "host string, trust double, distrust double")
    edges = spark.createDataFrame([("x", str(i)) for i in range(1000)], "src string, dst string")
    got = {r.host: r.distrust for r in urlfilter.propagate(edges, seeds).collect()}
    split = spark.createDataFrame([(f"h{i}", "s") for i in range(1000)] + [("t", f"h{i}") for i in range(1000)], "src string, dst string")
    far = {r.host: r.distrust for r in urlfilter.propagate(split, spark.createDataFrame([("s", 0.0, 1e-3)], "host string, trust double, distrust double")).collect()}
    assert got["x"] == pytest.approx(1000 * 8e-7 * 0.85) and far["t"] == pytest.approx(1e-3 * 0.85**2)


def test_words_are_counted_as_told(spark):
    text = "a\u00a0b c\x0bd  e\x1cf\n"
    out = mixing.mix(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
    assert out["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text)) == 4


@pytest.mark.parametrize("name", ["op4_mix_sources", "op10_link_graph"])
def test_native_plans_have_no_python(name, spark, data):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", plan)
