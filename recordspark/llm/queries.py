"""The queries of this folder, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, bpe, html_extract, langid, media, minhash, mixing, sharding, urlfilter, warc
from .shared import stored, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html_main_text(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_vp_tree_neighbours(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, factor=1.0)


def op3_bpe_round_trip(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_warc_zstd(spark, sf_dir):
    archives = warc.write(table(spark, sf_dir, "pages"), least=0)
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_order_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_minimax_shards(spark, sf_dir):
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=24, overhead=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_avi_mjpeg(spark, sf_dir):
    return media.digests(stored(media.write_column(table(spark, sf_dir, "documents")), "media"))


def op9_language_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs, model).select("doc_id", "lang_pred", "score")
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_link_graph(spark, sf_dir):
    return urlfilter.judge(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (op1_html_main_text, op2_vp_tree_neighbours, op3_bpe_round_trip, op4_mix_sources, op5_warc_zstd, op6_order_minhash, op7_minimax_shards, op8_avi_mjpeg, op9_language_mixture, op10_link_graph)
}


def mixing_sql(seed: int = 7) -> str:
    """The same mix: water-filling over sources, then over the length classes of each, and one running sum over each source in Pareto order."""
    return f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
     i AS (SELECT *, CAST(length(bin(size)) AS DOUBLE) AS w,
                  greatest(CAST(('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || size || ':' || row_number() OVER (PARTITION BY doc_id, source, size)), 1, 13)) AS BIGINT) / CAST({2**52} AS DOUBLE), {2.0**-53!r}) AS u,
                  row_number() OVER (PARTITION BY doc_id, source, size) AS number FROM d),
     s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
     w AS (SELECT *, CASE (row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight,
                  row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) AS turn, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s),
     f AS (SELECT *, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weight_left, budget - coalesce(sum(cap) OVER b, 0) AS size_left
           FROM w WINDOW b AS (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     g AS (SELECT *, size_left * weight >= cap * weight_left AS is_full FROM f),
     l AS (SELECT size_left AS l_size, weight_left AS l_weight FROM g WHERE NOT is_full ORDER BY cap / weight, turn LIMIT 1),
     t AS (SELECT source, source_size, CASE WHEN is_full OR l_weight IS NULL THEN cap ELSE least(l_size * weight / l_weight, cap) END AS target FROM g LEFT JOIN l ON true),
     c AS (SELECT i.source, w, source_size, target, CAST(sum(size) AS DOUBLE) AS words FROM i JOIN t ON i.source IS NOT DISTINCT FROM t.source GROUP BY ALL),
     cl AS (SELECT *, target - 2.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
                   sum(words * w) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_below FROM c),
     cf AS (SELECT *, weight_below <= 0 OR words_left * w >= 2.0::DOUBLE * weight_below * (1 - 1e-9::DOUBLE) AS is_full FROM cl),
     ce AS (SELECT *, CASE WHEN is_full THEN 2.0::DOUBLE ELSE least(2.0::DOUBLE, w * arg_max(CASE WHEN NOT is_full THEN words_left / weight_below END, CASE WHEN NOT is_full THEN w END) OVER (PARTITION BY source)) END AS expected FROM cf),
     cc AS (SELECT *, CAST(floor(expected + 1e-9::DOUBLE) AS BIGINT) AS certain FROM ce),
     cp AS (SELECT *, CASE WHEN expected - certain > 1e-9::DOUBLE THEN expected - certain ELSE 0.0::DOUBLE END AS p, target - sum(certain * words) OVER (PARTITION BY source) AS rest FROM cc),
     r AS (SELECT i.doc_id, i.source, i.size, i.number, cp.source_size, cp.target, certain, rest, p, CASE WHEN p > 0 THEN u / (1 - u) / (p / (1 - p)) END AS rank
           FROM i JOIN cp ON i.source IS NOT DISTINCT FROM cp.source AND i.w = cp.w),
     o AS (SELECT *, coalesce(sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source, p > 0 ORDER BY rank, doc_id NULLS FIRST, size, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT doc_id, size, source_size, target, CAST((certain + CASE WHEN p > 0 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM o"""


NEAREST_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     asked AS (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS rank
  FROM asked q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)) WHERE rank <= 20"""

WARC_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
     f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(p.hex || '00', CAST(i * 5 // 4 AS INTEGER) + 1, 3) AS INTEGER) >> CAST(7 - i * 5 % 4 AS INTEGER)) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (hex)"""


def links_sql(rounds: int = 40, damping: float = 0.85, tolerance: float = 0.0, threshold: float = 0.5) -> str:
    """The walk of urlfilter.propagate, a common table for each round."""
    after = "substr(url, instr(url, '://') + 3)"
    lower = lambda x: f"translate({x}, '{urlfilter.UPPER}', '{urlfilter.LOWER}')"
    rule = "CASE " + " ".join(
        f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{prefix}') THEN '{rule}'"
        for _, rule in sorted(urlfilter.RULES, key=lambda x: -len(x[1])) for name, _, prefix in [rule.partition("/")]
    ) + " END"
    said = "CASE rule " + " ".join(f"WHEN '{rule}' THEN '{what}'" for what, rule in urlfilter.RULES) + " END"
    link, hidden = (x.replace("'", "''") for x in (urlfilter.LINK, urlfilter.HIDDEN))
    tables = [
        f"p AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN {lower(f"regexp_extract({after}, '^[^/?#]*')")} ELSE '' END AS host, CASE WHEN instr(url, '://') > 0 THEN regexp_extract({after}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages)",
        f"j AS (SELECT page_id, host, path, rule, {said} AS said FROM (SELECT page_id, host, path, {rule} AS rule FROM p))",
        f"e AS (SELECT DISTINCT host AS src, {lower('dst')} AS dst FROM (SELECT host, unnest(regexp_extract_all(regexp_replace(html, '{hidden}', ' ', 'g'), '{link}', 1)) AS dst FROM p) WHERE host <> '' AND dst <> '' AND host <> {lower('dst')})",
        "n AS (SELECT *, count(*) OVER (PARTITION BY good, here) AS degree FROM (SELECT true AS good, src AS here, dst AS there FROM e UNION ALL SELECT false, dst, src FROM e))",
        "f0 AS (SELECT * FROM (SELECT true AS good, host, avg(CASE WHEN said = 'allow' THEN 1.0 ELSE 0 END) AS score FROM j WHERE host <> '' GROUP BY host UNION ALL SELECT false, host, avg(CASE WHEN said = 'block' THEN 1.0 ELSE 0 END) FROM j WHERE host <> '' GROUP BY host) WHERE score > 0)",
        *(f"f{i} AS (SELECT * FROM (SELECT n.good, there AS host, round(sum(score * {damping} / degree), 12) AS score FROM f{i - 1} JOIN n ON f{i - 1}.good = n.good AND host = here GROUP BY ALL) WHERE score > {tolerance})" for i in range(1, rounds + 1)),
        "a AS (" + " UNION ALL ".join(f"SELECT * FROM f{i}" for i in range(rounds + 1)) + ")",
        f"b AS (SELECT host FROM a GROUP BY host HAVING sum(CASE WHEN good THEN 0 ELSE score END) - sum(CASE WHEN good THEN score ELSE 0 END) >= {threshold})",
    ]
    return f"WITH {', '.join(tables)} SELECT page_id, host, path, rule, coalesce(said, CASE WHEN b.host IS NOT NULL THEN 'block' END, 'allow') AS verdict FROM j LEFT JOIN b USING (host)"


ORACLE = {"op2_vp_tree_neighbours": NEAREST_SQL, "op4_mix_sources": mixing_sql(), "op5_warc_zstd": WARC_SQL, "op10_link_graph": links_sql()}
