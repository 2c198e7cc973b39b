"""The queries opN_<name> and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import importance, lines, manifest, media, mixing, packing, pages, quantise, repair, simhash, substrings, toxicity, warc
from .common import materialize, read, word_count


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.inspect(media.encode(read(spark, sf_dir, "documents")))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return mixing.mix(sized, F.array("source"), F.col("size")).select("doc_id", "size", "source_size", "target", "taken")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_repeated(read(spark, sf_dir, "documents"), counts=True)
    return kept.select("doc_id", "n_lines", "n_dropped", "text")


def op3_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return quantise.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op5_repair_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.read_shards(repair.write_shards(read(spark, sf_dir, "documents")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(read(spark, sf_dir, "documents"))


def op8_html_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read(spark, sf_dir, "pages"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.fit(docs, read(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    claimed = manifest.leaf(*(F.col(n) + 1 if n == "n_chars" else F.col(n) for n in names))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = manifest.manifest(read(spark, sf_dir, "documents"), names, "lang", "doc_id", claims=F.when(tampered, claimed))
    return out.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op12_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.index(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_line_dedup": op2_line_dedup,
    "op3_additive_quantisation": op3_additive_quantisation,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_repair_token_output": op5_repair_token_output,
    "op6_media_columns": op6_media_columns,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_html_page_differencing": op8_html_page_differencing,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_warc_archives": op12_warc_archives,
    "op13_importance_resampling": op13_importance_resampling,
}

#: DuckDB's edit distance counts bytes: letters of two bytes are made one byte that no text holds.
_LETTERS = "äöüßÄÖÜéèêçÉÈÊÇñíóúáÑÍÓÚÁ"
_ONE_BYTE = " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 32)][: len(_LETTERS)])

OP2_SQL = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
f AS (SELECT line, translate(line, '{_LETTERS}', {_ONE_BYTE}) AS plain, min({{'d': doc_id, 'p': pos}}) AS first, length(line) AS n
  FROM l WHERE regexp_matches(line, '\\S') GROUP BY line),
near AS (SELECT DISTINCT b.line FROM f a JOIN f b ON a.n BETWEEN b.n - 2 AND b.n + 2 AND a.first < b.first AND least(a.n, b.n) >= 20
  WHERE levenshtein(a.plain, b.plain) <= least(2, least(a.n, b.n) // 20)),
k AS (SELECT l.*, f.line IS NOT NULL AND (f.first <> {{'d': l.doc_id, 'p': l.pos}} OR near.line IS NOT NULL) AS gone FROM l LEFT JOIN f USING (line) LEFT JOIN near USING (line))
SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM k GROUP BY doc_id"""

#: Unsigned crc32 of a decimal number, a byte at a time; the constant is the checksum's reversed polynomial.
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda a, c: list_reduce(range(8), lambda b, k: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END, xor(a, c)), 4294967295::BIGINT))"""


def _leaf_sql(n_chars: str) -> str:
    values = ["doc_id", "source", "lang", n_chars, "text"]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(CAST({v} AS VARCHAR))) || ':' || CAST({v} AS VARCHAR), '-')" for v in values) + ")"


def _tree_sql(name: str, leaves: str, group: str) -> str:
    """name: nodes (group, level, i, h, n) up to the last one of each group."""
    return f"""{name} AS (SELECT {group} AS g, 0 AS level, i, h, n FROM {leaves} UNION ALL
  SELECT g, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY g, level, i // 2)"""


OP11_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf_sql('n_chars')} AS h, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf_sql('n_chars + 1')} END AS claim FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d), {_tree_sql('t', 'l', 'lang')},
s AS (SELECT g AS lang, h, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1), {_tree_sql('u', 's', '0')},
f AS (SELECT doc_id, l.i AS leaf_i, l.lang, 0 AS tree, 0 AS level, l.i AS i, l.n AS n, coalesce(claim, h) AS acc, '' AS proof FROM l UNION ALL
  SELECT f.doc_id, f.leaf_i, f.lang, CASE WHEN f.n > 1 THEN f.tree ELSE 1 END, CASE WHEN f.n > 1 THEN f.level + 1 ELSE 0 END, CASE WHEN f.n > 1 THEN f.i // 2 ELSE s.i END,
    CASE WHEN f.n > 1 THEN (f.n + 1) // 2 ELSE s.n END, CASE WHEN f.n = 1 THEN f.acc WHEN f.i % 2 = 0 THEN sha256(f.acc || coalesce(x.h, y.h, '')) ELSE sha256(coalesce(x.h, y.h) || f.acc) END,
    f.proof || CASE WHEN f.n > 1 THEN coalesce(x.h, y.h, '') ELSE '' END
  FROM f JOIN s ON s.lang IS NOT DISTINCT FROM f.lang
  LEFT JOIN t x ON f.tree = 0 AND x.g IS NOT DISTINCT FROM f.lang AND x.level = f.level AND x.i = xor(f.i, 1) LEFT JOIN u y ON f.tree = 1 AND y.level = f.level AND y.i = xor(f.i, 1)
  WHERE f.n > 1 OR f.tree = 0)
SELECT f.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.acc AS folded_root, f.acc = r.h AS verified
FROM f JOIN l ON l.lang IS NOT DISTINCT FROM f.lang AND l.i = f.leaf_i JOIN s ON s.lang IS NOT DISTINCT FROM f.lang JOIN (SELECT h FROM u WHERE n = 1) r ON true WHERE f.tree = 1 AND f.n = 1"""

#: Base32 takes five bits of the digest a letter: four letters for each five hex digits.
OP12_SQL = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(((('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INTEGER), 5))::INTEGER >> CAST(15 - i % 4 * 5 AS INTEGER)) & 31) + 1 AS INTEGER), 1)), 'string_agg', '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)"""

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_warc_archives": OP12_SQL,
}
