"""Registered queries of the training-data operators, and the DuckDB SQL of those that have one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.session import fresh_path
from lectern.llm import (
    decontaminate,
    language_id,
    license_scan,
    lm_score,
    manifest,
    near_dup,
    packing,
    quality_qda,
    quality_rules,
    substring_dedup,
    token_counts,
    warc,
    whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = quality_qda.held_out(3)
    found = language_id.predict(docs, language_id.learn(docs, among=~held_out), keep=("doc_id",))
    found = found.select("doc.doc_id", "lang_pred", "score")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    found = decontaminate.decontaminate(docs, items, keep=("doc_id",))
    return found.select("doc.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP2_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
bw AS (
  SELECT item_id, list_filter(string_split(regexp_replace(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
bx AS (
  SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, greatest(2, len(w) - 8)), lambda i: array_to_string(w[i:i+9], ' '))) AS win FROM bw WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bx),
dx AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM dw, sizes WHERE len(w) >= n),
hits AS (
  SELECT d.doc_id, d.n, d.i, b.item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS win FROM dx) d JOIN bx b ON b.win = d.win AND b.n = d.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(item_id) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_qda.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), keep=("doc_id",))
    scored = scored.select("doc.doc_id", "score", "predicted")
    return scored.select("doc_id", quality_qda.held_out(3).alias("held_out"), "score", "predicted")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = quality_qda.held_out(5)
    scored = lm_score.score(_table(spark, sf_dir, "documents"), keep=("doc_id",), learn=~held_out)
    scored = scored.select("doc.doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.summarise(license_scan.scan(_table(spark, sf_dir, "documents"), keep=("doc_id",)))
    return found.select("doc.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicate(_table(spark, sf_dir, "documents"), keep=("doc_id",))
    return found.select("doc.doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
least AS (SELECT k, min(doc_id) AS owner FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (k) WHERE owner < doc_id),
lost AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    found = warc.read_archives(spark, path, with_payload=False).where("kind = 'record'")
    return found.select(
        F.col("page_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


OP7_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (SELECT page_id, strlen(payload)::BIGINT AS n, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS top FROM p),
d AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, 1 + 5 * i, 5))::BIGINT) AS vs FROM h)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(vs, lambda v:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(_table(spark, sf_dir, "documents"), keep=("doc_id",), added_tokens=True)
    return placed.select("doc.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    judged = quality_rules.judge(docs, quality_rules.fit(docs, _table(spark, sf_dir, "labels")), keep=("doc_id",))
    return judged.select("doc.doc_id", *quality_rules.STATISTICS, "base_failed", "kept", "score")


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.classes(_table(spark, sf_dir, "documents"), keep=("doc_id",))
    return found.members.select("doc_id", "class_id", "kept")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.count(_table(spark, sf_dir, "documents"), keep=("doc_id",))
    return found.select("doc.doc_id", "n_bytes", "n_tokens", "over_limit")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = manifest.build(_table(spark, sf_dir, "documents"), tampered=tampered)
    return made.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


OP12_SQL = r"""
WITH RECURSIVE
table_of AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs),
fields AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS tree, n_chars,
    list_transform([doc_id::VARCHAR, source, lang], lambda x: coalesce(strlen(x) || ':' || x, '-')) AS before,
    coalesce(strlen(text) || ':' || text, '-') AS last,
    list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT) AS digits
  FROM documents),
made AS (
  SELECT doc_id, tree,
    sha256(array_to_string(before, '') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || last) AS leaf,
    sha256(array_to_string(before, '') || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || last) AS other,
    xor(list_reduce(list_prepend(4294967295, digits), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS bad
  FROM fields, table_of),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM made),
up(tree, lvl, i, h, n) AS (
  SELECT tree, 0, i, leaf, n FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY tree, lvl, i // 2, n),
subroots AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top(lvl, i, h, n) AS (
  SELECT 0, i, h, n FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, i // 2, n),
root AS (SELECT h FROM top WHERE n = 1),
own AS (
  SELECT l.tree, l.i, v.lvl AS k, CASE WHEN s.h IS NULL THEN 'N' WHEN s.i < l.i >> v.lvl THEN 'L' ELSE 'R' END AS side, s.h
  FROM leaves l JOIN (SELECT DISTINCT tree, lvl FROM up WHERE n > 1) v USING (tree)
  LEFT JOIN up s ON s.tree = l.tree AND s.lvl = v.lvl AND s.i = xor(l.i >> v.lvl, 1)),
shared AS (
  SELECT r.tree, 1000 + v.lvl AS k, CASE WHEN s.h IS NULL THEN 'N' WHEN s.i < r.i >> v.lvl THEN 'L' ELSE 'R' END AS side, s.h
  FROM subroots r CROSS JOIN (SELECT DISTINCT lvl FROM top WHERE n > 1) v
  LEFT JOIN top s ON s.lvl = v.lvl AND s.i = xor(r.i >> v.lvl, 1)),
steps AS (
  SELECT tree, i, k, side, h FROM own
  UNION ALL
  SELECT l.tree, l.i, k, side, h FROM leaves l JOIN shared USING (tree)),
paths AS (
  SELECT tree, i, list(side || coalesce(h, '') ORDER BY k) AS path, coalesce(string_agg(h, '' ORDER BY k), '') AS told FROM steps GROUP BY tree, i),
done AS (
  SELECT l.doc_id, l.leaf, r.h AS subroot, root.h AS root, sha256(coalesce(told, '')) AS proof_sha256,
    list_reduce(list_prepend(CASE WHEN bad THEN other ELSE leaf END, coalesce(path, [])), lambda a, e: CASE e[1] WHEN 'L' THEN sha256(substr(e, 2) || a) WHEN 'R' THEN sha256(a || substr(e, 2)) ELSE sha256(a) END) AS folded_root
  FROM leaves l LEFT JOIN paths p ON p.tree = l.tree AND p.i = l.i JOIN subroots r ON r.tree = l.tree CROSS JOIN root)
SELECT *, folded_root = root AS verified FROM done
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"), keep=("vec_id",))
    return found.select("doc.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_lm_score": op4_lm_score,
    "op5_license_scan": op5_license_scan,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_warc": op7_warc,
    "op8_packing": op8_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_near_dup": op10_near_dup,
    "op11_token_counts": op11_token_counts,
    "op12_manifest": op12_manifest,
    "op13_whitening": op13_whitening,
}

ORACLES = {
    "op12_manifest": OP12_SQL,
    "op7_warc": OP7_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op2_decontamination": OP2_SQL,
}
