"""The registered queries of this subpackage, each over its whole table, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustframe.llm import hamming, language, licenses, merkle, mixing, near_dedup, packing, quality, secretscan, tokens, toxicity, whitening
from gustframe.llm.common import prepare
from gustframe.llm.decontaminate import contamination

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_path():
    """documents as a tree: source / language / hundred of ids / id."""
    part = lambda c: F.coalesce(F.regexp_replace(F.col(c), "/", "_"), F.lit("_"))
    return F.concat_ws("/", part("source"), part("lang"), F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))


def op1_license_scan(spark, sf_dir):
    return licenses.license_scan(table(spark, sf_dir, "documents"), document_path())


def op2_token_output(spark, sf_dir):
    return tokens.token_output(table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    return toxicity.by_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_language_id(spark, sf_dir):
    return language.by_language(table(spark, sf_dir, "documents"))


def op6_hamming_top_k(spark, sf_dir):
    return hamming.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op7_near_duplicates(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark, sf_dir):
    return quality.by_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark, sf_dir):
    return secretscan.secrets(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), is_tampered=tampered)


def op12_embedding_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    import corpus_pipeline
    own = [op1_license_scan, op2_token_output, op3_toxicity, op4_decontamination, op5_language_id, op6_hamming_top_k,
           op7_near_duplicates, op8_quality, op9_mixing, op10_secret_scan, op11_merkle_manifest, op12_embedding_whitening, op13_best_fit_packing]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_OP4 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n,
               array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT a.doc_id, a.i, a.n, win.item_id FROM places a JOIN win ON win.n = a.n AND win.s = array_to_string(a.w[a.i:a.i + a.n - 1], ' ')),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(x.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(x.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit h USING (doc_id) LEFT JOIN items x USING (doc_id)"""

_OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, comp.component_id, d.doc_id = comp.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)"""

_OP9 = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_SPACED})) AS BIGINT) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS s,
               [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS w FROM d GROUP BY source),
filled AS (SELECT *, 3.0::DOUBLE * s / w AS ratio, (SELECT sum(s) FROM src) AS total FROM src),
steps AS (SELECT *, coalesce(sum(3 * s) OVER lower_ratio, 0) AS full_words,
                 (SELECT sum(w) FROM src) - coalesce(sum(w) OVER lower_ratio, 0) AS open_weight
          FROM filled WINDOW lower_ratio AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT full_words, open_weight FROM steps WHERE CAST(total - full_words AS DOUBLE) / open_weight <= ratio ORDER BY ratio, source IS NULL, source LIMIT 1),
goal AS (SELECT source, s, CASE WHEN CAST(total - level.full_words AS DOUBLE) * w / level.open_weight > 3 * s THEN CAST(3 * s AS DOUBLE)
                                ELSE CAST(total - level.full_words AS DOUBLE) * w / level.open_weight END AS target FROM filled, level),
need AS (SELECT *, CASE WHEN s > 0 THEN CAST(floor(target) AS BIGINT) // s ELSE 0 END AS copies,
                CASE WHEN s > 0 THEN CAST(floor(target) AS BIGINT) % s ELSE 0 END AS rest FROM goal),
run AS (SELECT d.*, need.s, need.target, need.copies, need.rest,
               sum(size) OVER (PARTITION BY d.source ORDER BY key, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
        FROM d JOIN need ON d.source IS NOT DISTINCT FROM need.source),
gap AS (SELECT source, max(rest) - coalesce(max(CASE WHEN upto <= rest THEN upto END), 0) AS missing FROM run GROUP BY source),
fill AS (SELECT source, min((abs(size - missing), key, size)) AS best
         FROM (SELECT run.*, gap.missing FROM run JOIN gap ON run.source IS NOT DISTINCT FROM gap.source)
         WHERE rest > 0 AND upto > rest AND size > 0 AND abs(size - missing) < missing GROUP BY source)
SELECT run.doc_id, run.size, CAST(run.s AS BIGINT) AS source_size, run.target,
       CAST(run.size * (run.copies + CASE WHEN rest > 0 AND (upto <= rest OR (fill.best[2] = key AND fill.best[3] = size)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run LEFT JOIN fill ON run.source IS NOT DISTINCT FROM fill.source"""

_OP6 = """
WITH c AS (SELECT vec_id, [x > 0 for x in embedding] AS b FROM embeddings WHERE len(embedding) > 0),
pairs AS (SELECT q.vec_id, c.vec_id AS neighbour,
                 CAST(list_sum([CASE WHEN q.b[i] <> c.b[i] THEN 1 ELSE 0 END for i in range(1, 65)]) AS BIGINT) AS distance
          FROM c q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT vec_id, rank, neighbour, distance
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM pairs) WHERE rank <= 10"""

_SIZED = "coalesce(octet_length(encode({0}))::VARCHAR || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_SIZED.format(c) for c in ("doc_id::VARCHAR", "source", "lang", "{0}::VARCHAR", "text")) + ")"
_LEVELS_UP = """{0} AS (SELECT g, 0 AS lvl, pos, n, h FROM {1} UNION ALL
  SELECT g, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {0} WHERE n > 1 GROUP BY g, lvl, pos // 2, n)"""
_STEPS = """SELECT l.id, {2} + own.lvl AS lvl, CASE WHEN sib.h IS NULL THEN 'N' WHEN sib.pos < own.pos THEN 'L' || sib.h ELSE 'R' || sib.h END AS step
  FROM {0} l JOIN {1} own ON own.g = l.g AND own.pos = l.pos >> own.lvl AND own.n > 1
  LEFT JOIN {1} sib ON sib.g = own.g AND sib.lvl = own.lvl AND sib.pos = xor(own.pos, 1)"""

_OP11 = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
d AS (SELECT doc_id, lang, {_LEAF.format("n_chars")} AS h, {_LEAF.format("(n_chars + 1)")} AS other,
             xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                 lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 7 = 0 AS tampered FROM documents, crc),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS g, count(*) OVER () AS groups, n
          FROM (SELECT lang, count(*) AS n FROM d GROUP BY lang)),
leaves AS (SELECT row_number() OVER () AS id, d.*, g, n, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos
           FROM d JOIN langs ON d.lang IS NOT DISTINCT FROM langs.lang),
{_LEVELS_UP.format("up", "leaves")},
subs AS (SELECT up.g AS id, 0 AS g, up.g AS pos, groups AS n, h FROM up JOIN langs ON langs.g = up.g WHERE up.n = 1),
{_LEVELS_UP.format("top", "subs")},
steps AS ({_STEPS.format("leaves", "up", 0)} UNION ALL
  SELECT leaves.id, s.lvl, s.step FROM ({_STEPS.format("subs", "top", 1000)}) s JOIN leaves ON leaves.g = s.id),
proofs AS (SELECT id, list(step ORDER BY lvl) AS steps, sha256(string_agg(step[2:], '' ORDER BY lvl)) AS proof_sha256 FROM steps GROUP BY id),
rows AS (SELECT doc_id, leaves.h AS leaf, subs.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root,
       coalesce(proof_sha256, sha256('')) AS proof_sha256,
       list_reduce(coalesce(steps, []), lambda f, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || f WHEN 'R' THEN f || s[2:] ELSE f END),
                   CASE WHEN coalesce(tampered, false) AND other IS NOT NULL THEN other ELSE leaves.h END) AS folded_root
FROM leaves JOIN subs ON subs.id = leaves.g LEFT JOIN proofs ON proofs.id = leaves.id)
SELECT *, folded_root = root AS verified FROM rows"""


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": _OP4, "op6_hamming_top_k": _OP6, "op7_near_duplicates": _OP7, "op9_mixing": _OP9,
            "op11_merkle_manifest": _OP11}
