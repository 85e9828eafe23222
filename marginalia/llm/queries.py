"""The numbered queries, each its operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embeddings, kneser_ney, merkle, packing, periodic_runs, quality_rules, repeats, secrets, simhash, suffix_tree, token_counts, toxicity
from .common import table

#: Sources get windows by their tokens to this power: less of the largest ones, more of the small, than in the corpus.
MIXTURE = 0.7


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rid")


def op3_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), alpha=MIXTURE)


def op5_suffix_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scored(table(spark, sf_dir, "documents"))


def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def digested_runs(found: DataFrame) -> DataFrame:
    """Of what periodic_runs() returns, the numbers and digests of the runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", F.floor(1000 * F.col("length") / F.col("period")).alias("exponent_milli"),
        F.sha2(F.when(F.col("n_runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested_runs(periodic_runs.periodic_runs(periodic_runs.repeated_tail(table(spark, sf_dir, "documents"))))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def checked_proofs(found: DataFrame) -> DataFrame:
    """Of what proofs() returns, the digest of the siblings and the root that the tampered leaf folds to."""
    folded = found.withColumn("folded_root", merkle.folded(F.col("tampered_leaf"), F.col("way")))
    return folded.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("way")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked_proofs(merkle.proofs(table(spark, sf_dir, "documents")))


def base_quality_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9 returns of each text before the learned rules: the part that SQL can check."""
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return op9_quality_rules(spark, sf_dir).select(*columns)


def base_secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1's counts of fixed patterns, the part that SQL can check."""
    return op1_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_kneser_ney_quality": op3_kneser_ney_quality,
    "op4_mixture_packing": op4_mixture_packing,
    "op5_suffix_tree_scoring": op5_suffix_tree_scoring,
    "op6_suffix_repeats": op6_suffix_repeats,
    "op7_toxicity": op7_toxicity,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
    "base_quality_stats": base_quality_stats,
    "base_secret_counts": base_secret_counts,
}

_WS = "[\\x20\\x09-\\x0D]"
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
_FIELD = "coalesce(octet_length(encode({0}))::VARCHAR || ':' || {0}, '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{text}"))
ORACLES: dict[str, str] = {
    "op12_embedding_near_dedup": """WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        u AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        p AS (SELECT a.r AS a, b.r AS b, b.vec_id AS id FROM u a JOIN u b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
        c AS (SELECT r AS a, r AS b, vec_id AS id FROM v UNION SELECT c.a, p.b, p.id FROM c JOIN p ON c.b = p.a),
        m AS (SELECT a, min(id) AS component_id FROM c GROUP BY a), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN m ON v.r = m.a LEFT JOIN n ON v.r = n.a""",
    "op13_merkle_manifest": f"""WITH RECURSIVE bits AS (SELECT range AS n, range AS c, 0 AS k FROM range(256) UNION ALL
            SELECT n, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
        crc AS (SELECT list(c ORDER BY n) AS crc FROM bits WHERE k = 8),
        d AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0 AS even FROM documents, crc),
        h AS (SELECT doc_id, source, sha256({_LEAF.format(text="text")}) AS leaf, sha256({_LEAF.format(text="CASE WHEN even THEN replace(text, chr(10), '') ELSE text END")}) AS changed FROM d),
        l AS (SELECT *, row_number() OVER o - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM h WINDOW o AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)),
        t AS (SELECT source, 0 AS level, r AS i, leaf AS h, n FROM l UNION ALL
            SELECT source, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY source, level, i // 3, n),
        s AS (SELECT source, h AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r FROM t WHERE n = 1),
        u AS (SELECT 0 AS level, r AS i, subroot AS h, (SELECT count(*) FROM s) AS n FROM s UNION ALL
            SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY level, i // 3, n),
        a AS (SELECT l.source, l.r, t.level, coalesce(string_agg(t.h, '' ORDER BY i) FILTER (i < l.r // (3 ** t.level)::BIGINT), '') AS lh, coalesce(string_agg(t.h, '' ORDER BY i) FILTER (i > l.r // (3 ** t.level)::BIGINT), '') AS rh
            FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source AND t.n > 1 AND t.i // 3 = l.r // (3 ** (t.level + 1))::BIGINT GROUP BY ALL),
        b AS (SELECT s.source, u.level, coalesce(string_agg(u.h, '' ORDER BY i) FILTER (i < s.r // (3 ** u.level)::BIGINT), '') AS lh, coalesce(string_agg(u.h, '' ORDER BY i) FILTER (i > s.r // (3 ** u.level)::BIGINT), '') AS rh
            FROM s JOIN u ON u.n > 1 AND u.i // 3 = s.r // (3 ** (u.level + 1))::BIGINT GROUP BY ALL),
        w AS (SELECT source, r, list(lh || '|' || rh ORDER BY level) AS x FROM a GROUP BY ALL),
        v AS (SELECT source, list(lh || '|' || rh ORDER BY level) AS x FROM b GROUP BY ALL),
        p AS (SELECT l.doc_id, l.leaf, l.changed, s.subroot, (SELECT h FROM u WHERE n = 1) AS root, list_concat(coalesce(w.x, []), coalesce(v.x, [])) AS x
            FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source LEFT JOIN w ON l.source IS NOT DISTINCT FROM w.source AND l.r = w.r LEFT JOIN v ON l.source IS NOT DISTINCT FROM v.source),
        f AS (SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(x, ''), '|', '')) AS proof_sha256,
            list_reduce(list_prepend(changed, x), lambda acc, y: sha256(split_part(y, '|', 1) || acc || split_part(y, '|', 2))) AS folded_root FROM p)
        SELECT *, folded_root = root AS verified FROM f""",
    "base_quality_stats": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        s AS (SELECT *, list_filter(regexp_split_to_array(t, '{_WS}+'), lambda w: w <> '') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
        w AS (SELECT r, len(ws) AS n, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM s),
        g AS (SELECT *, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
        f AS (SELECT r, i, i <= n - 3 AND count(*) OVER (PARTITION BY r, word, b, c, i <= n - 3) >= 2 AS f FROM g),
        p AS (SELECT r, count(*) FILTER (f OR f1 OR f2) AS repeated FROM (SELECT r, f, coalesce(lag(f, 1) OVER o, false) AS f1, coalesce(lag(f, 2) OVER o, false) AS f2 FROM f WINDOW o AS (PARTITION BY r ORDER BY i)) GROUP BY r)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, length(regexp_replace(t, '{_WS}', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(repeated, 0) AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(repeated, 0) > 50 * len(ws) AS base_failed FROM s LEFT JOIN p USING (r)""",
    "base_secret_counts": f"""SELECT doc_id, CAST(len(list_filter(regexp_extract_all(t, '({_EITHER})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS BIGINT) AS n_assign,
        CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_access, CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 32)) AS BIGINT) AS n_hex
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
}
