"""The registered queries opN_<name>: thin, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propval.llm import chat, interactions, katz, licenses, merkle, minhash, mixing, pii, quality, sentencepiece_viterbi, topk, toxicity, urls
from propval.session import literal_table, table, written


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken", "first_shard")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).drop("text", "lang")


def op4_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.usable(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.encoded(table(spark, sf_dir, "documents"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("row")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    own = literal_table(spark, [(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = chat.formatted(chat.as_replies(rows))
    said = F.concat_ws("", F.transform(chat.turns_of(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    learned = chat.learned_text(F.col("formatted"), F.col("loss"))
    return out.select(
        "conv_id",
        F.size(chat.turns_of(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scored(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measures = written(quality.measured(docs).drop("text"), "quality")
    voted = quality.votes(measures)
    model = quality.fit(voted.where(~quality.base_failed()), len(quality.RULES))
    p = quality.posterior(model)
    return voted.withColumns({"base_failed": quality.base_failed(), "p_good": p}).select(
        "doc_id", *quality.METRICS, "base_failed", (~F.col("base_failed") & (F.col("p_good") >= 0.5)).alias("kept"), "p_good", "votes"
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.manifest(table(spark, sf_dir, "documents"), carried={"tampered": merkle.tampered_leaf()})
    return merkle.verified(rows).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(interactions.cells(interactions.masked(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.found(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long")
    return rows.select("doc_id", *[n(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)], F.sha2(pii.listed(F.col("base_spans")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_mix_sources": op2_mix_sources,
        "op3_toxicity": op3_toxicity,
        "op4_top_k_search": op4_top_k_search,
        "op5_url_filters": op5_url_filters,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_license_scans": op7_license_scans,
        "op8_chat_formatting": op8_chat_formatting,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_quality_rules": op10_quality_rules,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_filter_interactions": op12_filter_interactions,
        "op13_pii": op13_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": OP1_SQL, "op4_top_k_search": OP4_SQL, "op8_chat_formatting": OP8_SQL, "op11_merkle_manifest": OP11_SQL, "op12_filter_interactions": OP12_SQL}


#: All pairs of texts that share a shingle, and the closure of their links.
OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT text, min(doc_id) AS id, any_value(w) AS w FROM d WHERE len(w) > 0 GROUP BY text),
s AS (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: md5(array_to_string(list_slice(w, i, i + 4), ' ')))) AS g FROM t),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.id = p.a JOIN n y ON y.id = p.b WHERE CAST(c AS DOUBLE) / (x.n + y.n - c) >= 0.8::DOUBLE),
r(id, other) AS (SELECT id, id FROM t UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
k AS (SELECT id, min(other) AS class_id, count(*) AS n_texts FROM r GROUP BY id)
SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, coalesce(k.n_texts, 1) AS n_texts FROM d LEFT JOIN t ON t.text = d.text AND len(d.w) > 0 LEFT JOIN k ON k.id = t.id
"""

OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP8_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\|[A-Za-z0-9_]*\||/?s>|start_of_turn>|end_of_turn>|bos>|eos>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g'), '<(</?SYS>>)', '<\\\1', 'g') AS safe FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(safe) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

#: Levels by recursion; crc32 bit by bit; a path is the siblings with their side, `L`, `R` or `-` for none.
OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, lang, sha256(concat(
    coalesce(concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'), coalesce(concat(strlen(lang), ':', lang), '-'),
    x, coalesce(concat(strlen(text), ':', text), '-'))) AS leaf, sha256(concat(
    coalesce(concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'), coalesce(concat(strlen(lang), ':', lang), '-'),
    y, coalesce(concat(strlen(text), ':', text), '-'))) AS bad,
    list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_prepend(CAST(ascii(c) AS BIGINT), [CAST(-1 AS BIGINT) FOR i IN range(8)])))),
                lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS crc
    FROM (SELECT *, coalesce(concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars), '-') AS x, coalesce(concat(strlen(CAST(n_chars + 1 AS VARCHAR)), ':', n_chars + 1), '-') AS y FROM documents)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
t(lang, level, pos, h) AS (SELECT lang, 0, pos, leaf FROM o UNION ALL
    SELECT lang, level + 1, pos // 2, string_agg(h, '' ORDER BY pos) FROM (SELECT lang, level, pos, h, count(*) OVER (PARTITION BY lang) AS n FROM
        (SELECT lang, level, pos, CASE WHEN level = 0 THEN h ELSE sha256(h) END AS h FROM t)) WHERE n > 1 GROUP BY lang, level, pos // 2),
v AS (SELECT lang, level, pos, CASE WHEN level = 0 THEN h ELSE sha256(h) END AS h FROM t),
s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos FROM (SELECT *, max(level) OVER (PARTITION BY lang) AS top FROM v) WHERE level = top),
u(level, pos, h) AS (SELECT 0, pos, subroot FROM s UNION ALL
    SELECT level + 1, pos // 2, string_agg(h, '' ORDER BY pos) FROM (SELECT level, pos, h, count(*) OVER () AS n FROM
        (SELECT level, pos, CASE WHEN level = 0 THEN h ELSE sha256(h) END AS h FROM u)) WHERE n > 1 GROUP BY level, pos // 2),
w AS (SELECT level, pos, CASE WHEN level = 0 THEN h ELSE sha256(h) END AS h FROM u),
p AS (SELECT o.lang, o.pos, list(CASE WHEN b.h IS NULL THEN '-' WHEN a.pos % 2 = 1 THEN 'L' || b.h ELSE 'R' || b.h END ORDER BY a.level) AS path
      FROM o JOIN (SELECT *, max(level) OVER (PARTITION BY lang) AS top FROM v) a ON a.lang IS NOT DISTINCT FROM o.lang AND a.pos = o.pos >> a.level AND a.level < a.top
      LEFT JOIN v b ON b.lang IS NOT DISTINCT FROM a.lang AND b.level = a.level AND b.pos = xor(a.pos, 1) GROUP BY 1, 2),
q AS (SELECT s.pos, list(CASE WHEN b.h IS NULL THEN '-' WHEN a.pos % 2 = 1 THEN 'L' || b.h ELSE 'R' || b.h END ORDER BY a.level) AS path
      FROM s JOIN w a ON a.pos = s.pos >> a.level AND a.level < (SELECT max(level) FROM w) LEFT JOIN w b ON b.level = a.level AND b.pos = xor(a.pos, 1) GROUP BY 1),
f AS (SELECT o.doc_id, o.leaf, s.subroot, (SELECT h FROM w WHERE level = (SELECT max(level) FROM w)) AS root, list_concat(coalesce(p.path, []), coalesce(q.path, [])) AS path,
      CASE WHEN xor(o.crc, 4294967295) % 7 = 0 THEN o.bad ELSE o.leaf END AS start
      FROM o JOIN s ON s.lang IS NOT DISTINCT FROM o.lang LEFT JOIN p ON p.lang IS NOT DISTINCT FROM o.lang AND p.pos = o.pos LEFT JOIN q ON q.pos = s.pos),
g AS (SELECT *, list_reduce(list_prepend(start, path), lambda h, x: CASE WHEN x[1] = 'L' THEN sha256(x[2:] || h) WHEN x[1] = 'R' THEN sha256(h || x[2:]) ELSE sha256(h) END) AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(path, lambda x: x <> '-'), lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM g
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
             || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN e THEN 'E' ELSE '' END AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, good, toxic, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT o, step, o[step] AS f, o[:step - 1] AS before FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
x AS (SELECT c.*, s.*, contains(fails, f) AS hit, before <> '' AND regexp_matches(fails, '[' || before || ']') AS gone FROM c, s WHERE before <> ''
      UNION ALL SELECT c.*, s.*, contains(fails, f), false FROM c, s WHERE before = ''),
r AS (SELECT part, o AS filter_order, step, f, coalesce(sum(n) FILTER (WHERE NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0) AS removed,
             coalesce(sum(n) FILTER (WHERE hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails = f), 0) AS unique_fails,
             coalesce(sum(n) FILTER (WHERE hit AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (WHERE hit AND NOT gone AND toxic), 0) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""
