"""The queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard, lexical, licenses, lm, mixing, negatives, packed, quality, secrets, suffixes, telephony, toxicity, warc
from .common import table, written


def op1_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stored = telephony.expand_media(telephony.store_telephony(docs, "doc_id", "text"), "doc_id")
    return telephony.media_features(stored, "doc_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    narrow = written(docs.select("doc_id", "source", mixing.n_tokens(F.col("text")).alias("n_tokens")), "mix-docs")
    plan = mixing.mixing_plan(narrow, "doc_id", "source", "n_tokens", entropy_ratio=0.97, seed=17)
    return mixing.mixed(narrow, "doc_id", "source", plan, seed=17).select("doc_id", "source", "n_tokens", F.round("weight", 6).alias("weight"), "epoch", "block", "order_key")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = table(spark, sf_dir, "labels").where(toxicity.fold("doc_id", 5) > 0)
    scores = toxicity.score_toxicity(docs, "doc_id", "text", toxicity.train_toxicity(docs, learn, "doc_id", "text", "toxic"))
    return scores.select("doc_id", (toxicity.fold("doc_id", 5) <= 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rules = quality.train_rules(docs, labels, "doc_id", "text", "quality")
    stats = quality.text_stats(docs, "doc_id", "text")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return stats.select(*columns, quality.base_failed().alias("base_failed"), quality.verdict(rules).cast("int").alias("rule")).select(*columns, "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    encoded = bpe.encode_bpe(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.drop("ids")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.settled(lm.score_texts(table(spark, sf_dir, "documents"), "doc_id", "text", folds=7, fold=2), "lm-scores")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"), "doc_id", "text", secrets.train_forest(spark), path="source")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.settled(suffixes.remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text"), "repeats")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), "doc_id", "text")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    noisy = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine_negatives(noisy, "vec_id", "embedding", "label", anchors=F.col("id") % 100 == 0)


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_texts(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", k=20)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = written(warc.write_archives(table(spark, sf_dir, "pages"), "page_id", "url", "html", min_bytes=0), "warc")
    records = warc.read_archives(archives, payloads=False).where("record_type != 'warcinfo'")
    return records.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _licenses_sql() -> str:
    # each rule takes away what it matches, and leaves its number
    rules = ", ".join(f"struct_pack(rest := '', found := [{k}], ids := {_sql_text(''.join(f'|{x}|' for x in ids))})" for k, (_, ids) in enumerate(licenses.RULES, 1))
    use = "struct_pack(rest := CASE WHEN contains(a.rest, x.ids) THEN replace(a.rest, x.ids, '-') ELSE a.rest END, found := CASE WHEN contains(a.rest, x.ids) THEN a.found || x.found ELSE a.found END, ids := '')"
    listed = ", ".join(_sql_text(name) for name, _ in licenses.RULES)
    known = ", ".join(f"({_sql_text(s)}, {_sql_text(name)})" for name, s in licenses.SENTENCES.items() if "*" not in s)
    starred = ", ".join(f"({_sql_text(licenses.sentence_pattern(s, ' '))}, {_sql_text(name)})" for name, s in licenses.SENTENCES.items() if "*" in s)
    return f"""
WITH known(sentence, id) AS (VALUES {known}), starred(pattern, id) AS (VALUES {starred}),
lines AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10))) AS line,
          generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)), 1) AS k FROM documents),
plain AS (SELECT doc_id, k, trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')) AS sentence FROM lines),
named AS (SELECT doc_id, k, id FROM plain JOIN known USING (sentence) UNION ALL SELECT doc_id, k, id FROM plain JOIN starred ON regexp_full_match(sentence, pattern) WHERE contains(sentence, 'neither the name of')),
found AS (SELECT doc_id, count(*) AS n, string_agg(id, '|' ORDER BY k) AS ids FROM named GROUP BY doc_id),
ruled AS (SELECT doc_id, n, ids, list_reduce([{rules}], lambda a, x: {use}, struct_pack(rest := '|' || replace(ids, '|', '||') || '|', found := []::INTEGER[], ids := '')).found AS found FROM found),
named_by AS (SELECT *, list_transform(found, lambda k: [{listed}][k]) AS names FROM ruled),
told AS (SELECT doc_id, n, ids, found[1] AS rule, array_to_string(list_filter(names, lambda x, i: i = 1 OR NOT list_contains(names[1:i - 1], x)), '|') AS licenses FROM named_by)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, rule::INTEGER AS rule, [{listed}][rule] AS license, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN told USING (doc_id)"""


_MIXING_SQL = """
WITH RECURSIVE docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n FROM documents),
src AS (SELECT source, sum(n)::BIGINT AS t, count(*) AS docs FROM docs GROUP BY source),
p AS (SELECT list(t / total ORDER BY t) AS p, any_value(total) AS total, 0.97::DOUBLE * ln(count(*)::DOUBLE) AS target FROM (SELECT t::DOUBLE AS t, sum(t::DOUBLE) OVER () AS total FROM src WHERE t > 0)),
bis AS (SELECT 0 AS k, 0::DOUBLE AS lo, 1::DOUBLE AS hi, p, total, target FROM p
  UNION ALL
  SELECT k + 1, CASE WHEN h >= target THEN mid ELSE lo END, CASE WHEN h >= target THEN hi ELSE mid END, p, total, target FROM
  (SELECT *, ln(list_sum(list_transform(p, lambda x: pow(x, mid)))) - mid * list_sum(list_transform(p, lambda x: pow(x, mid) * ln(x))) / list_sum(list_transform(p, lambda x: pow(x, mid))) AS h
   FROM (SELECT *, (lo + hi) / 2 AS mid FROM bis WHERE k < 50))),
a AS (SELECT round(CASE WHEN -list_sum(list_transform(p, lambda x: x * ln(x))) >= target THEN 1 ELSE lo END, 9) AS a, p, total FROM bis WHERE k = 50),
w AS (SELECT source, t, docs, total, CASE WHEN t > 0 THEN pow(t / total, a) / list_sum(list_transform(p, lambda x: pow(x, a))) ELSE 0 END AS weight FROM src, a),
e AS (SELECT *, CASE WHEN t > 0 THEN floor(total * weight / t + 1e-9) ELSE 1 END::BIGINT AS epochs, ceil(docs / 4096)::BIGINT AS blocks FROM w),
r AS (SELECT *, CASE WHEN t > 0 THEN greatest(0, round(total * weight - epochs * t))::BIGINT ELSE 0 END AS rest FROM e),
x AS (SELECT d.doc_id, d.source, d.n, r.weight, r.epochs, r.rest, r.blocks, unnest(range(0, r.epochs + 1)) AS epoch FROM docs d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
y AS (SELECT *, md5('17:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')) AS order_key FROM x),
z AS (SELECT *, ('0x' || substr(order_key, 1, 8))::BIGINT % blocks AS block FROM y),
c AS (SELECT *, sum(n) OVER (PARTITION BY source, epoch ORDER BY block, order_key, n ROWS UNBOUNDED PRECEDING) - n AS before FROM z)
SELECT doc_id, source, n AS n_tokens, round(weight, 6) AS weight, epoch, block, order_key FROM c WHERE epoch < epochs OR before < rest
"""


_NEGATIVES_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER o)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW o AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER o <= 10
"""

_SEARCH_SQL = rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{lexical.UPPER}', '{lexical.UPPER.lower()}'), '{lexical.TERM}')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths), d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, '{lexical.UPPER}', '{lexical.UPPER.lower()}'), '{lexical.TERM}')) AS term FROM benchmark),
w AS (SELECT item_id, term, (count(*) * any_value(floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))))::BIGINT AS w FROM q JOIN d USING (term), corpus GROUP BY ALL),
i AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)) AS impact FROM p JOIN lengths USING (doc_id), corpus),
s AS (SELECT item_id, doc_id, sum(w * impact)::BIGINT AS score FROM w JOIN i USING (term) GROUP BY ALL)
SELECT item_id, (row_number() OVER o)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 20
"""

#: Base 32 of a SHA-1, five hexadecimal digits by five.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {5 * k + 1}, 5))::BIGINT >> {s}) & 31), 1)" for k in range(8) for s in (15, 10, 5, 0))
_WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""


def queries() -> dict:
    return {"op1_telephony": op1_telephony, "op2_mixing": op2_mixing, "op3_toxicity": op3_toxicity, "op4_quality_rules": op4_quality_rules, "op5_ngram_join": op5_ngram_join, "op6_bpe": op6_bpe, "op7_lm": op7_lm, "op8_secrets": op8_secrets, "op9_repeats": op9_repeats, "op10_licenses": op10_licenses, "op11_negatives": op11_negatives, "op12_search": op12_search, "op13_warc": op13_warc}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": _MIXING_SQL, "op10_licenses": _licenses_sql(), "op11_negatives": _NEGATIVES_SQL, "op12_search": _SEARCH_SQL, "op13_warc": _WARC_SQL}
