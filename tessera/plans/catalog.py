"""Registered queries of the sequence operators, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text
from ..functions.citation import citation_html
from ..operators import align, checks, gaps, joins, ordered, playback, quality
from ..sources import pages, responses, sinks
from ..streaming.highlight import pauses
from . import inputs as I  # noqa: E812
from .sync import sync_tables

QUERIES: dict = {}
SQL: dict[str, str] = {}
r6 = lambda c: F.round(c, 6)
EV = f"WITH {I.EV_SQL}, {I.GAPS_SQL}"
TOK = f"WITH {I.TOK_SQL}, {I.GAPS_SQL}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _classified(spark, sf_dir: str, words=I.event_words) -> DataFrame:
    return gaps.classify_gaps(ordered.gap_rows(words(spark, sf_dir)))


EV_CLASSIFIED = f"{EV}, {I.NO_ADVICE_SQL}, {I.CLASSIFY_SQL}"
TOK_CLASSIFIED = f"{TOK}, {I.NO_ADVICE_SQL}, {I.CLASSIFY_SQL}"


@query(f"{EV} SELECT page_id, gap_index, word_before, word_after, round(ms, 6) AS duration_ms FROM gaps")
def gap_extract(spark, sf_dir):
    return ordered.gap_rows(I.event_words(spark, sf_dir)).select("page_id", "gap_index", "word_before", "word_after", r6("duration_ms").alias("duration_ms"))


@query(f"{EV_CLASSIFIED} SELECT page_id, gap_type, count(*) AS n, count(*) FILTER (action = 'keep') AS kept, count(*) FILTER (action = 'fill') AS filled FROM classified GROUP BY ALL")
def gap_type_counts(spark, sf_dir):
    return gaps.type_counts(_classified(spark, sf_dir))


@query(f"{EV_CLASSIFIED}, c AS (SELECT page_id, gap_type, count(*) AS n, count(*) FILTER (action = 'keep') AS kept, count(*) FILTER (action = 'fill') AS filled FROM classified GROUP BY ALL) "
       "SELECT page_id, string_agg(gap_type || ':' || n || '/' || kept || '/' || filled, '|' ORDER BY gap_type) AS by_type FROM c GROUP BY page_id")  # fmt: skip
def gap_summary_map(spark, sf_dir):
    m = gaps.summary_map(gaps.type_counts(_classified(spark, sf_dir)))
    entry = lambda e: F.concat_ws("/", F.concat(e["key"], F.lit(":"), e["value"]["n"]), e["value"]["kept"], e["value"]["filled"])
    return m.select("page_id", F.array_join(F.transform(F.array_sort(F.map_entries("by_type")), entry), "|").alias("by_type"))


FULL = "gap_type, action, confidence, punct AS has_punctuation, liaison AS is_liaison, breath AS has_breath, pitch AS has_pitch_reset, sentence AS is_sentence_boundary, ms <= 0 AS needs_expansion"


def _full(df: DataFrame) -> DataFrame:
    return df.select("page_id", "gap_index", "gap_type", "action", "confidence", "has_punctuation", "is_liaison", "has_breath", "has_pitch_reset", "is_sentence_boundary", "needs_expansion")


@query(f"{TOK_CLASSIFIED} SELECT page_id, gap_index, {FULL} FROM classified")
def gap_classify_full(spark, sf_dir):
    return _full(_classified(spark, sf_dir, I.token_words))


@query(f"{TOK_CLASSIFIED} SELECT page_id, count(*) AS total, count(*) FILTER (action = 'keep') AS kept, count(*) FILTER (action = 'fill') AS filled, count(*) FILTER (action = 'review') AS review, round(avg(confidence), 6) AS average_confidence FROM classified GROUP BY page_id")
def action_counts(spark, sf_dir):
    return gaps.action_counts(_classified(spark, sf_dir, I.token_words)).withColumn("average_confidence", r6("average_confidence"))


@query(f"{TOK_CLASSIFIED} SELECT page_id, gap_index, gap_type, confidence FROM classified WHERE confidence < 0.7")
def low_confidence_gaps(spark, sf_dir):
    return gaps.low_confidence_gaps(_classified(spark, sf_dir, I.token_words)).select("page_id", "gap_index", "gap_type", "confidence")


@query(f"{EV_CLASSIFIED} SELECT page_id, gap_index, gap_type FROM classified WHERE action = 'review'")
def review_gaps(spark, sf_dir):
    return gaps.review_gaps(_classified(spark, sf_dir)).select("page_id", "gap_index", "gap_type")


@query(f"{EV_CLASSIFIED} SELECT page_id, gap_index, CASE WHEN action = 'fill' THEN round(gap_start, 6) END AS fill_start, CASE WHEN action = 'fill' THEN round(gap_end, 6) END AS fill_end FROM classified")
def fill_windows(spark, sf_dir):
    return _classified(spark, sf_dir).select("page_id", "gap_index", r6("fill_start").alias("fill_start"), r6("fill_end").alias("fill_end"))


def _prosody(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = ordered.gap_rows(I.token_words(spark, sf_dir))
    return rows, gaps.heuristic_prosody(rows)


@query(f"{TOK}, {I.PROSODY_SQL} SELECT page_id, gap_index AS pg_idx, has_breath, has_pitch_reset, is_sentence_boundary, recommendation, advice_confidence FROM prosody")
def heuristic_prosody(spark, sf_dir):
    return _prosody(spark, sf_dir)[1].select("page_id", "pg_idx", "has_breath", "has_pitch_reset", "is_sentence_boundary", "recommendation", "advice_confidence")


@query(f"{TOK}, {I.PROSODY_SQL} SELECT page_id, gap_index AS pg_idx, round(gap_start, 6) AS start, 'pitch_reset' AS event_type, 0.7::DOUBLE AS confidence FROM prosody WHERE has_pitch_reset "
       "UNION ALL SELECT page_id, gap_index, round(gap_start, 6), 'sentence_end', 0.8::DOUBLE FROM prosody WHERE is_sentence_boundary")  # fmt: skip
def prosody_events(spark, sf_dir):
    return gaps.prosody_events(_prosody(spark, sf_dir)[1]).withColumn("start", r6("start"))


@query(f"{TOK}, {I.PROSODY_SQL} SELECT page_id, count(*) AS gaps, count(*) FILTER (recommendation = 'keep') AS to_keep, count(*) FILTER (recommendation = 'fill') AS to_fill, (count(*) FILTER (has_pitch_reset) + count(*) FILTER (is_sentence_boundary))::BIGINT AS events, 0::BIGINT AS breaths, count(*) FILTER (has_pitch_reset) AS pitch_resets FROM prosody GROUP BY page_id")
def prosody_summary(spark, sf_dir):
    advice = _prosody(spark, sf_dir)[1]
    return gaps.prosody_summary(advice, gaps.prosody_events(advice))


@query(f"{TOK}, {I.PROSODY_SQL} SELECT page_id, gap_index AS pg_idx FROM prosody WHERE recommendation IN ('keep', 'fill')")
def decided_advice(spark, sf_dir):
    return gaps.with_advice(_prosody(spark, sf_dir)[1], "keep", "fill").select("page_id", "pg_idx")


@query(f"{TOK}, {I.PROSODY_SQL}, {I.SHIFTED_SQL} SELECT page_id, gap_index, pg_idx FROM advised")
def prosody_band_match(spark, sf_dir):
    rows, advice = _prosody(spark, sf_dir)
    return joins.match_advice(rows, I.shifted_advice(advice)).select("page_id", "gap_index", "pg_idx")


@query(f"{TOK}, {I.PROSODY_SQL}, {I.SHIFTED_SQL}, {I.CLASSIFY_SQL} SELECT page_id, gap_index, gap_type, action, round(confidence, 6) AS confidence, punct AS has_punctuation, liaison AS is_liaison, breath AS has_breath, pitch AS has_pitch_reset, sentence AS is_sentence_boundary, ms <= 0 AS needs_expansion FROM classified")
def gap_classify_advised(spark, sf_dir):
    rows, advice = _prosody(spark, sf_dir)
    return _full(gaps.classify_gaps(joins.match_advice(rows, I.shifted_advice(advice)))).withColumn("confidence", r6("confidence"))


@query(f"{TOK}, {I.PROSODY_SQL}, {I.NO_ADVICE_SQL}, {I.CLASSIFY_SQL}, p AS (SELECT page_id, gap_index, gap_start + CASE WHEN gap_index % 3 = 0 THEN 0.04 ELSE 0.11 END::DOUBLE AS t0, recommendation FROM prosody), "
       "k AS (SELECT DISTINCT p.page_id, p.gap_index FROM p JOIN classified c ON p.page_id = c.page_id AND c.action = 'keep' AND floor(c.gap_start / 0.1)::BIGINT BETWEEN floor(t0 / 0.1)::BIGINT - 1 AND floor(t0 / 0.1)::BIGINT + 1 AND abs(c.gap_start - t0) < 0.1 WHERE recommendation = 'keep') "
       "SELECT p.page_id, round(count(k.gap_index)::DOUBLE / count(*), 6) AS prosody_preserved_score FROM p LEFT JOIN k USING (page_id, gap_index) GROUP BY p.page_id")  # fmt: skip
def preserved_score(spark, sf_dir):
    rows, advice = _prosody(spark, sf_dir)
    return quality.preserved_score(I.shifted_advice(advice), gaps.classify_gaps(rows)).withColumn("prosody_preserved_score", r6("prosody_preserved_score"))


@query(f"{TOK}, {I.PROSODY_SQL}, t AS (SELECT page_id, gap_index AS pg_idx, gap_start + CASE WHEN gap_index % 3 = 0 THEN 0.04 ELSE 0.11 END::DOUBLE AS t0 FROM prosody), "
       "w AS (SELECT page_id, word_idx, word, e, lead(word) OVER (PARTITION BY page_id ORDER BY word_idx) AS next FROM words), "
       "m AS (SELECT t.page_id, pg_idx, arg_min(struct_pack(a := word, b := next), word_idx) AS m FROM t JOIN w ON t.page_id = w.page_id AND floor(e / 0.1)::BIGINT BETWEEN floor(t0 / 0.1)::BIGINT - 1 AND floor(t0 / 0.1)::BIGINT + 1 AND abs(t0 - e) < 0.1 GROUP BY ALL) "
       "SELECT t.page_id, t.pg_idx, coalesce(m.a, '') AS word_before, coalesce(m.b, '') AS word_after FROM t LEFT JOIN m USING (page_id, pg_idx)")  # fmt: skip
def advice_words(spark, sf_dir):
    words = I.token_words(spark, sf_dir)
    advice = I.shifted_advice(gaps.heuristic_prosody(ordered.gap_rows(words)))
    return joins.advice_words(advice.drop("word_before", "word_after"), words).select("page_id", "pg_idx", "word_before", "word_after")


@query(f"{EV} SELECT page_id, word_idx, word, round(g, 6) AS gap_ms FROM (SELECT *, (s - lag(e) OVER (PARTITION BY page_id ORDER BY word_idx)) * 1000::DOUBLE AS g FROM words) WHERE g >= 500")
def post_pause(spark, sf_dir):
    return ordered.post_pause_words(I.event_words(spark, sf_dir)).select("page_id", "word_idx", "word", r6("gap_ms").alias("gap_ms"))


@query(f"{TOK} SELECT page_id, word_idx, round(CASE WHEN e - s >= 0.2::DOUBLE THEN e WHEN n IS NULL THEN s + 0.2::DOUBLE ELSE e + least(0.2::DOUBLE - (e - s), 0.8::DOUBLE * (n - e)) END, 6) AS \"end\" FROM (SELECT *, lead(s) OVER (PARTITION BY page_id ORDER BY word_idx) AS n FROM words)")
def min_duration(spark, sf_dir):
    return ordered.minimum_duration(I.token_words(spark, sf_dir)).select("page_id", "word_idx", r6("end").alias("end"))


MISSING = "m AS (SELECT *, word = 'error' AS missing, CASE WHEN word = 'error' THEN 0 ELSE s END AS s1, CASE WHEN word = 'error' THEN 0 ELSE e END AS e1 FROM words)"


def _missing(spark, sf_dir: str) -> DataFrame:
    gone = F.col("word") == "error"
    return I.event_words(spark, sf_dir).withColumns({"missing": gone, "start": F.when(gone, 0.0).otherwise(F.col("start")), "end": F.when(gone, 0.0).otherwise(F.col("end"))})


@query(f"{EV}, {MISSING} SELECT page_id, word_idx, round(coalesce(last_value(CASE WHEN e1 > 0 THEN e1 END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS prev_end, "
       "round(coalesce(first_value(CASE WHEN s1 > 0 THEN s1 END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY word_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 99999), 6) AS next_start, "
       "CASE WHEN missing THEN sum(CASE WHEN missing THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING)::BIGINT END AS run_id FROM m")  # fmt: skip
def neighbour_fill(spark, sf_dir):
    out = ordered.runs(ordered.timed_neighbours(_missing(spark, sf_dir), F.lit(99999.0)), F.col("missing"))
    return out.select("page_id", "word_idx", r6("prev_end").alias("prev_end"), r6("next_start").alias("next_start"), "run_id")


INTERPOLATED = rf"""{EV.replace("WITH ", "WITH RECURSIVE ", 1)}, {MISSING},
a AS (SELECT page_id, word_idx, missing, s1, e1, confidence, greatest(1, len(regexp_extract_all(regexp_replace(lower(word), '[^a-z]', '', 'g'), '[aeiou]+')))::DOUBLE AS syl, lag(e1) OVER o AS pe, CASE WHEN missing THEN sum(CASE WHEN missing THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING) END AS run,
 coalesce(first_value(CASE WHEN s1 > 0 THEN s1 END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY word_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 99999)::DOUBLE AS nx FROM m WINDOW o AS (PARTITION BY page_id ORDER BY word_idx)),
b AS (SELECT *, row_number() OVER (PARTITION BY page_id, run ORDER BY word_idx) - 1 AS k, count(*) OVER (PARTITION BY page_id, run) AS n, sum(syl) OVER (PARTITION BY page_id, run) AS tot, first_value(coalesce(pe, 0)) OVER (PARTITION BY page_id, run ORDER BY word_idx)::DOUBLE AS p0 FROM a WHERE missing),
f AS (SELECT page_id, run, word_idx, k, p0 AS st, p0 + greatest(0.15::DOUBLE, syl * (CASE WHEN nx - p0 > 0 THEN nx - p0 ELSE 0.3::DOUBLE * n END) / tot) AS en, (CASE WHEN nx - p0 > 0 THEN nx - p0 ELSE 0.3::DOUBLE * n END) / tot AS rate, tot - syl AS lft FROM b WHERE k = 0
 UNION ALL SELECT page_id, run, word_idx, k, st, st + greatest(0.15::DOUBLE, syl * rate), rate, lft - syl FROM (SELECT b.page_id, b.run, b.word_idx, b.k, b.syl, f.en AS st, f.lft, (CASE WHEN b.k = b.n - 1 THEN CASE WHEN b.nx - f.en > 0 THEN b.nx - f.en ELSE 0.3::DOUBLE END ELSE greatest(0.15::DOUBLE, b.syl * f.rate) END) / f.lft AS rate FROM f JOIN b ON b.page_id = f.page_id AND b.run = f.run AND b.k = f.k + 1))
SELECT a.page_id, a.word_idx, round(coalesce(f.st, a.s1), 6) AS start, round(coalesce(f.en, a.e1), 6) AS "end", CASE WHEN missing THEN 0.3 ELSE confidence END::DOUBLE AS confidence FROM a LEFT JOIN f USING (page_id, word_idx)"""


@query(INTERPOLATED)
def interpolate(spark, sf_dir):
    words = _missing(spark, sf_dir).withColumn("syllables", text.syllables(F.col("word"))).withColumn("duration", F.lit(99999.0))
    return ordered.interpolate(words).select("page_id", "word_idx", r6("start").alias("start"), r6("end").alias("end"), "confidence")


@query(f"WITH RECURSIVE {I.EV_SQL}, n AS (SELECT page_id, max(word_idx) AS last FROM words GROUP BY page_id), "
       "r AS (SELECT w.page_id, w.word_idx, w.s, w.e AS e_in FROM words w JOIN n ON w.page_id = n.page_id AND w.word_idx = n.last "
       "UNION ALL SELECT p.page_id, p.word_idx, p.s, CASE WHEN r.s - p.e < 0.01::DOUBLE AND NOT ((r.e_in - r.s) - (0.01::DOUBLE - (r.s - p.e)) >= 0.15::DOUBLE) THEN r.s - 0.01::DOUBLE ELSE p.e END "
       "FROM r JOIN words p ON p.page_id = r.page_id AND p.word_idx = r.word_idx - 1) "
       "SELECT r.page_id, r.word_idx, round(CASE WHEN p.e IS NOT NULL AND r.s - p.e < 0.01::DOUBLE AND (r.e_in - r.s) - (0.01::DOUBLE - (r.s - p.e)) >= 0.15::DOUBLE THEN r.s + (0.01::DOUBLE - (r.s - p.e)) ELSE r.s END, 6) AS start, round(r.e_in, 6) AS \"end\" "
       "FROM r LEFT JOIN words p ON p.page_id = r.page_id AND p.word_idx = r.word_idx - 1")  # fmt: skip
def overlap_repair(spark, sf_dir):
    out = ordered.repair_overlaps(I.event_words(spark, sf_dir))
    return out.select("page_id", "word_idx", r6("start").alias("start"), r6("end").alias("end"))


@query(EV_CLASSIFIED.replace("WITH ", "WITH RECURSIVE ", 1) + ", x AS (SELECT w.page_id, w.word_idx, w.s, w.e, c.action = 'fill' AND c.ms > 0 AS fill, lead(w.s) OVER o AS ns, lead(w.e) OVER o AS ne FROM words w LEFT JOIN classified c ON c.page_id = w.page_id AND c.gap_index = w.word_idx WINDOW o AS (PARTITION BY w.page_id ORDER BY w.word_idx)), "
       "q AS (SELECT page_id, word_idx, s, e, fill, ns, ne, s AS s1 FROM x WHERE word_idx = 0 UNION ALL "
       "SELECT x.page_id, x.word_idx, x.s, x.e, x.fill, x.ns, x.ne, CASE WHEN coalesce(q.fill, false) AND (q.e + x.s) / 2 - q.s1 >= 0.15::DOUBLE AND x.e - (q.e + x.s) / 2 >= 0.15::DOUBLE THEN (q.e + x.s) / 2 ELSE x.s END FROM q JOIN x ON x.page_id = q.page_id AND x.word_idx = q.word_idx + 1) "
       "SELECT page_id, word_idx, round(s1, 6) AS start, round(CASE WHEN coalesce(fill, false) AND ns IS NOT NULL AND (e + ns) / 2 - s1 >= 0.15::DOUBLE AND ne - (e + ns) / 2 >= 0.15::DOUBLE THEN (e + ns) / 2 ELSE e END, 6) AS \"end\" FROM q")  # fmt: skip
def midpoint_fill(spark, sf_dir):
    words = I.event_words(spark, sf_dir)
    fill = gaps.classify_gaps(ordered.gap_rows(words)).select("page_id", F.col("gap_index").alias("word_idx"), ((F.col("action") == "fill") & ~F.col("needs_expansion")).alias("fill"))
    out = ordered.fill_midpoints(words.join(fill, ["page_id", "word_idx"], "left").withColumn("fill", F.coalesce("fill", F.lit(False))))
    return out.select("page_id", "word_idx", r6("start").alias("start"), r6("end").alias("end"))


ROUND = lambda t, m, lo, hi: f"({t} - {m}::DOUBLE * floor({t} / {m}::DOUBLE) < {lo}::DOUBLE OR {t} - {m}::DOUBLE * floor({t} / {m}::DOUBLE) > {hi}::DOUBLE)"
ISSUES = rf"""{TOK}, u AS (SELECT *, s = 0 AND e = 0 AND is_title AS skip, (e - s) * 1000::DOUBLE AS ms, greatest(1, len(regexp_extract_all(regexp_replace(lower(word), '[^\p{{L}}\p{{N}}_]', '', 'g'), '[aeiouáéíóúâêîôûàèìòùãõ]+'))) AS syl,
 lag(e) OVER o AS pe, lag(word) OVER o AS pw, lag(s = 0 AND e = 0 AND is_title) OVER o AS ps FROM words WINDOW o AS (PARTITION BY page_id ORDER BY word_idx)),
v AS (SELECT *, (s - pe) * 1000::DOUBLE AS gap, pe IS NOT NULL AND NOT coalesce(ps, false) AS near FROM u WHERE NOT skip),
issues AS (SELECT page_id, word_idx, 'too_short' AS type, CASE WHEN ms < 50 THEN 'error' ELSE 'warning' END AS severity FROM v WHERE ms < 80
 UNION ALL SELECT page_id, word_idx, 'too_long', 'warning' FROM v WHERE ms > 1500
 UNION ALL SELECT page_id, word_idx, 'large_gap', 'warning' FROM v WHERE near AND (gap > 500 AND NOT regexp_matches(pw, '[.!?;:]\s*$') OR gap > 800)
 UNION ALL SELECT page_id, word_idx, 'syllable_mismatch', CASE WHEN syl >= 3 AND ms < 150 THEN 'error' ELSE 'warning' END FROM v WHERE syl >= 3 AND ms < 150 OR syl >= 2 AND ms < 100
 UNION ALL SELECT page_id, word_idx, 'overlap', 'error' FROM v WHERE near AND s < pe
 UNION ALL SELECT page_id, word_idx, 'round_timestamps', 'warning' FROM v WHERE {ROUND('s', '0.25', '0.01', '0.24')} AND {ROUND('e', '0.25', '0.01', '0.24')} AND {ROUND('s', '0.5', '0.02', '0.48')} AND {ROUND('e', '0.5', '0.02', '0.48')}
 UNION ALL SELECT page_id, word_idx, 'alignment_drift', 'warning' FROM (SELECT page_id, max(word_idx) AS word_idx, arg_max(e, word_idx) AS le FROM words GROUP BY page_id) WHERE 60 - le > 60 * 0.15::DOUBLE AND 60 - le > 1)"""


def _issues(spark, sf_dir: str) -> DataFrame:
    words = I.token_words(spark, sf_dir)
    return checks.find_issues(words, words.select("page_id").distinct().withColumn("duration", F.lit(60.0)))


@query(f"{ISSUES} SELECT * FROM issues")
def issues(spark, sf_dir):
    return _issues(spark, sf_dir).drop("message")


@query(f"{ISSUES} SELECT page_id, type, count(*) AS n, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM issues GROUP BY ALL")
def issue_counts(spark, sf_dir):
    return checks.issue_counts(_issues(spark, sf_dir))


@query(f"{ISSUES}, k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY word_idx, type) AS rank FROM issues), n AS (SELECT page_id, word_idx, word, lag(word) OVER (PARTITION BY page_id ORDER BY word_idx) AS prev_word FROM words) "
       "SELECT page_id, word_idx, type, severity, rank::INTEGER AS rank, word, prev_word FROM k LEFT JOIN n USING (page_id, word_idx) WHERE rank <= 10")  # fmt: skip
def issue_context(spark, sf_dir):
    return checks.issue_context(_issues(spark, sf_dir).drop("message"), I.token_words(spark, sf_dir))


@query(rf"""{TOK}, u AS (SELECT *, (e - s) * 1000::DOUBLE AS ms, s - lag(e) OVER o AS gap, lag(word) OVER o AS pw FROM words WINDOW o AS (PARTITION BY page_id ORDER BY word_idx))
SELECT page_id, word_idx, round(greatest(0.1, least(1.0, (CASE WHEN ms < 50 THEN 0.7 ELSE 1 END)::DOUBLE * (CASE WHEN ms > 2000 THEN 0.8 ELSE 1 END)::DOUBLE * (CASE WHEN {ROUND('s', '0.25', '0.01', '0.24')} AND {ROUND('e', '0.25', '0.01', '0.24')} THEN 0.9 ELSE 1 END)::DOUBLE
 * (CASE WHEN gap < 0 THEN 0.5 ELSE 1 END)::DOUBLE * (CASE WHEN gap > 1 AND NOT regexp_matches(pw, '[.!?;:]\s*$') THEN 0.8 ELSE 1 END)::DOUBLE * (CASE WHEN confidence < 1 THEN confidence ELSE 1 END)::DOUBLE)), 6) AS checked FROM u""")
def heuristic_confidence(spark, sf_dir):
    return checks.heuristic_confidence(I.token_words(spark, sf_dir)).select("page_id", "word_idx", r6("checked").alias("checked"))


NEAREST = rf"""{TOK}, {I.SECOND_SQL}, n2 AS (SELECT page_id, count(*) AS n2 FROM second GROUP BY page_id),
a AS (SELECT *, regexp_replace(lower(word), '[^\p{{L}}\p{{N}}_]', '', 'g') AS c FROM words), b AS (SELECT page_id, idx2, s2, e2, regexp_replace(lower(word), '[^\p{{L}}\p{{N}}_]', '', 'g') AS c FROM second),
best AS (SELECT a.page_id, a.word_idx, arg_min(struct_pack(i := idx2, s := s2, e := e2), abs(idx2 - a.word_idx) * 1000000::BIGINT + idx2) AS m FROM a JOIN b ON a.page_id = b.page_id AND a.c = b.c AND a.c <> '' GROUP BY ALL),
pairs AS (SELECT w.*, CASE WHEN ok THEN m.i END AS second_idx, CASE WHEN ok THEN m.s END AS s2, CASE WHEN ok THEN m.e END AS e2 FROM words w LEFT JOIN (SELECT best.*, abs(m.i - word_idx) <= 0.2::DOUBLE * n2 AS ok FROM best JOIN n2 USING (page_id)) USING (page_id, word_idx))"""
VALID = f"""{NEAREST}, d AS (SELECT *, s2 IS NOT NULL AS matched, coalesce(abs(s - s2) * 1000::DOUBLE, 0) AS ds, coalesce(abs(e - e2) * 1000::DOUBLE, 0) AS de FROM pairs),
validated AS (SELECT page_id, word_idx, matched, ds, de, CASE WHEN NOT matched OR (e + e2) / 2 - (s + s2) / 2 < 0.05::DOUBLE THEN s ELSE (s + s2) / 2 END AS fs, CASE WHEN NOT matched OR (e + e2) / 2 - (s + s2) / 2 < 0.05::DOUBLE THEN e ELSE (e + e2) / 2 END AS fe,
 CASE WHEN NOT matched THEN 0.6::DOUBLE * confidence WHEN (e + e2) / 2 - (s + s2) / 2 < 0.05::DOUBLE THEN least(0.5::DOUBLE, 0.7::DOUBLE - greatest(ds, de) / 1000::DOUBLE) WHEN greatest(ds, de) < 50 THEN 0.98 WHEN greatest(ds, de) < 100 THEN 0.92 WHEN greatest(ds, de) < 200 THEN 0.85 WHEN greatest(ds, de) < 500 THEN 0.7 ELSE 0.5 END AS fc FROM d)"""


def _validated(spark, sf_dir: str) -> DataFrame:
    words = I.token_words(spark, sf_dir)
    return checks.cross_validate(joins.nearest_position_join(words, I.second_timing(words)))


@query(f"{NEAREST} SELECT page_id, word_idx, second_idx FROM pairs")
def nearest_match(spark, sf_dir):
    words = I.token_words(spark, sf_dir)
    return joins.nearest_position_join(words, I.second_timing(words)).select("page_id", "word_idx", "second_idx")


@query(f"{VALID} SELECT page_id, word_idx, matched, round(fs, 6) AS final_start, round(fe, 6) AS final_end, round(fc, 6) AS final_confidence FROM validated")
def cross_validate(spark, sf_dir):
    return _validated(spark, sf_dir).select("page_id", "word_idx", "matched", *(r6(c).alias(c) for c in ("final_start", "final_end", "final_confidence")))


@query(f"{VALID} SELECT page_id, count(*) FILTER (matched) AS matched, count(*) FILTER (NOT matched) AS unmatched, round(coalesce(sum(ds + de) FILTER (matched) / nullif(2 * count(*) FILTER (matched), 0), 0), 6) AS average_deviation_ms, round(avg(fc), 6) AS average_confidence FROM validated GROUP BY page_id")
def mean_deviation(spark, sf_dir):
    out = checks.mean_deviation(_validated(spark, sf_dir))
    return out.withColumns({c: r6(c) for c in ("average_deviation_ms", "average_confidence")})


@query(f"{VALID}, p AS (SELECT page_id, avg(fc) AS av FROM validated GROUP BY page_id) SELECT w.page_id, w.word_idx, round(CASE WHEN av > 0.7 AND fc > 0.8 THEN fs ELSE s END, 6) AS start, round(CASE WHEN av > 0.7 AND fc > 0.8 THEN fe ELSE e END, 6) AS \"end\", round(CASE WHEN av > 0.7 AND fc > 0.8 THEN fc ELSE confidence END, 6) AS confidence FROM words w JOIN validated USING (page_id, word_idx) JOIN p USING (page_id)")
def validated_merge(spark, sf_dir):
    out = joins.merge_validated(I.token_words(spark, sf_dir), _validated(spark, sf_dir))
    return out.select("page_id", "word_idx", *(r6(c).alias(c) for c in ("start", "end", "confidence")))


@query(f"{TOK} SELECT page_id, word_idx, CASE WHEN s = 0 AND e = 0 AND is_title THEN 1 ELSE confidence END::DOUBLE AS final_confidence FROM words")
def pass_through(spark, sf_dir):
    return checks.pass_through(I.token_words(spark, sf_dir)).select("page_id", "word_idx", "final_confidence")


@query(rf"""{VALID}, hu AS (SELECT *, (e - s) * 1000::DOUBLE AS ms, s - lag(e) OVER o AS gap, lag(word) OVER o AS pw FROM words WINDOW o AS (PARTITION BY page_id ORDER BY word_idx)),
hc AS (SELECT page_id, word_idx, greatest(0.1, least(1.0, (CASE WHEN ms < 50 THEN 0.7 ELSE 1 END)::DOUBLE * (CASE WHEN ms > 2000 THEN 0.8 ELSE 1 END)::DOUBLE * (CASE WHEN {ROUND('s', '0.25', '0.01', '0.24')} AND {ROUND('e', '0.25', '0.01', '0.24')} THEN 0.9 ELSE 1 END)::DOUBLE
 * (CASE WHEN gap < 0 THEN 0.5 ELSE 1 END)::DOUBLE * (CASE WHEN gap > 1 AND NOT regexp_matches(pw, '[.!?;:]\s*$') THEN 0.8 ELSE 1 END)::DOUBLE * (CASE WHEN confidence < 1 THEN confidence ELSE 1 END)::DOUBLE)) AS checked FROM hu)
SELECT page_id, word_idx, CASE WHEN page_id % 2 = 0 THEN matched ELSE false END AS matched, round(CASE WHEN page_id % 2 = 0 THEN fc ELSE checked END, 6) AS final_confidence FROM validated JOIN hc USING (page_id, word_idx)""")
def validation_dispatch(spark, sf_dir):
    """Even pages have a second source, odd ones don't."""
    words = I.token_words(spark, sf_dir)
    out = checks.validate(words, I.second_timing(words).where("page_id % 2 = 0"))
    return out.select("page_id", "word_idx", "matched", r6("final_confidence").alias("final_confidence"))


VERIFIED = """z AS (SELECT page_id, word_idx, word_idx % 4 = 1 AS gone, CASE WHEN word_idx % 4 = 1 THEN 0 ELSE s END AS s, CASE WHEN word_idx % 4 = 1 THEN 0 ELSE e END AS e, word_idx % 8 = 1 AS told, word_idx % 16 = 1 AS open FROM words)"""


@query(f"{TOK}, {VERIFIED} SELECT page_id, word_idx, round(CASE WHEN told THEN 1.5 ELSE s END, 6) AS start, round(CASE WHEN told AND open THEN 1.5 + 0.3 WHEN told THEN 2 ELSE e END, 6) AS \"end\", CASE WHEN told THEN 'verified' WHEN gone THEN 'needs_verification' ELSE 'matched' END AS status FROM z")
def apply_verifications(spark, sf_dir):
    """A check of every second missing word, some without an end, some unsure or unspoken."""
    i = F.col("word_idx")
    gone = i % 4 == 1
    words = I.token_words(spark, sf_dir).withColumns({"ref_idx": i, "start": F.when(gone, 0.0).otherwise(F.col("start")), "end": F.when(gone, 0.0).otherwise(F.col("end")), "status": F.when(gone, "needs_verification").otherwise("matched")})
    told = words.where(gone).select("page_id", "ref_idx", (i % 8 == 1).alias("is_spoken"), F.lit(1.5).alias("start_time"), F.when(i % 16 != 1, 2.0).alias("end_time"), F.lit(0.8).alias("confidence"))
    unsure = words.where(i % 8 == 3).select("page_id", "ref_idx", F.lit(True).alias("is_spoken"), F.lit(9.0).alias("start_time"), F.lit(9.5).alias("end_time"), F.lit(0.7).alias("confidence"))
    out = joins.apply_verifications(words, told.unionByName(unsure))
    return out.select("page_id", "word_idx", r6("start").alias("start"), r6("end").alias("end"), "status")


@query(f"{TOK} SELECT page_id, word_idx, round(CASE WHEN word_idx < 3 AND word_idx <> 1 AND page_id % 2 = 0 THEN 0.5::DOUBLE + word_idx * 0.4::DOUBLE ELSE s END, 6) AS start, round(CASE WHEN word_idx < 3 AND word_idx <> 1 AND page_id % 2 = 0 THEN 0.5::DOUBLE + word_idx * 0.4::DOUBLE + 0.4::DOUBLE ELSE e END, 6) AS \"end\" FROM words")
def spread_title(spark, sf_dir):
    """Titles of three words; the second was recognised, and only even pages' titles are sure to be spoken."""
    words = I.token_words(spark, sf_dir).withColumns({"op": F.when((F.col("word_idx") < 3) & (F.col("word_idx") != 1), "deletion").otherwise("match"), "status": F.lit("matched")})
    even = F.col("page_id") % 2 == 0
    titles = words.select("page_id").distinct().select("page_id", F.lit(3).alias("title_len"), F.lit(True).alias("is_spoken"), F.lit(0.5).alias("start_time"), F.lit(1.7).alias("end_time"), F.when(even, 0.9).otherwise(0.6).alias("confidence"))
    return joins.spread_title(words, titles).select("page_id", "word_idx", r6("start").alias("start"), r6("end").alias("end"))


@query(f"{TOK}, {I.PROSODY_SQL} SELECT page_id, gap_index AS pg_idx, CASE WHEN page_id % 3 = 0 THEN 'model' ELSE recommendation END AS recommendation FROM prosody WHERE page_id % 3 <> 0 OR gap_index % 2 = 0")
def prosody_dispatch(spark, sf_dir):
    """Every third page has advice of a model on every second gap."""
    advice = _prosody(spark, sf_dir)[1]
    told = advice.where("page_id % 3 = 0 AND pg_idx % 2 = 0").withColumn("recommendation", F.lit("model"))
    # a page whose positive gaps are all odd has no answer
    lost = advice.where("page_id % 3 = 0").join(told.select("page_id").distinct(), "page_id", "left_anti").select("page_id").distinct()
    return gaps.prosody_dispatch(told, advice.join(lost, "page_id", "left_anti")).select("page_id", "pg_idx", "recommendation")


CORRECTIONS = """g AS (SELECT page_id, word_idx, (word_idx / 3)::INTEGER AS seq, CASE WHEN word_idx % 5 = 0 THEN 'other' ELSE upper(word) END AS w, s + 0.01::DOUBLE AS cs, e + 0.02::DOUBLE AS ce, ((word_idx * 13) % 10)::DOUBLE / 10::DOUBLE AS conf FROM words WHERE word_idx % 3 = 0),
h AS (SELECT page_id, word_idx, (word_idx / 4)::INTEGER AS seq, word AS w, s + 0.05::DOUBLE AS cs, e + 0.06::DOUBLE AS ce, 0.85::DOUBLE AS conf FROM words WHERE word_idx % 4 = 0)"""


def _corrections(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    i = F.col("word_idx")

    def rows(step: int, word, ds: float, de: float, conf) -> DataFrame:
        own = words.where(i % step == 0)
        return own.select("page_id", F.floor(i / step).cast("int").alias("seq"), i.alias("word_index"), word.alias("word"), (F.col("start") + ds).alias("corrected_start"), (F.col("end") + de).alias("corrected_end"), conf.alias("confidence"))

    return rows(3, F.when(i % 5 == 0, "other").otherwise(F.upper("word")), 0.01, 0.02, ((i * 13) % 10) / F.lit(10.0)), rows(4, F.col("word"), 0.05, 0.06, F.lit(0.85))


@query(f"{TOK}, {CORRECTIONS.replace('(word_idx / 3)', '(word_idx // 3)').replace('(word_idx / 4)', '(word_idx // 4)')} SELECT w.page_id, w.word_idx, round(coalesce(cs, s), 6) AS start, round(coalesce(ce, e), 6) AS \"end\", cs IS NOT NULL AS corrected FROM words w LEFT JOIN g ON g.page_id = w.page_id AND g.word_idx = w.word_idx AND conf >= 0.7 AND upper(regexp_replace(lower(g.w), '[^\\p{{L}}\\p{{N}}_]', '', 'g')) = upper(regexp_replace(lower(w.word), '[^\\p{{L}}\\p{{N}}_]', '', 'g'))")
def apply_corrections(spark, sf_dir):
    words = I.token_words(spark, sf_dir)
    return joins.apply_corrections(words, _corrections(words)[0]).select("page_id", "word_idx", r6("start").alias("start"), r6("end").alias("end"), "corrected")


@query(f"{TOK}, {CORRECTIONS.replace('(word_idx / 3)', '(word_idx // 3)').replace('(word_idx / 4)', '(word_idx // 4)')} SELECT coalesce(h.page_id, g.page_id) AS page_id, coalesce(h.word_idx, g.word_idx)::INTEGER AS word_index, round(coalesce(h.cs, g.cs), 6) AS corrected_start, round(coalesce(h.conf, g.conf), 6) AS confidence, h.page_id IS NOT NULL AS replaced FROM g FULL JOIN h ON g.page_id = h.page_id AND g.word_idx = h.word_idx")
def merge_corrections(spark, sf_dir):
    out = joins.merge_corrections(*_corrections(I.token_words(spark, sf_dir)))
    return out.select("page_id", "word_index", r6("corrected_start").alias("corrected_start"), r6("confidence").alias("confidence"), "replaced")


LINES = r"""l AS (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
lb AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' AS blank FROM l),
lm AS (SELECT *, coalesce(lag(blank) OVER o, false) AS ab, coalesce(sum(CASE WHEN blank THEN 0 ELSE 1 END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fb FROM lb WINDOW o AS (PARTITION BY page_id ORDER BY line_no)),
lt AS (SELECT *, unnest(regexp_extract_all(line, '\S+')) AS token, generate_subscripts(regexp_extract_all(line, '\S+'), 1) - 1 AS pos, len(regexp_extract_all(line, '\S+')) AS n FROM lm WHERE NOT blank),
toks AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY line_no, pos) - 1 AS ref_idx, line_no, pos, token, fb = 0 AS is_title, pos = n - 1 AS is_line_end, ab AND fb > 0 AND pos = 0 AS is_section_start FROM lt)"""


def _ref_tokens(spark, sf_dir: str) -> DataFrame:
    docs = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text")
    return pages.ref_tokens(pages.lines_of(docs))


@query(f"WITH {LINES} SELECT page_id, ref_idx::INTEGER AS ref_idx, line_no::INTEGER AS line_no, pos::INTEGER AS pos_in_line, token, is_title, is_line_end, is_section_start FROM toks")
def tokenise(spark, sf_dir):
    return _ref_tokens(spark, sf_dir)


@query(f"WITH {LINES} SELECT page_id, count(*) FILTER (is_section_start) AS sections, count(*) FILTER (is_line_end) AS line_ends, count(*) FILTER (is_title) AS title_len FROM toks GROUP BY page_id")
def text_structure(spark, sf_dir):
    of = lambda c: F.count_if(F.col(c))
    return _ref_tokens(spark, sf_dir).groupBy("page_id").agg(of("is_section_start").alias("sections"), of("is_line_end").alias("line_ends"), of("is_title").alias("title_len"))


@query(f"WITH {LINES}, f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY line_no) AS k FROM lb WHERE NOT blank) SELECT page_id, max(CASE WHEN k = 1 THEN trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END) AS title, max(CASE WHEN k = 2 THEN line_no END)::INTEGER AS body_start FROM (SELECT DISTINCT page_id FROM l) LEFT JOIN f USING (page_id) GROUP BY page_id")
def titles(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text")
    return pages.title_lines(pages.lines_of(docs))


@query(f"WITH {LINES}, {I.TOK_SQL} SELECT w.page_id, w.word_idx, t.is_line_end AS line_break_after, coalesce(w.word_idx < n.k, false) AS is_title FROM words w JOIN toks t ON t.page_id = w.page_id AND t.ref_idx = w.word_idx JOIN (SELECT page_id, count(*) FILTER (is_title) AS k FROM toks GROUP BY page_id) n ON n.page_id = w.page_id")
def line_breaks(spark, sf_dir):
    ref = _ref_tokens(spark, sf_dir)
    lens = ref.groupBy("page_id").agg(F.count_if("is_title").alias("title_len"))
    out = pages.mark_titles(joins.transfer_line_breaks(I.token_words(spark, sf_dir), ref), lens)
    return out.select("page_id", "word_idx", "line_break_after", "is_title")


@query(rf"""{TOK} SELECT word, max(len(regexp_replace(lower(word), '[^\p{{L}}\p{{N}}_]', '', 'g')))::INTEGER AS letters, max(greatest(1, len(regexp_extract_all(regexp_replace(lower(word), '[^\p{{L}}\p{{N}}_]', '', 'g'), '[aeiouáéíóúâêîôûàèìòùãõ]+'))))::INTEGER AS syllables, bool_or(regexp_matches(word, '[.!?;:]\s*$')) AS ends_sentence FROM words GROUP BY word""")
def token_functions(spark, sf_dir):
    w = F.col("word")
    return I.token_words(spark, sf_dir).select("word").distinct().select("word", F.length(text.clean_token(w)).alias("letters"), text.syllables(w, text.TIMING_VOWELS).alias("syllables"), text.ends_sentence(w).alias("ends_sentence"))


@query(rf"""{TOK}, a AS (SELECT page_id, word_idx, regexp_replace(lower(word), '[^\p{{L}}\p{{N}}_]', '', 'g') AS c, lag(word) OVER (PARTITION BY page_id ORDER BY word_idx) AS p FROM words)
SELECT page_id, count(*) AS anchors FROM a WHERE c NOT IN ({', '.join(f"'{w}'" for w in text.COMMON_WORDS)}) AND (length(c) >= 6 OR regexp_matches(c, '\p{{Nd}}') OR coalesce(regexp_matches(p, '[.!?;:]$'), false)) GROUP BY page_id""")
def anchors(spark, sf_dir):
    rows = I.token_words(spark, sf_dir).withColumn("before", F.lag("word").over(ordered.in_page()))
    return rows.where(text.is_anchor(F.col("word"), F.col("before"))).groupBy("page_id").agg(F.count("*").alias("anchors"))


@query("SELECT doc_id, coalesce(list_max(list_transform(string_split(text, chr(10))[2:], lambda x: length(x))) > 80, false) AS prose FROM documents")
def prose_flag(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", text.is_prose(F.col("text")).alias("prose"))


def turns(spark, sf_dir: str, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Each turn of a conversation as a reference page `conversation/turn`; what was heard are its words without some, others changed. parts: tasks that pages are dealt to."""
    conv = I.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    pages = conv.select(F.concat_ws("/", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.coalesce(F.col("turn").cast("string"), F.lit(""))).alias("page_id"), "text")
    pages = pages.repartition(parts, "page_id") if parts else pages
    ref = pages.select("page_id", F.posexplode(text.tokens(F.col("text"))).alias("ref_idx", "token"))
    heard = ref.where("ref_idx % 9 <> 5").select("page_id", F.col("ref_idx").alias("word_idx"), F.when(F.col("ref_idx") % 4 == 1, F.concat(F.lower("token"), F.lit("s"))).otherwise(F.col("token")).alias("word"), (F.col("ref_idx") * 0.4).alias("start"), (F.col("ref_idx") * 0.4 + 0.3).alias("end"), F.lit(0.9).alias("confidence"))
    return ref, heard


QUALITY = f"""{TOK}, {I.PROSODY_SQL}, {I.NO_ADVICE_SQL}, {I.CLASSIFY_SQL}, k AS (SELECT DISTINCT p.page_id, p.gap_index FROM prosody p JOIN classified c ON p.page_id = c.page_id AND c.action = 'keep' AND floor(c.gap_start / 0.1)::BIGINT BETWEEN floor(p.gap_start / 0.1)::BIGINT - 1 AND floor(p.gap_start / 0.1)::BIGINT + 1 AND abs(c.gap_start - p.gap_start) < 0.1 WHERE p.recommendation = 'keep'),
sc AS (SELECT p.page_id, count(k.gap_index)::DOUBLE / count(*) AS score FROM prosody p LEFT JOIN k USING (page_id, gap_index) GROUP BY p.page_id), g AS (SELECT page_id, count(*) FILTER (action = 'keep') AS kp, count(*) FILTER (action = 'fill') AS fl, count(*) FILTER (action = 'review') AS rv FROM classified GROUP BY page_id),
q AS (SELECT w.page_id, count(*) AS word_count, avg(confidence) AS av, any_value(coalesce(kp, 0)) AS gaps_preserved, any_value(coalesce(fl, 0)) AS gaps_filled, any_value(coalesce(rv, 0)) AS gaps_review, count(*) FILTER (confidence < 0.8) AS low, any_value(coalesce(score, 0)) AS score, least(50, 0.1::DOUBLE * avg((e - s) * 1000::DOUBLE)) AS tp FROM words w LEFT JOIN g USING (page_id) LEFT JOIN sc USING (page_id) GROUP BY w.page_id)"""


def _quality(spark, sf_dir: str) -> DataFrame:
    words = I.token_words(spark, sf_dir)
    rows = ordered.gap_rows(words)
    return quality.quality(words, gaps.classify_gaps(rows), gaps.heuristic_prosody(rows))


@query(f"{QUALITY} SELECT page_id, word_count, round(av, 6) AS average_confidence, gaps_preserved, gaps_filled, gaps_review, low AS low_confidence_words, round(score, 6) AS prosody_preserved_score, round(tp, 6) AS timing_precision_ms, round(av, 6) AS word_accuracy FROM q")
def quality_rollup(spark, sf_dir):
    q = _quality(spark, sf_dir)
    return q.withColumns({c: r6(c) for c in ("average_confidence", "prosody_preserved_score", "timing_precision_ms", "word_accuracy")})


@query(f"{QUALITY} SELECT page_id, CASE WHEN av >= 0.9 THEN 'OK' WHEN av >= 0.8 THEN 'WARN' ELSE 'LOW' END AS confidence_band, CASE WHEN tp <= 50 THEN 'OK' WHEN tp <= 100 THEN 'WARN' ELSE 'HIGH' END AS precision_band, CASE WHEN gaps_review = 0 THEN 'OK' ELSE 'REVIEW' END AS review_band, CASE WHEN av >= 0.95 THEN 'OK' WHEN av >= 0.9 THEN 'WARN' ELSE 'LOW' END AS accuracy_band FROM q")
def quality_bands(spark, sf_dir):
    return quality.bands(_quality(spark, sf_dir))


@query(f"{QUALITY}, b AS (SELECT * FROM q) SELECT page_id, metric, round(value, 6) AS value, status FROM (SELECT page_id, 'confidence' AS metric, av AS value, CASE WHEN av >= 0.9 THEN 'OK' WHEN av >= 0.8 THEN 'WARN' ELSE 'LOW' END AS status FROM q "
       "UNION ALL SELECT page_id, 'timing precision (ms)', tp, CASE WHEN tp <= 50 THEN 'OK' WHEN tp <= 100 THEN 'WARN' ELSE 'HIGH' END FROM q UNION ALL SELECT page_id, 'gaps for review', gaps_review::DOUBLE, CASE WHEN gaps_review = 0 THEN 'OK' ELSE 'REVIEW' END FROM q "
       "UNION ALL SELECT page_id, 'word accuracy', av, CASE WHEN av >= 0.95 THEN 'OK' WHEN av >= 0.9 THEN 'WARN' ELSE 'LOW' END FROM q)")  # fmt: skip
def quality_report(spark, sf_dir):
    return quality.report(_quality(spark, sf_dir)).withColumn("value", r6("value"))


@query(f"{TOK} SELECT page_id, word_idx, word, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY word_idx)::INTEGER AS rank FROM words WHERE confidence < 0.8) WHERE rank <= 10")
def worst_words(spark, sf_dir):
    return quality.worst_words(I.token_words(spark, sf_dir)).select("page_id", "word_idx", "word", "rank")


@query(f"{TOK} SELECT page_id, string_agg(word, ' ' ORDER BY word_idx) AS low FROM words WHERE confidence < 0.8 GROUP BY page_id")
def low_confidence_words(spark, sf_dir):
    return quality.low_confidence_words(I.token_words(spark, sf_dir)).select("page_id", F.array_join("low_confidence_words", " ").alias("low"))


TICKS = "ticks AS (SELECT page_id, unnest(range(0, greatest(1, ceil(max(e))::BIGINT))) AS i FROM words GROUP BY page_id), tk AS (SELECT page_id, i + 0.37::DOUBLE AS t FROM ticks)"
PLAIN = "plain AS (SELECT page_id, word_idx, s, least(e, coalesce(lead(s) OVER (PARTITION BY page_id ORDER BY word_idx), e)) AS e FROM words)"
SPOKEN = f"{TOK}, {TICKS}, {PLAIN}, spoken AS (SELECT tk.page_id, tk.t, coalesce(CASE WHEN tk.t < plain.e THEN plain.word_idx END, -1) AS word_idx FROM tk ASOF LEFT JOIN plain ON tk.page_id = plain.page_id AND tk.t >= plain.s)"


def _ticks(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    words = I.token_words(spark, sf_dir)
    plain = words.withColumn("end", F.least("end", F.coalesce(F.lead("start").over(ordered.in_page()), "end")))
    last = words.groupBy("page_id").agg(F.greatest(F.lit(1), F.ceil(F.max("end"))).alias("n"))
    ticks = last.select("page_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).select("page_id", (F.col("i") + F.lit(0.37)).alias("t"))
    return ticks, plain


@query(f"{SPOKEN} SELECT page_id, round(t, 6) AS t, word_idx::INTEGER AS word_idx FROM spoken")
def point_in_interval(spark, sf_dir):
    return joins.point_in_interval(*_ticks(spark, sf_dir)).withColumn("t", r6("t"))


@query(f"{SPOKEN} SELECT page_id, round(t, 6) AS t, word_idx::INTEGER AS word_idx, b::INTEGER AS before FROM (SELECT *, coalesce(lag(word_idx) OVER (PARTITION BY page_id ORDER BY t), -1) AS b FROM spoken) WHERE word_idx <> b")
def word_changes(spark, sf_dir):
    return playback.word_changes(*_ticks(spark, sf_dir)).select("page_id", r6("t").alias("t"), "word_idx", "before")


@query(f"{SPOKEN}, v AS (SELECT *, coalesce(lag(word_idx) OVER (PARTITION BY page_id ORDER BY t), -1) AS b FROM spoken), c AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY page_id ORDER BY t), -1) AS o FROM v WHERE word_idx <> b), "
       "x AS (SELECT page_id, t, 'read' AS action, greatest(b, o) + 1 AS f, word_idx - 1 AS u FROM c WHERE word_idx >= 0 AND greatest(b, o) >= 0 AND word_idx > greatest(b, o) + 1 UNION ALL SELECT page_id, t, 'read', b, b FROM c WHERE b >= 0 "
       "UNION ALL SELECT page_id, t, 'active', word_idx, word_idx FROM c WHERE word_idx >= 0 UNION ALL SELECT page_id, t, 'clear', word_idx + 1, b FROM c WHERE word_idx >= 0 AND word_idx < b) "
       "SELECT page_id::VARCHAR AS session_id, t, action, f::INTEGER AS from_idx, u::INTEGER AS to_idx FROM x")  # fmt: skip
def highlight_states(spark, sf_dir):
    return playback.highlight(*_ticks(spark, sf_dir))


@query(f"{TOK} SELECT page_id, word_idx, (row_number() OVER (PARTITION BY page_id ORDER BY s, word_idx) - 1)::INTEGER AS play_idx FROM words WHERE s > 0 OR e > 0")
def playable(spark, sf_dir):
    return playback.playable_words(I.token_words(spark, sf_dir)).select("page_id", "word_idx", "play_idx")


@query(f"{TOK}, z AS (SELECT page_id, word_idx, is_title, CASE WHEN is_title THEN 0 ELSE s END AS s, CASE WHEN is_title THEN 0 ELSE e END AS e FROM words), a AS (SELECT page_id, word_idx AS title_idx, row_number() OVER (PARTITION BY page_id ORDER BY word_idx) AS i FROM z WHERE is_title), "
       "b AS (SELECT page_id, word_idx AS spoken_idx, row_number() OVER (PARTITION BY page_id ORDER BY word_idx) AS i FROM z WHERE s > 0 OR e > 0) SELECT page_id, i::INTEGER AS i, title_idx, spoken_idx FROM a JOIN b USING (page_id, i)")  # fmt: skip
def title_mirror(spark, sf_dir):
    words = I.token_words(spark, sf_dir).withColumns({c: F.when(F.col("is_title"), 0.0).otherwise(F.col(c)) for c in ("start", "end")})
    return joins.mirror_titles(words)


@query("SELECT doc_id, (n_chars // 13 // 60)::VARCHAR || ':' || lpad(((n_chars // 13) % 60)::VARCHAR, 2, '0') AS clock, coalesce(nullif(regexp_extract(source, '([0-9]+)$', 1), '')::INTEGER, 3) AS book, length(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS html_length, "
       "CASE doc_id % 4 WHEN 0 THEN 'audio/mpeg' WHEN 1 THEN 'audio/wav' WHEN 2 THEN 'audio/ogg' ELSE 'audio/mpeg' END AS mime FROM documents")  # fmt: skip
def page_functions(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents")
    number = text.book_number(F.regexp_replace("source", "^src", "livro"))
    name = F.element_at(F.array(*(F.lit(x) for x in ("a.mp3", "b.wav", "c.OGG", "d.unknown"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs.select("doc_id", text.clock(F.floor(F.col("n_chars") / 13)).alias("clock"), number.alias("book"), F.length(text.escape_html(F.col("text"))).alias("html_length"), text.mime_type(name).alias("mime"))


@query("SELECT doc_id, CASE WHEN toxic IS NOT NULL THEN 'labels' WHEN lang = 'en' THEN 'lang' ELSE 'source' END AS provider FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)")
def provider_fallback(spark, sf_dir):
    docs, labels = I.table(spark, sf_dir, "documents"), I.table(spark, sf_dir, "labels")
    tables = {"labels": labels.select("doc_id").distinct().join(docs.select("doc_id"), "doc_id"), "lang": docs.where("lang = 'en'").select("doc_id"), "source": docs.select("doc_id")}
    return joins.by_provider(tables, "doc_id").select("doc_id", "provider")


@query("SELECT conv_id, turn::INTEGER AS word_idx, role AS word, turn::DOUBLE AS start, turn::DOUBLE + 0.5::DOUBLE AS \"end\", CASE WHEN turn % 2 = 0 THEN 0.9 ELSE 1 END::DOUBLE AS confidence, turn = 0 AS is_title FROM (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY ALL)")
def nested_round_trip(spark, sf_dir):
    """Turns written as nested documents and read again."""
    turns = I.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    i = F.col("turn").cast("int")
    words = turns.select(F.col("conv_id").alias("page_id"), i.alias("word_idx"), F.col("role").alias("word"), i.cast("double").alias("start"), (i + 0.5).cast("double").alias("end"), F.when(i % 2 == 0, 0.9).otherwise(1.0).alias("confidence"), F.lit(False).alias("line_break_after"), (i == 0).alias("is_title"))
    docs = sinks.documents(words, words.select("page_id").distinct().withColumn("language", F.lit("pt")))
    from ..schemas import RESULT

    read = pages.normal_results(docs.select("page_id", F.from_json("json", RESULT).alias("r")).select("page_id", "r.*"))
    return pages.words_of(read).select(F.col("page_id").alias("conv_id"), "word_idx", "word", "start", "end", "confidence", "is_title")


@query("SELECT c.conv_id AS page_id, (row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) - 1)::INTEGER AS word_idx, role AS word, turn::DOUBLE AS start, turn::DOUBLE + 1::DOUBLE AS \"end\", CASE WHEN turn % 2 = 0 THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence FROM (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY ALL) c WHERE turn % 3 <> 2")
def scored_response(spark, sf_dir):
    """A forced alignment's response made of turns, read as words: blank and untimed ones left out, unscored ones defaulted."""
    turns = I.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    t = F.col("turn").cast("double")
    word = F.struct(F.when(F.col("turn") % 3 == 2, " ").otherwise(F.col("role")).alias("word"), t.alias("start"), (t + 1).alias("end"), F.when(F.col("turn") % 2 == 0, 0.5).alias("score"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", word.alias("w")))).alias("ws"))
    body = rows.select(F.col("conv_id").alias("page_id"), F.to_json(F.struct(F.array(F.struct(F.lit("x").alias("text"), F.lit(9.0).alias("end"), F.col("ws.w").alias("words"))).alias("segments"))).alias("json"))
    return responses.scored_words(body)[1].select("page_id", "word_idx", "word", "start", "end", "confidence")


TURNS = "turns AS (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations GROUP BY ALL)"


def _by_conversation(spark, sf_dir: str, make) -> DataFrame:
    """(page_id, json): make(array of turns in order) of each conversation, as JSON."""
    turns = I.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    return rows.select(F.col("conv_id").alias("page_id"), F.to_json(make(F.col("ts"))).alias("json"))


def _spoken(t) -> list:
    return [t["role"].alias("word"), t["turn"].cast("double").alias("start"), (t["turn"] + 0.5).cast("double").alias("end")]


@query(f"WITH {TURNS} SELECT conv_id AS page_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS word_idx, role AS word, turn::DOUBLE AS start, turn::DOUBLE + 0.5::DOUBLE AS \"end\", 1::DOUBLE AS confidence FROM turns")
def plain_response(spark, sf_dir):
    """A response of one list of words, one for each turn."""
    body = _by_conversation(spark, sf_dir, lambda ts: F.struct(F.lit(9.0).alias("duration"), F.transform(ts, lambda t: F.struct(*_spoken(t))).alias("words")))
    return responses.plain_words(body)[1].select("page_id", "word_idx", "word", "start", "end", "confidence")


@query(f"WITH {TURNS}, w AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, max(turn) OVER (PARTITION BY conv_id) AS last FROM turns) SELECT conv_id AS page_id, last::DOUBLE + 1::DOUBLE AS duration, n::INTEGER AS word_count, sum(CASE WHEN turn % 2 = 0 THEN 0.25 ELSE 1 END)::DOUBLE AS confidence FROM w GROUP BY ALL")
def segmented_response(spark, sf_dir):
    """A response of one segment for each turn; every second word is unsure, the others don't say. Its duration is the last segment's end."""
    segment = lambda t: F.struct((t["turn"] + 1).cast("double").alias("end"), F.array(F.struct(t["role"].alias("text"), *_spoken(t)[1:], F.when(t["turn"] % 2 == 0, 0.25).alias("confidence"))).alias("words"))
    head, words = responses.segmented_words(_by_conversation(spark, sf_dir, lambda ts: F.struct(F.transform(ts, segment).alias("segments"))))
    return head.select("page_id", "duration", "word_count").join(words.groupBy("page_id").agg(F.sum("confidence").alias("confidence")), "page_id")


@query(f"WITH {TURNS} SELECT conv_id AS page_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS seq, turn::INTEGER AS word_index, role AS word, turn::DOUBLE AS original_start, turn::DOUBLE + 0.5::DOUBLE AS original_end, turn::DOUBLE + 0.25::DOUBLE AS corrected_start, turn::DOUBLE + 1::DOUBLE AS corrected_end, CASE WHEN turn % 2 = 0 THEN 0.5 ELSE 0.8 END::DOUBLE AS confidence, CASE WHEN turn % 3 = 0 THEN text ELSE '' END AS reason FROM turns")
def correction_response(spark, sf_dir):
    """Corrections of each turn, some without a confidence or a reason."""

    def one(t):
        at = t["turn"].cast("double")
        return F.struct(t["turn"].cast("int").alias("word_index"), t["role"].alias("word"), at.alias("original_start"), (at + 0.5).alias("original_end"), (at + 0.25).alias("corrected_start"), (at + 1).alias("corrected_end"), F.when(t["turn"] % 2 == 0, 0.5).alias("confidence"), F.when(t["turn"] % 3 == 0, t["text"]).alias("reason"))

    return responses.corrections(_by_conversation(spark, sf_dir, lambda ts: F.struct(F.transform(ts, one).alias("corrections"))))


@query(f"WITH {TURNS} SELECT conv_id AS page_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS word_idx, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS word, turn::DOUBLE AS start, turn::DOUBLE + 0.5::DOUBLE AS \"end\" FROM turns")
def second_source(spark, sf_dir):
    """A second source's times of each turn; every second word is left out."""
    body = _by_conversation(spark, sf_dir, lambda ts: F.struct(F.transform(ts, lambda t: F.struct(F.when(t["turn"] % 2 == 0, t["role"]).alias("word"), *_spoken(t)[1:])).alias("words")))
    return responses.second_timing(body)


@query(f"WITH {TURNS} SELECT conv_id AS page_id, coalesce(CASE WHEN conv_id % 2 = 0 THEN false END, true) AS is_spoken, min(text) FILTER (turn = 0) AS actual_first_words, CASE WHEN conv_id % 3 = 0 THEN count(*)::DOUBLE END AS start_time, CASE WHEN conv_id % 5 = 0 THEN 0.25 ELSE 0.8 END::DOUBLE AS confidence FROM turns GROUP BY conv_id")
def title_response(spark, sf_dir):
    """Checks of titles, some without an answer or a confidence."""
    turns = I.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    rows = turns.groupBy("conv_id").agg(F.count("*").cast("double").alias("n"), F.min(F.when(F.col("turn") == 0, F.col("text"))).alias("first"))
    c = F.col("conv_id")
    answer = F.struct(F.when(c % 2 == 0, False).alias("is_spoken"), F.col("first").alias("actual_first_words"), F.when(c % 3 == 0, F.col("n")).alias("start_time"), F.when(c % 5 == 0, 0.25).alias("confidence"))
    return responses.title_checks(rows.select(c.alias("page_id"), F.to_json(answer).alias("json"))).select("page_id", "is_spoken", "actual_first_words", "start_time", "confidence")


@query(f"WITH {TURNS}, asked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM turns), told AS (SELECT conv_id, upper(role) AS w, arg_min(turn, turn) AS at FROM turns WHERE turn % 2 = 1 GROUP BY ALL) "
       "SELECT a.conv_id AS page_id, a.turn::INTEGER AS ref_idx, a.role AS word, n <= 10 AND t.at IS NOT NULL AS is_spoken, CASE WHEN n <= 10 THEN t.at::DOUBLE END AS start_time, CASE WHEN n <= 10 AND t.at IS NOT NULL THEN 0.8 ELSE 0 END::DOUBLE AS confidence FROM asked a LEFT JOIN told t ON t.conv_id = a.conv_id AND t.w = upper(a.role)")  # fmt: skip
def missing_response(spark, sf_dir):
    """Answers on the first ten missing words of a page: every second turn's role was heard."""
    body = _by_conversation(spark, sf_dir, lambda ts: F.struct(F.transform(F.filter(ts, lambda t: t["turn"] % 2 == 1), lambda t: F.struct(F.lower(t["role"]).alias("word"), t["turn"].cast("double").alias("start_time"))).alias("verifications")))
    asked = I.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("word")).select(F.col("conv_id").alias("page_id"), F.col("turn").cast("int").alias("ref_idx"), "word")
    return responses.missing_checks(body, asked).select("page_id", "ref_idx", "word", "is_spoken", "start_time", "confidence")


@query(rf"""{TOK}, t AS (SELECT doc_id AS page_id, unnest(regexp_extract_all(split_part(text, chr(10), 1), '\S+')) AS word, generate_subscripts(regexp_extract_all(split_part(text, chr(10), 1), '\S+'), 1) AS k FROM documents),
n AS (SELECT page_id, count(*) AS n FROM t GROUP BY page_id)
SELECT page_id, (k - 1)::INTEGER AS word_idx, word, 0::DOUBLE AS "end" FROM t UNION ALL SELECT w.page_id, (w.word_idx + coalesce(n.n, 0))::INTEGER, w.word, round(e, 6) FROM words w LEFT JOIN n USING (page_id)""")
def prepended_titles(spark, sf_dir):
    """Each document's first line as an unspoken title before its words."""
    titles = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.substring_index("text", "\n", 1).alias("title"))
    front = pages.unspoken_titles(titles).drop("line_break_after", "is_title")
    return pages.prepended(front, I.token_words(spark, sf_dir)).select("page_id", "word_idx", "word", r6("end").alias("end"))


@query("WITH o AS (SELECT user_id, ts, coalesce(date_diff('microsecond', max(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ts) >= 1800000000, true) AS new FROM events), "
       "k AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS n FROM k GROUP BY user_id, k")  # fmt: skip
def event_pauses(spark, sf_dir):
    return pauses(I.table(spark, sf_dir, "events")).select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("SELECT doc_id, n_chars / 200::DOUBLE * 100::DOUBLE AS progress, greatest(0::DOUBLE, least(n_chars::DOUBLE, n_chars / 2::DOUBLE - 5::DOUBLE)) AS back FROM documents")
def player_arithmetic(spark, sf_dir):
    n = F.col("n_chars").cast("double")
    return I.table(spark, sf_dir, "documents").select("doc_id", playback.progress(n, F.lit(200.0)).alias("progress"), playback.seek(n / 2, F.lit(-5.0), n).alias("back"))


@query()
def citations(spark, sf_dir):
    """A citation made of each line of each document, of all kinds of works in turns, formatted."""
    docs = I.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    name = lambda a, b: F.concat(F.lit(a), F.col("line"), F.lit(b))
    kinds = [
        name("SOUZA, Ana. ", ". São Paulo: Editora, 2001."), name("LIMA, José A. de. ", ". Texto não publicado."), name("DIAS, Eva. Sol. In: MELO, Rui. ", ". 2. ed. Recife: Norte, 1990."),
        name("BRASIL. Ministério da Cultura. ", ". Disponível em: http://example.org."), name("REIS, Ana. ", "? Folhinha, São Paulo, p. 3, 2 maio 1999."),
    ]
    cited = F.element_at(F.array(*kinds), (F.pmod(F.col("doc_id") + F.col("line_no"), F.lit(len(kinds))) + 1).cast("int"))
    return docs.select("doc_id", "line_no", citation_html(cited).alias("html"))


@query(f"{QUALITY} SELECT q.page_id, 'Doc ' || q.page_id AS title, '1:05' AS duration, word_count, round_even(round(av * 100, 6), 0)::INTEGER AS confidence, q.page_id || '/index.html' AS url FROM q")
def index_page(spark, sf_dir):
    q = _quality(spark, sf_dir)
    head = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("Doc "), F.col("doc_id")).alias("title"), F.lit(65.9).alias("duration"))
    return quality.index_page(q, head)


@query()
def sync(spark, sf_dir):
    """All stages on conversations: alignment, interpolation, repairs, gaps, minimum lengths, issues, quality."""
    parts = 8 * I.parts(I.table(spark, sf_dir, "conversations"))  # aligning takes long for its bytes
    ref, heard = turns(spark, sf_dir, parts)

    # the alignment is dealt by page as the turns are, and made once for all that reads it
    dealt = lambda df, name: df.repartition(parts, "page_id") if name == "alignment" else df
    lines = ref.select("page_id", "ref_idx", "token", (F.col("ref_idx") % 8 == 7).alias("is_line_end"), (F.col("ref_idx") < 2).alias("is_title"))
    return sync_tables(lines, heard, ref.groupBy("page_id").agg((F.count("*") * 0.4 + 1).alias("duration")), kept=dealt)["quality"]


def queries() -> dict:
    from . import answers, rendering, turns  # noqa: F401  they register their own

    return dict(QUERIES)


def oracle_sql() -> dict:
    queries()
    return dict(SQL)
