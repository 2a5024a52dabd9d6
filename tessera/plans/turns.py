"""Queries on turns of conversations: walks along a text, prompts, and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import similarity, text
from ..functions.similarity import MISMATCH, SCORES, SOUNDS
from ..operators import align, walks
from . import inputs as I  # noqa: E812
from .catalog import query, r6, turns

#: Turns as pages: tokens, and the words that were heard of them.
TURNS_SQL = r"""toks AS (SELECT coalesce(conv_id::VARCHAR, '') || '/' || coalesce(turn::VARCHAR, '') AS page_id, unnest(regexp_extract_all(text, '\S+')) AS token, (generate_subscripts(regexp_extract_all(text, '\S+'), 1) - 1)::INTEGER AS ref_idx FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL)),
heard AS (SELECT page_id, ref_idx AS word_idx, CASE WHEN ref_idx % 4 = 1 THEN lower(token) || 's' ELSE token END AS word, ref_idx * 0.4::DOUBLE AS s, ref_idx * 0.4::DOUBLE + 0.3::DOUBLE AS e FROM toks WHERE ref_idx % 9 <> 5)"""
CLEAN = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]', '', 'g')".format

WALK_SQL = f"""WITH RECURSIVE {TURNS_SQL},
ref AS (SELECT page_id, list({CLEAN("token")} ORDER BY ref_idx) AS cleans FROM toks GROUP BY page_id),
w AS (SELECT page_id, word_idx, word, {CLEAN("word")} AS clean, row_number() OVER (PARTITION BY page_id ORDER BY word_idx) AS k FROM heard),
walk AS (SELECT page_id, 0::BIGINT AS k, 0::BIGINT AS pos, 0::BIGINT AS hit FROM ref
  UNION ALL SELECT page_id, k, pos + greatest(found, 1), CASE WHEN found > 0 THEN pos + found ELSE 0 END
  FROM (SELECT w.page_id, w.k, walk.pos, coalesce(list_position(cleans[pos + 1:pos + 5], clean), 0)::BIGINT AS found FROM walk JOIN w ON w.page_id = walk.page_id AND w.k = walk.k + 1 JOIN ref ON ref.page_id = w.page_id))
SELECT w.page_id, w.word_idx, CASE WHEN hit > 0 THEN (hit - 1) % 8 = 7 ELSE false END AS line_break_after, CASE WHEN hit > 0 THEN hit - 1 END::INTEGER AS ref_idx FROM w JOIN walk USING (page_id, k)"""


@query(WALK_SQL)
def pointer_walk(spark, sf_dir) -> DataFrame:
    """Heard words, some of them wrong or left out, walk along their turn's tokens; every eighth token ends a line."""
    ref, heard = turns(spark, sf_dir)
    ref = ref.withColumn("is_line_end", F.col("ref_idx") % 8 == 7)
    return walks.walk_line_breaks(heard, ref).select("page_id", "word_idx", "line_break_after", "ref_idx")


PROMPTS_SQL = f"""WITH RECURSIVE {TURNS_SQL},
w AS (SELECT page_id, word_idx, word, round_even(s, 3) AS s, round_even(e, 3) AS e, round_even((e - s) * 1000::DOUBLE, 1) AS ms, ceil(length(word) / 4)::BIGINT + 5 AS cost, row_number() OVER (PARTITION BY page_id ORDER BY word_idx) AS k FROM heard WHERE NOT (s = 0 AND word_idx < 2)),
p AS (SELECT page_id, k, 0::BIGINT AS prompt, cost AS used FROM w WHERE k = 1
  UNION ALL SELECT page_id, k, prompt + full_up::INTEGER, CASE WHEN full_up THEN cost ELSE used + cost END FROM (SELECT w.page_id, w.k, p.prompt, p.used, w.cost, p.used + w.cost > 200 AS full_up FROM p JOIN w ON w.page_id = p.page_id AND w.k = p.k + 1))
SELECT page_id, prompt::INTEGER AS prompt, min(word_idx) AS first_idx, max(word_idx) AS last_idx, count(*) AS n_words, sum(cost)::BIGINT AS cost,
  string_agg(word_idx || ' ' || word || ' ' || printf('%.3f', s) || ' ' || printf('%.3f', e) || ' ' || printf('%.1f', ms), chr(10) ORDER BY word_idx) AS text FROM w JOIN p USING (page_id, k) GROUP BY ALL"""


@query(PROMPTS_SQL)
def prompt_batches(spark, sf_dir) -> DataFrame:
    """Timed words of each turn in prompts of 200 tokens at most; its first word is a title's without a time."""
    _, heard = turns(spark, sf_dir)
    first = (F.col("start") == 0) & (F.col("word_idx") < 2)
    words = heard.withColumns({"is_title": F.col("word_idx") < 2, "end": F.when(first, 0.0).otherwise(F.col("end"))})
    return walks.prompts(words, 200)


# letters as single bytes, as SQL's edit distance counts bytes
_BYTES = "translate({}, 'áàâãäåæçèéêëìíîïñòóôõöùúûüß', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ#')".format
_EDITS = lambda a, b: f"CASE WHEN {a} = {b} THEN 1 ELSE 1 - levenshtein({_BYTES(a)}, {_BYTES(b)})::DOUBLE / greatest(length({a}), length({b})) END"


def _sound_sql(word: str) -> str:
    for spelling, sound in SOUNDS:
        word = f"replace({word}, '{spelling}', '{sound}')"
    return word


#: Similarity of clean words a and b whose sounds are x and y.
_ALIKE = f"""CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN 1 WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b))::DOUBLE / greatest(length(a), length(b))
  ELSE greatest(0.8::DOUBLE * len(list_intersect(list_distinct(string_split(a, '')), list_distinct(string_split(b, ''))))::DOUBLE / len(list_distinct(string_split(a || b, ''))), {_EDITS("a", "b")}, {_EDITS("x", "y")}) END"""
_POINTS = f"CASE {' '.join(f'WHEN s >= {least}::DOUBLE THEN {points}' for least, points in SCORES)} ELSE {MISMATCH} END"


@query(f"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(text, '\\S+')) AS t, generate_subscripts(regexp_extract_all(text, '\\S+'), 1) AS k FROM benchmark), c AS (SELECT item_id, k, {CLEAN("t")} AS w FROM t),
n AS (SELECT w AS a, unnest([lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o]) AS b FROM c WINDOW o AS (PARTITION BY item_id ORDER BY k)), p AS (SELECT DISTINCT a, b, {_sound_sql("a")} AS x, {_sound_sql("b")} AS y FROM n WHERE b IS NOT NULL), q AS (SELECT a, b, {_ALIKE} AS s FROM p)
SELECT a, b, round(s, 6)::DOUBLE AS similarity, {_POINTS} AS score FROM q""")
def word_similarity(spark, sf_dir) -> DataFrame:
    """Each word of the benchmark's texts with the three that follow it."""
    tokens = I.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(text.tokens(F.col("text"))).alias("k", "t"))
    order = W.Window.partitionBy("item_id").orderBy("k")
    following = tokens.select("item_id", "k", text.clean_token(F.col("t")).alias("a")).select("a", F.array(*(F.lead("a", k).over(order) for k in (1, 2, 3))).alias("next"))
    pairs = following.select("a", F.explode("next").alias("b")).where("b IS NOT NULL").distinct()
    s = similarity.word_similarity(F.col("a"), F.col("b"))
    return pairs.select("a", "b", r6(s).alias("similarity"), similarity.pair_score(s).alias("score"))


#: Similarities and scores of the words of each turn, as a matrix of scores; best and move of each cell by anti-diagonals (cells by row); the way back.
ALIGN_SQL = f"""WITH RECURSIVE {TURNS_SQL},
r AS (SELECT page_id, ref_idx, token, {CLEAN("token")} AS c FROM toks), h AS (SELECT *, {CLEAN("word")} AS c, row_number() OVER (PARTITION BY page_id ORDER BY word_idx) AS k FROM heard),
known AS MATERIALIZED (SELECT c, length(c) AS n, list_distinct(string_split(c, '')) AS letters, {_sound_sql("c")} AS x FROM (SELECT c FROM r UNION SELECT c FROM h)),
coded AS MATERIALIZED (SELECT *, {_BYTES("c")} AS cb, {_BYTES("x")} AS xb, length(x) AS xn, len(letters) AS k FROM known),
pairs AS (SELECT DISTINCT r.c AS a, h.c AS b FROM r JOIN h USING (page_id)),
scored AS MATERIALIZED (SELECT a, b, {_POINTS} AS score FROM (SELECT a, b, CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN 1 WHEN contains(a, b) OR contains(b, a) THEN least(p.n, q.n)::DOUBLE / greatest(p.n, q.n) ELSE greatest(0,
  CASE WHEN least(p.k, q.k) >= 0.75 * greatest(p.k, q.k) THEN 0.8::DOUBLE * len(list_intersect(p.letters, q.letters))::DOUBLE / (p.k + q.k - len(list_intersect(p.letters, q.letters))) END,
  CASE WHEN abs(p.n - q.n) <= 0.4 * greatest(p.n, q.n) THEN 1 - levenshtein(p.cb, q.cb)::DOUBLE / greatest(p.n, q.n) END,
  CASE WHEN p.x = q.x THEN 1 WHEN abs(p.xn - q.xn) <= 0.4 * greatest(p.xn, q.xn) THEN 1 - levenshtein(p.xb, q.xb)::DOUBLE / greatest(p.xn, q.xn) END) END AS s FROM pairs JOIN coded p ON p.c = a JOIN coded q ON q.c = b)),
lines AS (SELECT r.page_id, r.ref_idx, list(score ORDER BY h.k) AS line FROM r JOIN h USING (page_id) JOIN scored ON scored.a = r.c AND scored.b = h.c GROUP BY ALL),
page AS MATERIALIZED (SELECT page_id, count(*) AS m, any_value(len(line)) AS n, list(line ORDER BY ref_idx) AS s FROM lines GROUP BY page_id),
walk AS (SELECT page_id, 0::BIGINT AS d, list_transform(range(0, m + 1), lambda i: 0) AS b1, list_transform(range(0, m + 1), lambda i: 0) AS v1, list_transform(range(0, m + 1), lambda i: 0) AS b2 FROM page
  UNION ALL SELECT page_id, d, list_transform(cells, lambda x: x.b), list_transform(cells, lambda x: x.v), b1 FROM (SELECT w.page_id, w.d + 1 AS d, w.b1, list_transform(list_transform(range(0, m + 1), lambda i:
    CASE WHEN i = 0 OR i = w.d + 1 THEN struct_pack(g := -4 - w.d::INTEGER, u := CASE WHEN i = 0 THEN -1000000 ELSE -4 - w.d::INTEGER END, l := CASE WHEN i = 0 THEN -4 - w.d::INTEGER ELSE -1000000 END, e := true)
    WHEN i > w.d + 1 OR i < w.d + 1 - n THEN struct_pack(g := 0, u := 0, l := 0, e := false)
    ELSE struct_pack(g := w.b2[i] + s[i][w.d + 1 - i], u := w.b1[i] + CASE WHEN w.v1[i] = 2 THEN -1 ELSE -4 END, l := w.b1[i + 1] + CASE WHEN w.v1[i + 1] = 3 THEN -1 ELSE -4 END, e := false) END),
    lambda x: struct_pack(b := CASE WHEN x.e THEN greatest(x.u, x.l) ELSE greatest(x.g, x.u, x.l) END, v := CASE WHEN x.e THEN CASE WHEN x.u > x.l THEN 2 ELSE 3 END WHEN x.g >= x.u AND x.g >= x.l THEN 1 WHEN x.u >= x.l THEN 2 ELSE 3 END)) AS cells
    FROM walk w JOIN page p ON p.page_id = w.page_id WHERE w.d < m + n)),
moves AS MATERIALIZED (SELECT page_id, d, v1 FROM walk),
back AS (SELECT page_id, 0::BIGINT AS k, m AS i, n AS j, 0 AS move FROM page
  UNION ALL SELECT b.page_id, b.k + 1, b.i - (v1[b.i + 1] <> 3)::INTEGER, b.j - (v1[b.i + 1] <> 2)::INTEGER, v1[b.i + 1] FROM back b JOIN moves w ON w.page_id = b.page_id AND w.d = b.i + b.j WHERE b.i + b.j > 0),
steps AS (SELECT b.page_id, (max(b.k) OVER (PARTITION BY b.page_id) - b.k)::INTEGER AS step, CASE WHEN move <> 3 THEN b.i::INTEGER END AS ref_idx, CASE WHEN move <> 2 THEN h.word_idx END::INTEGER AS trans_idx, ['match', 'deletion', 'insertion'][move] AS op
  FROM back b LEFT JOIN h ON h.page_id = b.page_id AND h.k = b.j + 1 AND move <> 2 WHERE b.k > 0)"""


@query(f"{ALIGN_SQL} SELECT * FROM steps")
def align_turns(spark, sf_dir) -> DataFrame:
    return align.align(*turns(spark, sf_dir))


@query(f"{ALIGN_SQL} SELECT * FROM steps")
def align_udtf(spark, sf_dir) -> DataFrame:
    """The alignment of every turn by the table function, from SQL."""
    align.register_align(spark)
    return spark.sql("SELECT * FROM align_words(TABLE(SELECT *, pmod(hash(page_id), 1024) AS part FROM {sides}) PARTITION BY part ORDER BY page_id)", sides=align.sides(*turns(spark, sf_dir)))


@query(f"{ALIGN_SQL} SELECT page_id, count(*) FILTER (op = 'match') AS matched, count(*) FILTER (op = 'deletion') AS deleted, count(*) FILTER (op = 'insertion') AS inserted, count(*) AS steps FROM steps GROUP BY page_id")
def align_stats(spark, sf_dir) -> DataFrame:
    return align.alignment_counts(align.align(*turns(spark, sf_dir)))


@query(f"""{ALIGN_SQL} SELECT r.page_id, r.ref_idx AS word_idx, r.token AS word, coalesce(round(h.s, 6), 0) AS start, coalesce(round(h.e, 6), 0) AS "end", round(CASE WHEN op = 'match' THEN 0.9::DOUBLE * m.s ELSE 0.3 END, 6)::DOUBLE AS confidence, op,
  round(coalesce(m.s, 0), 6)::DOUBLE AS similarity, CASE WHEN CASE WHEN op = 'match' THEN 0.9::DOUBLE * m.s ELSE 0.3 END < 0.6 THEN 'needs_review' ELSE 'matched' END AS status
  FROM steps JOIN r ON r.page_id = steps.page_id AND r.ref_idx = steps.ref_idx LEFT JOIN h ON h.page_id = steps.page_id AND h.word_idx = steps.trans_idx
  LEFT JOIN (SELECT a, b, {_ALIKE} AS s FROM (SELECT DISTINCT r.c AS a, h.c AS b, {_sound_sql("r.c")} AS x, {_sound_sql("h.c")} AS y FROM steps JOIN r ON r.page_id = steps.page_id AND r.ref_idx = steps.ref_idx JOIN h ON h.page_id = steps.page_id AND h.word_idx = steps.trans_idx)) m ON m.a = r.c AND m.b = h.c""")
def aligned_words(spark, sf_dir) -> DataFrame:
    parts = 8 * I.parts(I.table(spark, sf_dir, "conversations"))  # aligning takes long for its bytes
    ref, heard = turns(spark, sf_dir, parts)
    out = align.flag_uncertain(align.aligned_words(align.align(ref, heard).repartition(parts, "page_id"), ref, heard))
    return out.select("page_id", "word_idx", "word", *(r6(c).alias(c) for c in ("start", "end", "confidence")), "op", r6("similarity").alias("similarity"), "status")
