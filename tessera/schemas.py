"""Explicit schemas of the tables that the sequence operators read, and of stored documents."""

WORD = "word STRING, start DOUBLE, end DOUBLE, confidence DOUBLE, line_break_after BOOLEAN, is_title BOOLEAN"
WORDS = f"page_id STRING, word_idx INT, {WORD}"
METRICS = "average_confidence DOUBLE, gaps_preserved INT, gaps_filled INT, gaps_review INT, low_confidence_words INT, prosody_preserved_score DOUBLE, timing_precision_ms DOUBLE, word_accuracy DOUBLE, alignment_method STRING, words_matched INT, words_interpolated INT, words_verified INT, title_verified BOOLEAN"
ISSUE = "word_index INT, type STRING, message STRING, severity STRING, suggested_correction MAP<STRING, DOUBLE>"
#: A page's stored result.
RESULT = f"audio_file STRING, language STRING, duration DOUBLE, title STRING, full_text STRING, word_count INT, words ARRAY<STRUCT<{WORD}>>, metrics STRUCT<{METRICS}>, low_confidence_words ARRAY<STRING>, timestamp_issues STRUCT<words_checked INT, total_issues INT, errors INT, warnings INT, issues_by_type MAP<STRING, INT>, issues ARRAY<STRUCT<{ISSUE}>>>"

#: Responses of speech recognisers.
PLAIN = "duration DOUBLE, text STRING, words ARRAY<STRUCT<word STRING, start DOUBLE, end DOUBLE>>"
SEGMENTED = "duration DOUBLE, text STRING, segments ARRAY<STRUCT<end DOUBLE, words ARRAY<STRUCT<text STRING, start DOUBLE, end DOUBLE, confidence DOUBLE>>>>"
SCORED = "segments ARRAY<STRUCT<text STRING, end DOUBLE, words ARRAY<STRUCT<word STRING, start DOUBLE, end DOUBLE, score DOUBLE>>>>"

#: Responses of annotating models.
CORRECTIONS = "corrections ARRAY<STRUCT<word_index INT, word STRING, original_start DOUBLE, original_end DOUBLE, corrected_start DOUBLE, corrected_end DOUBLE, confidence DOUBLE, reason STRING>>, overall_confidence DOUBLE"
POST_PAUSE = "words ARRAY<STRUCT<index INT, word STRING, start DOUBLE, end DOUBLE>>"
PROSODY = "events ARRAY<STRUCT<type STRING, time DOUBLE, word STRING, confidence DOUBLE>>, gap_analyses ARRAY<STRUCT<gap_start DOUBLE, gap_end DOUBLE, has_breath BOOLEAN, has_pitch_reset BOOLEAN, is_sentence_boundary BOOLEAN, recommendation STRING, confidence DOUBLE>>, overall_confidence DOUBLE"
TITLE_CHECK = "is_spoken BOOLEAN, actual_first_words STRING, start_time DOUBLE, end_time DOUBLE, confidence DOUBLE"
MISSING_WORDS = "verifications ARRAY<STRUCT<word STRING, is_spoken BOOLEAN, start_time DOUBLE, end_time DOUBLE, confidence DOUBLE>>"
SECOND_TIMING = "words ARRAY<STRUCT<word STRING, start DOUBLE, end DOUBLE, confidence DOUBLE, corrected BOOLEAN>>, overall_confidence DOUBLE"
CHECKLIST = "book INT, page_id STRING, title STRING, text_file STRING, citation_file STRING, source_audio STRING, audio STRING, timestamps STRING, html STRING, index STRING, word_count INT, html_kb DOUBLE, status STRING"
