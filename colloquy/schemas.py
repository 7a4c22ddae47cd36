"""Row layouts of the engine's tables. Times are seconds as doubles; order columns start at 0."""

from __future__ import annotations

SEGMENTS = "session_id string, seg_id string, seg_ord bigint, speaker_id int, text string, start_s double, end_s double, interim boolean"
SPEAKERS = "session_id string, id int, name string, color string, median_pitch_hz double"
SUGGESTIONS = (
    "session_id string, seg_id string, seg_ord bigint, kind string, det_ord int, lex_ord int, "
    "start int, end int, excerpt string, replacement string, message string"
)
FRAMES = "session_id string, time_s double, pitch_hz double, centroid_hz double, energy double"
WORDS = "session_id string, word_ord bigint, text string, start_s double, end_s double"
CHUNKS = "session_id string, chunk_ord bigint, text string, ts struct<start: double, end: double>"
REGIONS = "session_id string, reg_ord bigint, start_s double, end_s double, speaker_id int, median_pitch_hz double"
WINDOWS = "session_id string, win_ord bigint, start_s double, end_s double"
DRAFTS = (
    "id string, name string, saved_at bigint, "
    "segments array<struct<seg_id: string, seg_ord: bigint, speaker_id: int, text: string, start_s: double, end_s: double>>, "
    "speakers array<struct<id: int, name: string, color: string, median_pitch_hz: double>>"
)
EVENTS = "session_id string, seq bigint, ts timestamp, result_index int, results array<struct<is_final: boolean, transcript: string>>"

#: Kinds of suggestions in the order in which detectors run. Fixed values.
KINDS = ("filler", "stutter", "repeated-word", "hedge", "weak-phrase", "run-on", "spacing")
UNKNOWN_SPEAKER = -1
