"""Schemas of the data model, as DDL. Times of cues are milliseconds, of words and segments seconds."""

CUE = "cue_index int, start_ms bigint, end_ms bigint, text string"
WORD = "file_id string, seq int, word string, start double, end double"
SEGMENT = "file_id string, seq int, start double, end double, text string"
OUTPUT = "path string, translation_identity string, output_identity string, sha256 string"
STATE = (
    "key string, status string, stage string, updated_at timestamp, error string, video_identity string, "
    f"stt_identity string, source_sha256 string, outputs map<string, struct<{OUTPUT.replace(' string', ': string')}>>"
)
CHECKPOINT = "version int, source_sha256 string, model string, total int, translations array<string>, translation_key string"
EVENT = (
    "protocol int, generation string, event string, job_id string, attempt string, seconds double, "
    "duration double, segments int, language string, fatal boolean, error string"
)
LOG = "time string, video string, event string, fields map<string, string>"
