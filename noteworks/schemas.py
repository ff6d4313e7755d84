"""Schemas of the tables that cross a file or stream boundary."""

RAW_NOTES = "ID string, Date string, Duration string, Language string, Length string, Transcription string"
REQUIRED_NOTE_COLUMNS = ("ID", "Date", "Duration", "Language", "Length", "Transcription")
LEXICON_JSON = (
    "map<string, struct<label:string, aliases:array<string>, languages:array<string>, freq_notes:bigint, "
    "examples:array<string>, bucket:string>>"
)
UPLOAD_EVENT = (
    "upload_type string, csv_path string, user_id bigint, upload_session_id bigint, client_id bigint, filename string, "
    "text string, language string, _ts timestamp, _topic string"
)
