"""Schemas of the tables the engine reads and writes."""

from __future__ import annotations

ENTRIES = "id BIGINT, title STRING, content STRING, link STRING, lang STRING, date_entered TIMESTAMP"

USER_ENTRIES = "int_id BIGINT, ref_id BIGINT, owner_uid INT, feed_id INT, tag_cache STRING"

FEEDS = "id INT, owner_uid INT, title STRING"

TAGS = "id BIGINT, tag_name STRING, owner_uid INT, post_int_id BIGINT"

TRANSLATIONS = (
    "entry_id BIGINT NOT NULL, owner_uid INT NOT NULL, user_entry_id BIGINT, feed_id INT, "
    "source_lang STRING, target_language STRING NOT NULL, source_hash STRING NOT NULL, "
    "source_title STRING NOT NULL, source_content STRING NOT NULL, "
    "translated_title STRING NOT NULL, translated_content STRING NOT NULL, "
    "generated_tags ARRAY<STRING> NOT NULL, translated_at TIMESTAMP NOT NULL, "
    "reapplied_at TIMESTAMP, updated_at TIMESTAMP NOT NULL, last_error STRING"
)

ERRORS = (
    "entry_id BIGINT, owner_uid INT, user_entry_id BIGINT, stage STRING, message STRING, "
    "failed_at TIMESTAMP"
)

# Failed tries to translate an article that has not been translated since
ATTEMPTS = "entry_id BIGINT, owner_uid INT, attempts INT, next_try TIMESTAMP"

INDEX = (
    "id BIGINT, entered TIMESTAMP, entered_day STRING, arrived_at TIMESTAMP, digest BIGINT"
)

# What backends said, by the SHA-256 of what they were asked
ANSWERS = "asked STRING, output ARRAY<STRING>, reply STRING"

FULLTEXT = "url STRING, content STRING, error STRING"

ALL = {
    "entries": ENTRIES,
    "user_entries": USER_ENTRIES,
    "feeds": FEEDS,
    "tags": TAGS,
    "translations": TRANSLATIONS,
    "errors": ERRORS,
    "attempts": ATTEMPTS,
    "index": INDEX,
    "answers": ANSWERS,
}
