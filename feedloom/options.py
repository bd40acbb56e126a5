"""Settings of one enrichment run."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

# Text lengths in code points.
TAGGING_EXCERPT_CHARS = 4000
TITLE_PREVIEW_CHARS = 160
CONTENT_PREVIEW_CHARS = 280
STORED_ERROR_CHARS = 5000


@dataclass(frozen=True)
class EnrichOptions:
    """What to process and within which limits.

    ``run_ts`` stands in for the clock so that a run can be repeated; ``quota``
    is the number of articles to translate, ``None`` meaning all of them. An article
    that failed is not asked again before ``retry_minutes`` have passed, twice as many
    after every further failure; without it, it is asked again behind all others.
    """

    run_ts: datetime
    feed_ids: tuple[int, ...]
    owner_uid: int = 1
    target_language: str = "zh-CN"
    source_langs: tuple[str, ...] = ()
    lookback_hours: int = 48
    quota: int | None = 10
    require_single_owner: bool = True
    dry_run: bool = False
    max_texts: int = 40
    max_chars: int = 8000
    tagging: bool = False
    max_tags: int = 6
    tag_language: str | None = None
    distinct_texts: bool = False
    retry_minutes: int | None = None

    def __post_init__(self) -> None:
        if not self.feed_ids:
            raise ValueError("feed_ids must name at least one feed")
        minimums = {
            "owner_uid": 1,
            "lookback_hours": 1,
            "quota": 1,
            "max_texts": 1,
            "max_chars": 100,
            "max_tags": 1,
            "retry_minutes": 1,
        }
        for name, minimum in minimums.items():
            value = getattr(self, name)
            if value is not None and value < minimum:
                raise ValueError(f"{name} must be >= {minimum}")
        lowered = tuple(lang.strip().lower() for lang in self.source_langs if lang.strip())
        object.__setattr__(self, "source_langs", lowered)
        if not self.tag_language:
            object.__setattr__(self, "tag_language", self.target_language)
