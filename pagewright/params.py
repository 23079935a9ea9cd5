"""Job parameters.

Plain frozen dataclasses; ``from_mapping`` builds one from a dictionary and
rejects keys it does not know.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields
from functools import lru_cache
from pathlib import Path
from typing import Any

_STOP_WORDS_FILE = Path(__file__).parent / "data" / "stop_words.txt"


@lru_cache(maxsize=1)
def default_stop_words() -> tuple[str, ...]:
    lines = _STOP_WORDS_FILE.read_text(encoding="utf-8").splitlines()
    return tuple(w for line in lines if not line.startswith("#") for w in line.split())


class _FromMapping:
    @classmethod
    def from_mapping(cls, values: Mapping[str, Any]):
        known = {f.name for f in fields(cls)}
        unknown = sorted(set(values) - known)
        if unknown:
            raise ValueError(f"unknown {cls.__name__} keys: {', '.join(unknown)}")
        return cls(**values)


@dataclass(frozen=True)
class CrawlParams(_FromMapping):
    """How far a traversal goes and which sites it may enter."""

    max_pages: int | None = None
    max_depth: int = 3
    algorithm: str = "BFS"
    allowed_domains: tuple[str, ...] = ()


@dataclass(frozen=True)
class IndexParams(_FromMapping):
    """Vocabulary rules of the TF-IDF index."""

    max_features: int = 10_000
    min_df: int = 1
    max_df: float = 0.95
    stop_words: tuple[str, ...] | None = None

    def stop_list(self) -> list[str]:
        return list(default_stop_words() if self.stop_words is None else self.stop_words)


@dataclass(frozen=True)
class SearchParams(_FromMapping):
    """Ranking rules of a search batch. A cache entry holds ``cache_rows`` records, or ``limit`` where that is more."""

    limit: int = 10
    threshold: float = 0.001
    snippet_chars: int = 200
    cache_ttl_seconds: int = 3600
    cache_rows: int = 100
