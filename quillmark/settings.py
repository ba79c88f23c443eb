"""Settings of a workspace, kept as JSON. Unknown keys are reported and passed over; an unreadable file gives the defaults."""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from quillmark.functions import constants as K

log = logging.getLogger("quillmark")


@dataclass
class Indexing:
    max_file_size: int = K.MAX_FILE_BYTES
    chunk_size: int = K.SENTENCE_CHARS
    chunk_overlap: int = K.OVERLAP_CHARS
    enable_embeddings: bool = True
    ignored_patterns: list[str] = field(default_factory=lambda: list(K.IGNORE_PATTERNS))


@dataclass
class Search:
    max_results: int = K.MAX_RESULTS
    default_token_limit: int = K.TOKEN_LIMIT
    semantic_threshold: float = K.SEMANTIC_THRESHOLD
    cache_size: int = K.CACHED_RESULTS


@dataclass
class Logging:
    level: str = "INFO"


@dataclass
class Settings:
    indexing: Indexing = field(default_factory=Indexing)
    search: Search = field(default_factory=Search)
    logging: Logging = field(default_factory=Logging)

    def update(self, **values) -> None:
        """Sets top-level parts or their fields by name; unknown names are passed over."""
        for part in (self.indexing, self.search, self.logging):
            for f in fields(part):
                if f.name in values:
                    setattr(part, f.name, values[f.name])


def parsed(text: str) -> Settings:
    """Settings of a JSON text; what it lacks has its default, and a text that is no JSON object gives the defaults."""
    out = Settings()
    try:
        raw = json.loads(text)
        for part in fields(out):
            for key, value in (raw.get(part.name) or {}).items():
                if hasattr(getattr(out, part.name), key):
                    setattr(getattr(out, part.name), key, value)
                else:
                    log.warning("unknown setting %s.%s", part.name, key)
    except (ValueError, AttributeError):
        return Settings()
    return out


def rendered(settings: Settings) -> str:
    return json.dumps(asdict(settings), indent=2)


def load(path: str | Path) -> Settings:
    try:
        return parsed(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return Settings()


def save(settings: Settings, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(rendered(settings), encoding="utf-8")


def configure_logging(level: str = "INFO", file: str | Path | None = None) -> None:
    """Logs to the console and, if it can be opened, to a file; else a warning says so."""
    log.setLevel(level)
    log.handlers = [logging.StreamHandler()]
    if file is not None:
        add_log_file(file)


def add_log_file(file: str | Path) -> None:
    try:
        Path(file).parent.mkdir(parents=True, exist_ok=True)
        log.addHandler(logging.FileHandler(file, encoding="utf-8"))
    except OSError as error:
        log.warning("no log file at %s: %s", file, error)
