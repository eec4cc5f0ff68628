"""Options of sources and previews."""

from __future__ import annotations

from dataclasses import dataclass, replace

from .errors import InvalidConfiguration

MAX_RECORD_BYTES = 16 * 1024 * 1024
TARGET_RECORD_BYTES = 4096
CHECKPOINT_INTERVAL = 100
EVIDENCE_RECORDS = 5
EVIDENCE_BYTES = 512
EVIDENCE_BYTES_SINGLE = 4096
PROGRESS_STEP = 10_000


@dataclass(frozen=True)
class XmlConfig:
    record_element: str
    max_record_bytes: int = MAX_RECORD_BYTES

    def __post_init__(self) -> None:
        if not self.record_element:
            raise InvalidConfiguration("record_element must not be empty")
        if self.max_record_bytes <= 0:
            raise InvalidConfiguration("max_record_bytes must be greater than zero")

    def with_max_record_bytes(self, n: int) -> XmlConfig:
        return replace(self, max_record_bytes=n)


@dataclass(frozen=True)
class TextConfig:
    target_record_bytes: int = TARGET_RECORD_BYTES

    def __post_init__(self) -> None:
        if self.target_record_bytes <= 0:
            raise InvalidConfiguration("target_record_bytes must be greater than zero")


@dataclass(frozen=True)
class PreviewConfig:
    target_bytes: int = 4096
    stop_element: str | None = "title"
    max_children: int = 10

    def __post_init__(self) -> None:
        if self.target_bytes <= 0:
            raise InvalidConfiguration("preview target_bytes must be greater than zero")
        if self.max_children <= 0:
            raise InvalidConfiguration("preview max_children must be greater than zero")
        if self.stop_element == "":
            raise InvalidConfiguration("preview stop_element must not be empty")

    @classmethod
    def new(cls, target_bytes: int, max_children: int) -> PreviewConfig:
        """Without a stop element."""
        return cls(target_bytes, None, max_children)

    def with_stop_element(self, name: str) -> PreviewConfig:
        return replace(self, stop_element=name)


def checkpoint_interval(n: int) -> int:
    if n <= 0:
        raise InvalidConfiguration("checkpoint interval must be greater than zero")
    return n
