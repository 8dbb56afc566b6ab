"""Runs of letters or digits in UTF-8 bytes, whole texts read in bounded parts."""

from __future__ import annotations

import re
from collections.abc import Iterator

PART = 1 << 20
#: An ASCII byte that is neither letter nor digit: no run goes across it.
_BETWEEN = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def parts(data: bytes, size: int = PART) -> Iterator[bytes]:
    """``data`` in parts of about ``size`` bytes that end where no run goes on."""
    at = 0
    while len(data) - at > size:
        between = _BETWEEN.search(data, at + size)
        if not between:
            break
        yield data[at : between.start()]
        at = between.start()
    yield data[at:] if at else data


def runs(pattern: re.Pattern[bytes], text: str | None) -> Iterator[list[bytes]]:
    """Matches of ``pattern`` in the text, A-Z lower-cased and nothing else, as lists of a part each."""
    for part in parts((text or "").encode().lower()):
        yield pattern.findall(part)
