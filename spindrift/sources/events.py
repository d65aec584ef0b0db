"""Server-sent events of one answer: written and read in the driver."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

_GAP = re.compile(r"\r?\n\r?\n")


def lines(events: Iterable[dict]) -> Iterator[str]:
    for e in events:
        yield f"data: {json.dumps(e, ensure_ascii=False)}\n\n"


def parse(pieces: Iterable[str]) -> Iterator[dict]:
    """Events from text that may be cut anywhere; the last, unfinished part waits, bad JSON is skipped."""
    held = ""
    for piece in pieces:
        *whole, held = _GAP.split(held + piece)
        for block in whole:
            data = "\n".join(line[5:].lstrip() for line in block.splitlines() if line.startswith("data:"))
            try:
                yield json.loads(data)
            except ValueError:
                continue
