"""Cutting text into pieces that SentencePiece merges never cross.

No piece of the models in use has a marker after another character, and none contains a line feed. So a text splits
exactly before each run of markers (spaces) and before each run of line feeds, and the ids of the text are the ids of
the parts put together. ``safe_model`` checks both facts from the model's own vocabulary.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

MARK = "▁"
_PART = re.compile(" +[^ \n]*|\n+[^ \n]*")


def split(text: str) -> list[str]:
    """Parts of a text with its dummy prefix; each starts with spaces or with line feeds. Empty text has none."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    return _PART.findall(" " + text)


def safe_model(pieces: Iterable[str]) -> bool:
    """True if no piece crosses the borders that ``split`` cuts at."""
    return all("\n" not in p and not re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
