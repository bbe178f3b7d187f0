"""Splitting text where byte-level BPE tokens can never cross, so that short parts can be encoded once and kept."""

from __future__ import annotations

import re

_ADJACENT = re.compile(r"\s\s")
_LONE_SPACE = re.compile(r"(?<!\s) (?!\s)")
KEPT = 500_000  # parts that a worker keeps before it starts anew


def word_parts(text: str) -> list[str]:
    """Parts of text that tokenise alone; all but the first follow one space, which belongs to them.

    A space between two other characters always begins a token, so a cut there changes nothing. Spaces
    beside other white space are left inside their part.
    """
    return _LONE_SPACE.split(text) if _ADJACENT.search(text) else text.split(" ")
