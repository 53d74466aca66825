"""How a text is folded. A Python worker loads this module alone, so it needs neither Spark nor pandas."""

from __future__ import annotations

import unicodedata


def folded_text(v: str | None) -> str | None:
    """NFKC, casefold, white space collapsed and trimmed; null stays null."""
    return None if v is None else " ".join(unicodedata.normalize("NFKC", v).casefold().split())
