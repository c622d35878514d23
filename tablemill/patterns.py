"""Date patterns of configurations written as Java date patterns."""

from __future__ import annotations

import re
from collections.abc import Mapping


def java_date_pattern(pattern: str, tokens: Mapping[str, str]) -> str:
    """``pattern`` with its tokens replaced and every other run of letters quoted; the longest token wins."""
    known = "|".join(re.escape(t) for t in sorted(tokens, key=len, reverse=True))
    parts = re.findall(rf"({known})|((?:(?!{known})[A-Za-z])+)|([^A-Za-z])", pattern)
    return "".join(tokens[token] if token else (f"'{word}'" if word else other) for token, word, other in parts)
