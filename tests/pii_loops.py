"""Personal data found by loops: what `pii.detected` is held against."""

from __future__ import annotations

import re

from lectern.functions.pii import ABN, MEDICARE, PATTERNS, PRECEDENCE, TFN8, TFN9


def _digit_sum(number: str, weights: tuple[int, ...]) -> int:
    return sum(int(d) * w for d, w in zip(number, weights, strict=False))


def _valid(kind: str, found: str) -> bool:
    n = re.sub(r"\D", "", found)
    if kind == "tfn":
        return len(set(n)) > 1 and len(n) in (8, 9) and _digit_sum(n, TFN9 if len(n) == 9 else TFN8) % 11 == 0
    if kind == "medicare":
        return len(n) in (10, 11) and n[0] in "23456" and _digit_sum(n, MEDICARE) % 10 == int(n[8])
    if kind == "abn":
        return len(n) == 11 and n[0] != "0" and (_digit_sum(n, ABN) - ABN[0]) % 89 == 0
    if kind == "credit_card":
        return len(n) >= 13 and sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(n)))) % 10 == 0
    return True


_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}


def spans(text: str | None, kinds: tuple[str, ...] = tuple(PATTERNS)) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, without overlap: of those that start first the longest, then by precedence."""
    if unknown := set(kinds) - set(PATTERNS):
        raise ValueError(f"unknown kinds {sorted(unknown)}; there are {', '.join(PATTERNS)}")
    found = [(m.start(), -m.end(), PRECEDENCE.index(k), k) for k in kinds for m in _COMPILED[k].finditer(text or "") if _valid(k, m[0])]
    kept: list[tuple[str, int, int]] = []
    for start, end, _, kind in sorted(found):
        if not kept or start >= kept[-1][2]:
            kept.append((kind, start, -end))
    return kept


def redact_text(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    if text is None:
        return None
    parts, at = [], 0
    for kind, start, end in found:
        parts += [text[at:start], f"[REDACTED:{kind}]"]
        at = end
    return "".join([*parts, text[at:]])
