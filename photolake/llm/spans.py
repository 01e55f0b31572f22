"""Spans in texts: the fixed patterns of secrets and personal data, and the digests made of them.

A span is (start, order of its kind, end), in code points, end exclusive. Matches are leftmost and non-overlapping within
a kind; a match that fails its kind's test is dropped and not tried again.
"""

from __future__ import annotations

import hashlib
import re

Span = tuple[int, int, int]

# The patterns of the contracts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so the length can stand in the pattern
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")

SECRET_KINDS = ("assign", "access", "hex", "token")
PRIVATE_KINDS = ("email", "ip", "card", "phone", "name", "address", "id")

KEYWORDS = ("passw", "secret", "token", "api")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def secret_spans(text: str) -> list[tuple[Span, str]]:
    """The base secrets of a text with the credential in each."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [((m.start(), 0, m.end()), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [((m.start(), 1, m.end()), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [((m.start(), 2, m.end()), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def private_spans(text: str) -> list[Span]:
    """The base personal data of a text."""
    out, end = [], 0
    for m in DOMAIN.finditer(text):
        # the local part is all that fits before the sign, back to the last match
        start = m.start()
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < m.start():
            end = m.end()
            out.append((start, 0, end))
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


def outside(spans: list, base: list[Span]) -> list:
    """What is returned of (start, end, what), in order of start, for those that overlap none of ``base``; one pass over both."""
    out, at, end = [], 0, 0
    base = sorted(base)
    for a, b, x in spans:
        while at < len(base) and base[at][0] < b:
            end = max(end, base[at][2])
            at += 1
        # base spans that start before b have been seen; one of them overlaps if it ends after a
        if end <= a:
            out.append(x)
    return out


def digest(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()
