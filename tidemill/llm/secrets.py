"""Secret scan: patterns, and sliding-window Shannon entropy over candidate strings.

Works on code points; texts are read whole, one row at a time, inside vectorised column functions.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The base patterns, with the letters of the key words in either case and in ASCII only.
_WORDS = "password|passwd|secret|token|api_?key"
_EITHER = re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", _WORDS)
ASSIGN = re.compile(rf"({_EITHER})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")  # The leftmost match of the unbounded pattern is the whole run, so the length can be asked for at once.
KINDS = ("assign", "access", "hex", "entropy")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
# Character classes of candidate strings, in the order tried: name, alphabet, window, least bits per character. The least is
# that of all but some 2 in 100 windows of random characters of the alphabet (16, 32, 36, 36 and 62 or 64 characters).
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    ("hex", frozenset("0123456789abcdefABCDEF"), 20, 2.94),
    ("base32", frozenset(_UPPER + "234567"), 20, 3.38),
    ("lower36", frozenset(_LOWER + _DIGITS), 20, 3.44),
    ("upper36", frozenset(_UPPER + _DIGITS), 20, 3.44),
    ("base64", frozenset(_UPPER + _LOWER + _DIGITS + "+/_=-"), 20, 3.68),
)
_CANDIDATE = re.compile("[A-Za-z0-9+/_=-]{20,}")
_PART = re.compile("[^+/_=-]+")
_WORD = "(?:[A-Z]*[a-z]+(?:[A-Z]+[a-z]{2,}|A[nst]|B[ey]|I[dfnst]|O[fnr]|To|Up)*[A-Z]*|[A-Z]+)"  # In the case of words: mixed only as in camelCase.
# Allow-list: strings that look random but are not secrets.
ALLOWED = (
    re.compile("(?i)example|sample|placeholder|changeme|redacted|dummy|your[_-]"),
    re.compile("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile("(?i)(?:0123456789|abcdefghij|zyxwvutsrq|9876543210)"),
    re.compile("[0-9]+([-/_][0-9]+)*"),
    re.compile(f"{_WORD}[0-9]{{0,4}}([-/_=+]+({_WORD})?[0-9]{{0,4}})*"),
)
_WHOLE = (False, True, False, True, True)


def _log_terms(window: int) -> list[float]:
    return [0.0, *[c * math.log2(c) for c in range(1, window + 1)]]


def high_entropy(text: str, window: int, least: float) -> list[tuple[int, int]]:
    """The joined ranges of all windows whose characters carry ``least`` bits each, or more.

    Counts and their sum of c log c are carried from window to window, so a step costs the same for any window.
    """
    if len(text) < window:
        return []
    terms, counts, total = _log_terms(window), {}, 0.0
    spans: list[tuple[int, int]] = []
    for i, char in enumerate(text):
        had = counts.get(char, 0)
        counts[char] = had + 1
        if i >= window:
            gone = text[i - window]
            if gone == char:
                counts[char] = had
            else:
                total += terms[had + 1] - terms[had]
                left = counts[gone]
                counts[gone] = left - 1
                total += terms[left - 1] - terms[left]
        else:
            total += terms[had + 1] - terms[had]
        if i >= window - 1 and math.log2(window) - total / window >= least - 1e-9:
            start, end = i - window + 1, i + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((start, end))
    return spans


def _left(candidate: str) -> list[tuple[int, int]]:
    """What the allow-list leaves of a candidate: some patterns suppress all of it, others the parts that hold them."""
    whole = [p for p, w in zip(ALLOWED, _WHOLE) if w]
    if any(p.fullmatch(candidate) for p in whole):
        return []
    hits = sorted(m.span() for p, w in zip(ALLOWED, _WHOLE) if not w for m in p.finditer(candidate))
    if not hits:
        return [(0, len(candidate))]
    cut, at, reached = [], 0, 0
    for part in _PART.finditer(candidate):
        while at < len(hits) and hits[at][0] < part.end():
            reached, at = max(reached, hits[at][1]), at + 1
        if reached > part.start():
            cut.append(part.span())
    edges = zip([0, *[y for _, y in cut]], [*[x for x, _ in cut], len(candidate)])
    least = min(window for _, _, window, _ in CLASSES)
    return [(x, y) for x, y in edges if y - x >= least and not any(p.fullmatch(candidate[x:y].strip("+/_=-")) for p in whole)]


def allowed(candidate: str) -> bool:
    """Whether the allow-list suppresses all of a candidate."""
    return not _left(candidate)


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Ranges of high entropy inside the candidate strings of a text."""
    found = []
    for match in _CANDIDATE.finditer(text):
        for start, end in _left(match[0]):
            piece = match[0][start:end]
            letters = set(piece)
            for _, alphabet, window, least in CLASSES:
                if letters <= alphabet:
                    found += [(match.start() + start + a, match.start() + start + b) for a, b in high_entropy(piece, window, least)]
                    break
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Matches of the base patterns by kind: leftmost, without overlap, those too short dropped afterwards."""
    plain = text.lower()
    assign = ([m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
              if any(w in plain for w in ("pass", "secret", "token", "api")) else [])
    access = [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS] if "AKIA" in text else []
    return {"assign": assign, "access": access, "hex": [m.span() for m in HEX.finditer(text)]}


def _joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    rows = sorted((a, KINDS.index(kind), b) for kind, found in spans.items() for a, b in found)
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in rows)


def scan(text: str) -> tuple[int, int, int, str, str, int]:
    """Base counts, hash of the base spans, all spans, and the number of spans that only entropy finds."""
    base = base_spans(text)
    # An entropy span inside one base match adds nothing; one that reaches beyond stays whole.
    covers, added, at, reached = sorted(s for found in base.values() for s in found), [], 0, 0
    for a, b in entropy_spans(text):
        while at < len(covers) and covers[at][0] <= a:
            reached, at = max(reached, covers[at][1]), at + 1
        if b > reached:
            added.append((a, b))
    digest = hashlib.sha256(_joined(base).encode()).hexdigest()
    return (*[len(base[k]) for k in KINDS[:3]], digest, _joined(base | {"entropy": added}), len(added))


def secrets(text: Column) -> Column:
    """A struct of counts, ``base_sha256`` and ``spans`` for a text.

    Spans are kind:start:end in code points, end exclusive, by start and then kind, joined by commas; without
    any, the string is empty. Null and empty texts have none. Time and memory grow in proportion to a text's length, some
    ten bytes a code point: sorted lists of spans are walked once.
    """
    def find(texts: pa.Array) -> pa.Array:
        rows = [scan(t or "") for t in texts.to_pylist()]
        names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"]
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return F.arrow_udf(find, "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base_sha256:string,spans:string,n_entropy:bigint>")(text)
