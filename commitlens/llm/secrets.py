"""Secrets: fixed patterns, and windows of high Shannon entropy in candidate strings.

A candidate is a run of 20 or more characters of secrets' alphabets. A window of
20 characters slides over it; counts per character class (digits, lower case,
upper case, signs) and per character are kept incrementally, so each step costs
the same. Where the entropy of the window, and of the classes within it, reaches
the thresholds of its mix of classes, the windows' union (grown to the candidate
if it covers most of it) is a span of kind ``entropy``. A candidate that base spans
cut is looked at piece by piece. Candidates of the allow-list (parts of mail addresses, identifiers in the form
of a UUID, paths and dashed or dotted words, hosts) are suppressed, and windows with
placeholders or ordered alphabets; base spans never are.

Edge cases: of spans that begin at one place the kinds have their order; a null text is empty; texts without spans have an empty list and the
digest of the empty string; rows that repeat count each on its own; ids may be
null; an empty table gives no rows. Columns other than ``doc_id`` and ``text`` are
ignored. Each pattern and the window are linear in the text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from commitlens.llm.common import per_batch, sha256_hex, span_text

BASE_KINDS = ("assign", "access", "hex")
ORDER = {k: i for i, k in enumerate((*BASE_KINDS, "entropy"))}


def either_case(word: str) -> str:
    """ASCII letters of ``word`` in either case; a flag would let other letters match too."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORD = "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + either_case("api") + "_?" + either_case("key")
ASSIGN = re.compile(f"(?:{KEYWORD})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")

WINDOW = 20
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{20,}")
#: Least entropy (bits) of a window by the classes it mixes: digits and one case; both cases; all three and signs.
LEAST = {2: 3.3, 3: 3.6, 4: 3.6}
#: Least entropy of the classes' shares: a lone digit in a word is no mix.
LEAST_MIX = 0.7
ALLOWED = re.compile(
    r"""(?ix) ^(?:
      [0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}      # identifiers
    | [a-z]+(?:[-_./=+][a-z]+)*                        # words, paths, file names
    | (?:[a-z0-9-]+\.)+[a-z]{2,}(?:/[a-z0-9._/=-]*)?   # hosts
    | [0-9+/_=.-]+                                     # numbers and rules
    )$"""
)
PLACEHOLDER = re.compile("(?i)example|sample|placeholder|changeme|xxxx|abcdefgh|01234567|12345678")
#: What stands before a password in a url: there an ``@`` after it is no mail address's.
CREDENTIAL = re.compile(r"://[^\s/@:]*:")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def char_class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


#: n log2 n for the counts of a window.
N_LOG_N = [0.0, *(n * math.log2(n) for n in range(1, WINDOW + 1))]


def hot_windows(s: str) -> Iterator[tuple[int, int]]:
    """Merged bounds of the windows of ``s`` whose entropies reach the thresholds, by incremental counts."""
    chars: dict[str, int] = {}
    classes = [0, 0, 0, 0]
    by_char = by_class = 0.0  # sums of n log2 n
    start = end = -1

    def change(c: str, by: int) -> None:
        nonlocal by_char, by_class
        n, k = chars.get(c, 0), char_class(c)
        by_char += N_LOG_N[n + by] - N_LOG_N[n]
        chars[c] = n + by
        by_class += N_LOG_N[classes[k] + by] - N_LOG_N[classes[k]]
        classes[k] += by

    whole = math.log2(WINDOW)
    for i, c in enumerate(s):
        if i >= WINDOW:
            change(s[i - WINDOW], -1)
        change(c, 1)
        if i < WINDOW - 1:
            continue
        mixed = sum(n > 0 for n in classes)
        if classes[0] and mixed > 1 and whole - by_class / WINDOW >= LEAST_MIX and whole - by_char / WINDOW >= LEAST[mixed]:
            a = i - WINDOW + 1
            if a > end:
                if end > 0:
                    yield start, end
                start = a
            end = i + 1
    if end > 0:
        yield start, end


def outside(a: int, b: int, known: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of a to b that none of ``known`` (sorted bounds) covers."""
    for start, end in known:
        if start > a:
            yield a, min(start, b)
        a = max(a, end)
        if a >= b:
            return
    yield a, b


def entropy_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    found, known, at = [], sorted((a, b) for _, a, b in base), 0
    passwords = {m.end() for m in CREDENTIAL.finditer(text)}
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while at < len(known) and known[at][1] <= a:
            at += 1
        last = at
        while last < len(known) and known[last][0] < b:
            last += 1
        if (text[b : b + 1] == "@" and a not in passwords) or text[a - 1 : a] == "@" or ALLOWED.match(m.group()):
            continue
        for start, end in outside(a, b, known[at:last]):
            for s, e in hot_windows(text[start:end]) if end - start >= WINDOW else ():
                if not PLACEHOLDER.search(text, start + s, start + e):
                    found.append(("entropy", start, end) if e - s >= 0.5 * (end - start) else ("entropy", start + s, start + e))
    return list(dict.fromkeys(found))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, base and all spans as texts (``span_text``), bounds in code points."""

    def one(doc_id: int | None, text: str | None) -> tuple:
        base = base_spans(text or "")
        every = base + entropy_spans(text or "", base)
        digest = sha256_hex(span_text(base, ORDER))
        return (doc_id, *(sum(k == kind for k, _, _ in base) for kind in BASE_KINDS), len(every) - len(base), digest, span_text(every, ORDER))

    def make() -> Callable:
        return lambda columns: map(one, *columns)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"
    return per_batch(docs.select("doc_id", "text"), make, schema)
