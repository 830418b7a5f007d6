"""Personal data by a skip-chain conditional random field.

Base spans come from fixed patterns. The field then labels the tokens that hold
a digit or an ``@`` (all others are fixed to "none": they bear no evidence):
neighbouring tokens share a chain potential, and tokens of a document that are
the same but for punctuation, however distant, share a skip potential; so do a known
number and tokens, or runs of them, whose digits are the number's or its last seven and more. Tokens in
a base span are fixed to its kind, so that the fields' messages carry it to the
bare repeats elsewhere in the document ("555-6503" after "+1 (499) 555-6503").
Sum-product messages are passed a fixed number of rounds over the graphs of some
texts at once (``GRAPH_TOKENS`` or one text); tokens that end up surely of a kind add spans.
Messages are five numbers a link and direction, and the potentials are not spelled out, so
memory is in proportion to the text.

The weights are fitted here, by pseudo-likelihood, on sentences that a seeded
generator makes: no labelled tokens exist in the corpus.

Edge cases: a null text is empty; texts without spans have an empty list and the
digest of the empty string; rows that repeat are labelled each on its own; ids may
be null; an empty table gives no rows. Columns other than ``doc_id`` and ``text``
are ignored (``redact`` keeps them). Texts and tokens of any length are read whole; all patterns are linear in the text.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import per_batch, per_text, sha256_hex, span_text

KINDS = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate(KINDS)}
LABELS = ("none", *KINDS)

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
#: Tokens stand between blanks and these.
APART = r":,;=\"'|<>{}\[\]"
TOKEN = re.compile(rf"(?<![^\s{APART}])[^\s{APART}0-9@]*+[0-9@][^\s{APART}]*")
#: What may stand between the digits of one number, and so many digits of a number's end make it known.
BLANK, PARTED = re.compile(r"\s"), re.compile(rf"[{APART}]")
INSIDE, LEAST, MOST = re.compile(r"[ ().+-]{1,3}"), 7, 19


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each ``@``, the run of local characters before it and the domain after: what a leftmost search finds."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = max(at + 1, done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in emails(text)]
    if not DIGITS.search(text):
        return found
    for m in IP.finditer(text):
        if all(int(p[-4:]) <= 255 and (len(p) < 4 or not p[:-3].strip("0")) for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(len, DIGITS.findall(m.group()))) <= 15:
                found.append(("phone", *m.span()))
    return found


# ---- the field: tokens, their evidence and their links

STRIP = "\"'`.,;:!?*#$%&|<>[]{}=~^_"
CUES = {"email": 1, "mail": 1, "contact": 1, "ip": 2, "host": 2, "server": 2, "address": 2, "card": 3, "visa": 3, "pay": 3, "phone": 4, "call": 4, "tel": 4, "fax": 4, "mobile": 4}
FEATURES = 20
CUE = re.compile(r"[a-z]+")
#: Graphs of so many tokens together (or one larger) pass their messages at once.
GRAPH_TOKENS = 1 << 14


def tokens(text: str) -> list[tuple[int, int]]:
    """Bounds, without outer punctuation, of the tokens that hold a digit or an ``@``."""
    found = []
    for m in TOKEN.finditer(text) if DIGITS.search(text) or "@" in text else ():
        word = m.group()
        start = m.start() + len(word) - len(word.lstrip(STRIP))
        end = m.end() - (len(word) - len(word.rstrip(STRIP)))
        if start < end:
            found.append((start, end))
    return found


def cues(text: str, found: list[tuple[int, int]]) -> Iterator[int]:
    """Of each token the kind that the last word before it announces, or 0; each part of the text is read once or twice."""
    kind, since = 0, 0
    for start, _ in found:
        near = max(since, start - 24)
        words = CUE.findall(text[near:start].lower())
        if near > since and (not words or (len(words) == 1 and text[near].isalpha())):  # none, or one that may be cut
            words = CUE.findall(text[since:start].lower())
        kind, since = CUES.get(words[-1], 0) if words else kind, start
        yield kind


def evidence(text: str, start: int, end: int, cue: int) -> bytes:
    """FEATURES bytes of 0 and 1."""
    word = text[start:end]
    digits = sum("0" <= c <= "9" for c in word)
    letters = sum(c.isalpha() for c in word)
    quads = word.count(".") == 3 and all(p.isdigit() and len(p) <= 3 for p in word.split("."))
    local, at, domain = word.partition("@")
    row = [True, bool(local and at and domain), "." in domain, quads, word.startswith("+"), "(" in word or ")" in word, "-" in word]
    row += [digits <= 2, 3 <= digits <= 6, 7 <= digits <= 11, 12 <= digits <= 19, digits > 19, letters == 0, 0 < letters <= digits, letters > digits, "=" in word or "/" in word]
    return bytes([*row, *(cue == k for k in range(1, 5))])


def skip_key(word: str) -> str:
    """Similar tokens have equal keys: addresses but for case, numbers of seven digits and more but for punctuation."""
    if "@" in word:
        return word.lower()
    digits = "".join(DIGITS.findall(word))
    return digits if len(digits) >= 7 and not any(c.isalpha() for c in word) else ""


def known_ends(text: str, known: list[tuple[str, int, int]]) -> dict[int, list[str]]:
    """By the start of a known card or phone number: its digits and their ends."""
    out = {}
    for kind, a, b in known:
        if kind in ("card", "phone"):
            digits = "".join(DIGITS.findall(text[a:b]))
            out[a] = [digits[-n:] for n in range(LEAST, len(digits) + 1)]
    return out


def held(found: list[tuple[int, int]], known: list[tuple[str, int, int]]) -> tuple[list[int], dict[int, list[int]]]:
    """Of each token its fixed label (0 where free), and by token the starts of the known spans that begin with it."""
    fixed, starts, at, done = [0] * len(found), {}, 0, -1
    for i, (a, b) in enumerate(found):
        while at < len(known) and known[at][2] <= a:
            at += 1
        n = at
        while n < len(known) and known[n][1] < b:
            kind, s, e = known[n]
            if e > a:
                fixed[i] = fixed[i] or 1 + ORDER[kind]
                if s > done:
                    done = s
                    starts.setdefault(i, []).append(s)
            n += 1
    return fixed, starts


def with_runs(text: str, found: list[tuple[int, int]], fixed: list[int], ends: set[str], whole_ends: set[str]) -> tuple[list[tuple[int, int]], list[str]]:
    """The tokens and their keys, with runs of free ones that are together one of ``ends``: from the last on, the longest.

    A run of ``whole_ends`` (phones) becomes one token; the others' (cards, known in groups) have the run's key each.
    """
    digits = ["" if fixed[i] or any(c.isalpha() or c == "@" for c in text[a:b]) else "".join(DIGITS.findall(text[a:b])) for i, (a, b) in enumerate(found)]
    out, keys, i = [], [], len(found) - 1
    while i >= 0:
        whole, j, best, key = digits[i], i, i, skip_key(text[slice(*found[i])])
        while digits[j] and len(whole) <= MOST:
            if whole in ends:
                best, key = j, whole
            if not j or not INSIDE.fullmatch(text, found[j - 1][1], found[j][0]):
                break
            j -= 1
            whole = digits[j] + whole
        run = [(found[best][0], found[i][1])] if key in whole_ends else found[best : i + 1][::-1]
        out += run
        keys += [key] * len(run)
        i = best - 1
    return out[::-1], keys[::-1]


def graph(text: str, known: list[tuple[str, int, int]]) -> tuple[list, bytes, list, list, list]:
    """Tokens, evidence, fixed labels (0 where free), chain links and skip links of one text."""
    found, known = tokens(text), sorted(known, key=lambda s: s[1:])
    fixed, starts = held(found, known)
    ends, keys = known_ends(text, known), [skip_key(text[a:b]) for a, b in found]
    if ends:
        every, phones = ({e for k, a, _ in known if k in kinds for e in ends[a]} for kinds in (("card", "phone"), ("phone",)))
        found, keys = with_runs(text, found, fixed, every, phones)
        fixed, starts = held(found, known)
    rows = b"".join(evidence(text, a, b, cue) for (a, b), cue in zip(found, cues(text, found), strict=True))
    # pieces of one word are apart
    chain = [(i, i + 1) for i in range(len(found) - 1) if found[i + 1][0] - found[i][1] <= 3 and BLANK.search(text, found[i][1], found[i + 1][0])]
    gives = {i: [*([key] if key and fixed[i] else []), *(e for s in starts.get(i, ()) for e in ends.get(s, ()))] for i, key in enumerate(keys) if fixed[i]}
    order = [i for i in range(len(found)) if keys[i] or gives.get(i)]
    last: dict[str, int] = {}
    links = set()  # to the one before, and to the nearest known ones on both sides: linear in the repeats
    for i in order:
        if keys[i]:
            if keys[i] in last:
                links.add((last[keys[i]], i))
            last[keys[i]] = i
    for way in (order, order[::-1]):
        sure: dict[str, int] = {}
        for i in way:
            if keys[i] in sure:
                links.add((min(i, sure[keys[i]]), max(i, sure[keys[i]])))
            sure |= dict.fromkeys(gives.get(i, ()), i)
    return found, rows, fixed, chain, sorted(links, key=lambda x: x[::-1])


def made_sentences(seed: int, n: int) -> Iterator[list[tuple[str, str]]]:
    """Token lists with their kinds: base forms, their bare repeats, and numbers that aren't personal."""
    r = random.Random(seed)
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def one(kind: str) -> tuple[list, list]:
        if kind == "email":
            name = f"{r.choice(['ann', 'bo', 'info', number(2)])}@{r.choice(['mail', 'host'])}{number(1)}.example"
            return [(name + ".com", kind)], [(name + ".com", kind)]
        if kind == "ip":
            address = [(".".join(str(r.randrange(256)) for _ in range(4)), kind)]
            return address, address
        if kind == "card":
            parts = [number(4) for _ in range(4)]
            whole = "".join(parts)
            return [(w, kind) for w in r.choice([parts, [whole], [whole]])], [(r.choice([whole, "-".join(parts)]), kind)]
        a, b, c = number(3), number(3), number(4)
        return [(f"+{number(1)}", kind), (f"({a})", kind), (f"{b}-{c}", kind)], [(form, kind) for form in r.sample([f"{b}-{c}", f"{b}{c}", f"{b}.{c}"], r.randrange(1, 4))]

    for _ in range(n):
        kind = r.choice(KINDS)
        full, bare = one(kind)
        if r.random() < 0.3:
            full = full + one(r.choice(["card", "phone"]))[0]
        cue = r.choice([w for w, k in CUES.items() if k == 1 + ORDER[kind]]) if r.random() < 0.3 else "re"
        other = [(r.choice([number(r.randrange(1, 5)), f"{number(1)}.{number(1)}", f"v{number(1)}.{number(1)}.{number(1)}", f"A{number(2)}B{number(3)}", f"x={number(5)}ab", f"id{number(8)}", number(8), f"{number(4)}-{number(2)}-{number(2)}"]), "none") for _ in range(r.randrange(1, 5))]
        words = [(cue, ""), *full, ("and", ""), *sum(([o, ("the", "")] for o in other), [])]
        for repeat in bare * r.randrange(3):
            words += [("or", ""), repeat, ("then", "")]
        yield words


@lru_cache(maxsize=1)
def fitted(seed: int = 7, n: int = 1500, rounds: int = 400) -> tuple:
    """Unary, chain and skip weights, by gradient ascent on the pseudo-likelihood of made sentences."""
    import numpy as np

    xs, ys, chains, skips, at = [], [], [], [], 0
    for words in made_sentences(seed, n):
        text, marks = "", {}
        for w, k in words:
            marks[len(text)] = k
            text += w + " "
        found, rows, _, chain, skip = graph(text, [])
        xs.append(rows)
        ys += [LABELS.index(next((marks[s] for s in range(a, max(-1, a - 2), -1) if s in marks), "none") or "none") for a, _ in found]
        chains += [(i + at, j + at) for i, j in chain]
        skips += [(i + at, j + at) for i, j in skip]
        at += len(found)
    x, y, k = np.frombuffer(b"".join(xs), np.uint8).reshape(-1, FEATURES).astype(float), np.array(ys), len(LABELS)
    chain, skip = np.array(chains).reshape(-1, 2), np.array(skips).reshape(-1, 2)
    hot = np.eye(k)[y]
    after, before, same = np.zeros((len(y), k)), np.zeros((len(y), k)), np.zeros((len(y), k))
    np.add.at(after, chain[:, 0], hot[chain[:, 1]])
    np.add.at(before, chain[:, 1], hot[chain[:, 0]])
    np.add.at(same, skip[:, 0], hot[skip[:, 1]])
    np.add.at(same, skip[:, 1], hot[skip[:, 0]])
    # each token counts twice, with its neighbours' labels and without: unary weights then stand alone where no label is known
    x, y, hot = np.concatenate([x, x]), np.concatenate([y, y]), np.concatenate([hot, hot])
    after, before, same = (np.concatenate([v, np.zeros_like(v)]) for v in (after, before, same))
    w, c, s = np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros(1)
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in (w, c, s)]
    for step in range(1, rounds + 1):
        score = x @ w + before @ c + after @ c.T + s * same
        p = np.exp(score - score.max(1, keepdims=True))
        off = (hot - p / p.sum(1, keepdims=True)) / len(y)
        slopes = (x.T @ off - 1e-5 * w, before.T @ off + off.T @ after - 1e-5 * c, (same * off).sum() - 1e-5 * s)
        for v, (m1, m2), g in zip((w, c, s), moments, slopes, strict=True):  # Adam
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            v += 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    return w, c, float(s[0])


def beliefs(x, fixed, chain, skip, weights: tuple, rounds: int = 6):  # noqa: ANN001, ANN201
    """Marginals after a fixed number of rounds of loopy sum-product messages over all links at once.

    ``x`` has a row of features per token, ``fixed`` its label or 0, ``chain`` and ``skip`` pairs of tokens.
    """
    import numpy as np

    w, c, s = weights
    unary = np.concatenate([x[at : at + GRAPH_TOKENS] @ w for at in range(0, len(x), GRAPH_TOKENS)])
    held = fixed > 0
    unary[held] = -1e9  # more than the messages of any number of repeats
    unary[held, fixed[held]] = 0.0
    # messages go along chain links, along skip links, against chain links, against skip links
    links = [(chain[:, 0], chain[:, 1]), (skip[:, 0], skip[:, 1]), (chain[:, 1], chain[:, 0]), (skip[:, 1], skip[:, 0])]
    message = [np.zeros((len(source), len(LABELS))) for source, _ in links]
    along, same = np.exp(c), np.expm1(s)

    def gathered():  # noqa: ANN202
        total = unary.copy()
        for (_, target), m in zip(links, message, strict=True):
            for label in range(len(LABELS)):
                total[:, label] += np.bincount(target, m[:, label], len(total))
        return total

    for _ in range(rounds if len(chain) + len(skip) else 0):
        total, new = gathered(), []
        for n, (source, _) in enumerate(links):
            out = total[source] - message[(n + 2) % 4]
            p = np.exp(out - out.max(1, keepdims=True))
            # a skip potential is exp(s) for equal labels and 1 for others
            sent = np.log(p @ (along if n == 0 else along.T) if n % 2 == 0 else p.sum(1, keepdims=True) + same * p)
            new.append(sent - sent.max(1, keepdims=True))
        message = [0.5 * m + 0.5 * sent for m, sent in zip(message, new, strict=True)]
    total = gathered()
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def labelled(graphs: list[tuple], weights: tuple):  # noqa: ANN201
    """Of the graphs' tokens, one after another, the likeliest label and how likely it is."""
    import numpy as np

    sizes = [len(found) for found, *_ in graphs]
    first = np.cumsum([0, *sizes])
    pairs = [np.concatenate([np.array(g[n], np.int64).reshape(-1, 2) + at for g, at in zip(graphs, first, strict=False)]) for n in (3, 4)]
    x = np.frombuffer(b"".join(g[1] for g in graphs), np.uint8).reshape(-1, FEATURES)
    p = beliefs(x, np.array([f for g in graphs for f in g[2]]), *pairs, weights)
    return zip(*(np.split(v, first[1:-1]) for v in (p.argmax(1), p.max(1))), strict=True)


def all_spans(texts: list[str], weights: tuple, sure: float = 0.9) -> list[tuple[list, list]]:
    """For each text its base spans and those that the field adds."""
    out: list[tuple[list, list]] = []
    group: list[tuple] = []
    places: list[int] = []

    def settle() -> None:
        for at, (found, _, fixed, chain, _), (label, likely) in zip(places, group, labelled(group, weights), strict=True):
            out[at][1].extend(added_spans(texts[at], found, fixed, chain, label.tolist(), (likely >= sure).tolist()))
        group.clear()
        places.clear()

    for text in texts:
        out.append((base_spans(text), []))
        made = graph(text, out[-1][0])
        if made[0]:
            group.append(made)
            places.append(len(out) - 1)
        if sum(len(g[0]) for g in group) >= GRAPH_TOKENS:
            settle()
    if group:
        settle()
    return out


def added_spans(text: str, found: list, fixed: list, chain: list, label: list, certain: list) -> list[tuple[str, int, int]]:
    """Spans of the free tokens that are surely of a kind; neighbours of one kind with blanks between are one span."""
    joined = {i for i, j in chain if not PARTED.search(text, found[i][1], found[j][0])}
    added: list[tuple[str, int, int]] = []
    previous = -1
    for i, (a, b) in enumerate(found):
        if fixed[i] or not label[i] or not certain[i]:
            previous = -1
            continue
        kind = LABELS[label[i]]
        if previous == i - 1 and previous in joined and added and added[-1][0] == kind:
            added[-1] = (kind, added[-1][1], b)
        else:
            added.append((kind, a, b))
        previous = i
    return added


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and added: the spans' kinds and bounds in code points, as texts (``span_text``), and base counts."""
    weights = fitted()

    def make() -> Callable:
        def rows(columns: list[list]) -> Iterator[tuple]:
            ids, texts = columns
            for doc_id, (base, added) in zip(ids, all_spans([t or "" for t in texts], weights), strict=True):
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                yield (doc_id, *counts, span_text(base, ORDER), span_text(added, ORDER), span_text(base + added, ORDER), sha256_hex(span_text(base, ORDER)))

        return rows

    schema = "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_spans string, added_spans string, spans string, base_sha256 string"
    return per_batch(docs.select("doc_id", "text"), make, schema)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span, or run of overlapping ones, replaced by its first kind's name."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], ORDER[s[0]])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans in ``text`` replaced; a null text stays null, ``n_chars`` (if present) follows the text."""
    weights = fitted()

    def make() -> Callable:
        def texts(old: list[str | None]) -> list[str | None]:
            found = all_spans([t or "" for t in old], weights)
            return [t if t is None else redacted(t, base + added) for t, (base, added) in zip(old, found, strict=True)]

        return texts

    out = per_text(docs, make)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
