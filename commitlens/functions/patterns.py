"""Patterns: exclude globs and group rules, translated once on the driver."""

from __future__ import annotations

import re

JAVA_META = re.compile(r"([\\^$.|?*+()\[\]{}])")
#: POSIX classes and what Java calls them.
POSIX = {n: f"\\p{{{n.capitalize()}}}" for n in ("alpha", "digit", "alnum", "upper", "lower", "punct", "space", "blank", "cntrl", "graph", "print")} | {"xdigit": "\\p{XDigit}", "word": "\\w"}


def quoted(text: str) -> str:
    return JAVA_META.sub(r"\\\1", text)


def glob_regex(glob: str) -> str | None:
    """An anchored pattern for a shell glob whose wildcards stay within a path's part; None if it is malformed."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if i == len(glob):
                return None
            out.append(quoted(glob[i]))
            i += 1
        elif c == "[":
            negated = glob[i : i + 1] == "^"
            i += negated
            items: list[str] = []

            def one() -> str | None:
                nonlocal i
                if i >= len(glob) or glob[i] in "-]":
                    return None
                i += glob[i] == "\\"
                if i >= len(glob):
                    return None
                i += 1
                return re.sub(r"([\\\]\[^&-])", r"\\\1", glob[i - 1])

            while True:
                if items and glob[i : i + 1] == "]":
                    i += 1
                    break
                low = one()
                if low is None:
                    return None
                if glob[i : i + 1] == "-":
                    i += 1
                    high = one()
                    if high is None:
                        return None
                    low = f"{low}-{high}" if low[-1] <= high[-1] else ""
                items.append(low)
            body = "".join(items)
            out.append(f"[^{body}]" if negated and body else "[\\s\\S]" if negated else f"[{body}]" if body else "(?!)")
            if negated:
                out[-1] = "(?!/)" + out[-1]
        else:
            out.append(quoted(c))
    return "^(?s:" + "".join(out) + r")\z"


def path_regex(patterns: list[str]) -> str | None:
    """One expression for the whole of a path that any exclude pattern matches: a directory at the root, or a glob on the path or its last part."""
    alternatives = []
    for prefix, glob in map(exclude_regexes, patterns):
        if prefix is not None:
            alternatives.append(quoted(prefix) + ".*")
        elif glob is not None:
            alternatives.append(f"(?:.*/(?=[^/]*\\z))?{glob[1:-2]}")
    return f"(?s:{'|'.join(alternatives)})" if alternatives else None


def exclude_regexes(pattern: str) -> tuple[str | None, str | None]:
    """A path prefix for patterns that end in a slash, else a glob's expression (None if malformed: it matches nothing)."""
    return (pattern, None) if pattern.endswith("/") else (None, glob_regex(pattern))


#: A rule's pattern, token by token: quoted text, escapes, POSIX and other classes, group openings, quantifiers, the rest.
TOKENS = re.compile(r"(?s)\\Q(?P<text>.*?)(?:\\E|\Z)|(?P<escape>\\[pP]\{\^?\w+\}|\\[pP]\w|\\x\{[0-9A-Fa-f]+\}|\\.)|(?P<open>\[\^?\]?)|(?P<group>\(\?(?:P?<\w+>|[a-zA-Z-]*:|[a-zA-Z-]*\)))|(?P<repeat>(?:[*+?]|\{\d+(?:,\d*)?\})\??)|(?P<other>.)")
IN_CLASS = re.compile(r"(?s)(?P<posix>\[:(?P<not>\^?)(?P<name>\w+):\])|(?P<escape>\\[pP]\{\^?\w+\}|\\[pP]\w|\\x\{[0-9A-Fa-f]+\}|\\.)|(?P<close>\])|(?P<other>.)")


def java_regex(pattern: str) -> str:
    """A group rule's own pattern for Java; look-around and back-references, which the rules' dialect lacks, are refused."""
    java, check, at, repeated = [], [], 0, True  # ``check`` is the like of it for Python, which tells whether it is well formed
    while at < len(pattern):
        m = TOKENS.match(pattern, at)
        at, kind = m.end(), m.lastgroup
        token = m[0]
        if kind == "text":
            java.append(quoted(m["text"]))
            check.append(re.escape(m["text"]))
        elif kind == "escape":
            if token[1] in "123456789kGRXhHvVNcCZ":
                raise ValueError(f"unsupported pattern: {pattern}")
            java.append(token)
            check.append("a" if token[1] in "pPx" else r"\Z" if token == r"\z" else token if token[1] in "AbBdDsSwWafnrtv" or not token[1].isalnum() else "\\" + token)
        elif kind == "open":
            body = token[0] + ("^" if "^" in token else "") + (r"\]" if "]" in token else "")
            like = body
            while True:
                c = IN_CLASS.match(pattern, at)
                if c is None:
                    raise ValueError(f"bad pattern {pattern}: a class has no end")
                at = c.end()
                if c["close"]:
                    break
                if c["posix"]:
                    if c["name"] not in POSIX:
                        raise ValueError(f"bad pattern {pattern}: no class {c['name']}")
                    name = POSIX[c["name"]]
                    body += ("\\P" + name[2:] if name.startswith("\\p") else name.upper()) if c["not"] else name
                    like += "a"
                else:
                    body += "\\" + c[0] if c[0] in "[&~" else c[0]
                    like += "a" if c[0][:2] in (r"\p", r"\P", r"\x") else "\\" + c[0] if c[0] in "[&~|" else c[0]
            java.append(body + "]")
            check.append(like + "]")
        elif kind == "group":
            if "U" in token.split("<")[0]:
                raise ValueError(f"unsupported pattern: {pattern}")
            java.append(token.replace("?P<", "?<"))
            check.append("(?P<" + token.split("<")[1] if "<" in token else "(?:" if token.endswith(":") else "")
        else:
            if kind == "repeat" and repeated or token == "(" and pattern[at : at + 1] == "?":
                raise ValueError(f"unsupported pattern: {pattern}")
            java.append(token)
            check.append(token)
        repeated = kind == "repeat" or kind == "other" and token in "(|"
    try:
        re.compile("".join(check))
    except re.error as e:
        raise ValueError(f"bad pattern {pattern}: {e}") from e
    return "".join(java)
