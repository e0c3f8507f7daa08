"""Check patterns follow RE2; Spark's `rlike` is Java. This closes the gap.

RE2 and Java agree on most syntax. Where Java would accept more, the pattern is
refused, as the warehouse would; where the same text means something else, it is
rewritten.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"\\Q.*?(?:\\E|\Z)"  # quoted run
    r"|\\."  # escape
    r"|\[\^?\]?(?:\[:\^?\w+:\]|\\.|[^\]\\])*\]"  # character class
    r"|\(\?P<|\(\?[a-zA-Z-]+[:)]|\(\?<?[=!]|\(\?>"  # group openers
    r"|[*+?}]\+"  # possessive quantifier
    r"|.",
    re.DOTALL,
)
_POSIX = re.compile(r"\[:(\^?)(\w+):\]")
_JAVA_ONLY_ESCAPES = set("123456789kGZRXhHuNec")
_REPEAT = re.compile(r"\{(\d+)(?:,(\d*))?\}")
MOST_REPEATS = 1000  # fixed value: larger counts are refused
# Escapes that mean more in Java: `\s` also takes the vertical tab, `\v` any line end.
_NARROWED = {r"\s": r"[\t\n\f\r ]", r"\S": r"[^\t\n\f\r ]", r"\v": r"\x0B"}
_NARROWED_INSIDE = {r"\s": r"\t\n\f\r ", r"\v": r"\x0B"}

# POSIX class names and their Java spelling.
_POSIX_CLASSES = {
    "alnum": "Alnum",
    "alpha": "Alpha",
    "ascii": "ASCII",
    "blank": "Blank",
    "cntrl": "Cntrl",
    "digit": "Digit",
    "graph": "Graph",
    "lower": "Lower",
    "print": "Print",
    "punct": "Punct",
    "space": "Space",
    "upper": "Upper",
    "xdigit": "XDigit",
}


def _posix(match: re.Match) -> str:
    negated, name = match.groups()
    if name == "word":
        return r"\W" if negated else r"\w"
    if name not in _POSIX_CLASSES:
        raise ValueError(f"unknown character class [:{name}:]")
    return rf"\{'P' if negated else 'p'}{{{_POSIX_CLASSES[name]}}}"


def _character_class(token: str) -> str:
    """Java reads `[` and `&&` inside a class as set operators; RE2 as characters."""
    head = "[^" if token.startswith("[^") else "["
    body = token[len(head) : -1]
    parts = re.split(r"(\[:\^?\w+:\]|\\.)", body, flags=re.DOTALL)
    for i, part in enumerate(parts):
        if part.startswith("\\"):
            if part[1:] in _JAVA_ONLY_ESCAPES:
                raise ValueError(f"{part} is not supported in {token!r}")
            if part == r"\S":  # the class without the five white-space characters
                part = r"[^\t\n\f\r ]"
            parts[i] = _NARROWED_INSIDE.get(part, part)
        elif _POSIX.fullmatch(part):
            parts[i] = _POSIX.sub(_posix, part)
        else:
            parts[i] = part.replace("[", r"\[").replace("&&", r"&\&")
    if parts[0].startswith("]"):
        parts[0] = "\\" + parts[0]
    return head + "".join(parts) + "]"


def _flags(token: str, multi_line: bool, pattern: str) -> tuple[str, bool]:
    """A group opener with flags as Java writes it, and whether `$` then ends lines."""
    on, _, off = token[2:-1].partition("-")
    if set(on + off) - set("imsU") or "-" in off:
        raise ValueError(f"flags {token} are not supported in pattern {pattern!r}")
    # U swaps greedy and lazy, which has no effect on whether a match is found.
    on, off = on.replace("U", ""), off.replace("U", "")
    flags = on + (f"-{off}" if off else "")
    token = f"(?{flags}{token[-1]}" if flags or token[-1] == ":" else ""
    return token, ("m" in on or multi_line) and "m" not in off


def to_java(pattern: str) -> str:
    """The Java pattern that finds what RE2 finds; ValueError if RE2 would refuse it."""
    scopes = [False]  # for each open group, whether `$` and `^` stand at line ends
    out = []
    for token in _TOKEN.findall(pattern):
        if token.startswith(r"\Q"):
            pass
        elif token.startswith("\\"):
            if token[1:] in _JAVA_ONLY_ESCAPES:
                raise ValueError(f"{token} is not supported in pattern {pattern!r}")
            token = _NARROWED.get(token, token)
        elif token.startswith("[") and len(token) > 1:
            token = _character_class(token)
        elif re.fullmatch(r"\(\?(<?[=!]|>)", token):
            raise ValueError(f"look-around and atomic groups are not supported: {pattern!r}")
        elif len(token) == 2 and token.endswith("+"):
            raise ValueError(f"repetition {token} is not supported in pattern {pattern!r}")
        elif token == "(?P<":
            token = "(?<"
            scopes.append(scopes[-1])
        elif token.startswith("(?"):
            opens = token.endswith(":")
            token, multi_line = _flags(token, scopes[-1], pattern)
            if opens:
                scopes.append(multi_line)
            else:
                scopes[-1] = multi_line
        elif token == "(":
            scopes.append(scopes[-1])
        elif token == ")" and len(scopes) > 1:
            scopes.pop()
        elif token == "$":
            # Java's $ also matches before a final newline, and never its own empty line
            token = r"(?=\n|\z)" if scopes[-1] else r"\z"
        elif token == "^" and scopes[-1]:
            token = r"(?<=\A|\n)"  # Java's ^ does not match after a final newline
        out.append(token)
    for low, high in _REPEAT.findall(pattern):
        if max(int(low), int(high or 0)) > MOST_REPEATS:
            raise ValueError(f"repetition above {MOST_REPEATS} is not supported: {pattern!r}")
    # d: only \n ends a line, for `.`; u: case folding beyond ASCII
    return "(?du)" + "".join(out)
