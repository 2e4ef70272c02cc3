"""Bindings of names to string literals in source text, found by one tokenizer for all languages.

The tokenizer knows strings (with prefixes, triple quotes, templates, raw strings), comments, names with
members and indexes, and the marks that bind. It never fails: a fragment gives what it holds.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

# The names that count as sensitive, and the extensions of each language.
SENSITIVE_NAMES = ("system_prompt", "api_key", "secret", "password", "token", "private_key", "credentials", "encryption_key", "access_key", "signing_key", "session_key", "master_key")
LANGUAGES = {"py": "python", "js": "script", "jsx": "script", "mjs": "script", "cjs": "script", "ts": "script", "mts": "script", "cts": "script", "tsx": "script", "go": "go", "java": "java"}
MIN_BYTES, LONG_BYTES, RICH_BITS = 10, 50, 4.0

NAME = r"[A-Za-z_$][\w$]*"
_COMMON = rf"(?P<name>{NAME}(?:\s*(?:\.|\?\.)\s*{NAME}|\[[^\]\n]*\])*)|(?P<bind>:=|==+|=>|[!<>]=|[-+*/%|&^]=|=|:)|(?P<space>[^\S\n]+)|(?P<line>\n)|(?P<other>.)"
_STRINGS = {
    "python": r"(?P<comment>\#[^\n]*)|(?P<string>(?:[rRbBuUfF]{0,2})(?:\"\"\"(?:\\.|(?!\"\"\").)*(?:\"\"\"|\Z)|'''(?:\\.|(?!''').)*(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'))",
    "script": r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)",
    "go": r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<rune>'(?:\\.|[^'\\\n])*')|(?P<string>\"(?:\\.|[^\"\\\n])*\"|`[^`]*`)",
    "java": r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<rune>'(?:\\.|[^'\\\n])*')|(?P<string>\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\")",
}
TOKENS = {k: re.compile(f"{v}|{_COMMON}", re.S) for k, v in _STRINGS.items()}
#: Words that aren't names on the left of a binding.
KEYWORDS = frozenset("const let var return if else for while case default func def class import from new in of export public private protected static final".split())


@dataclass(frozen=True)
class Binding:
    name: str
    row: int
    snippet: str
    value: str
    confidence: float


def entropy(value: str) -> float:
    data = value.encode()
    return -sum(n / len(data) * math.log2(n / len(data)) for n in Counter(data).values()) if data else 0.0


def is_sensitive(name: str, names=SENSITIVE_NAMES) -> bool:
    low = name.lower()
    flat = low.replace("_", "")
    return any(v in low or v.replace("_", "") in flat for v in names)


def is_placeholder(value: str) -> bool:
    low = value.lower()
    return (
        value.startswith(("test_", "fake_", "${", "{{")) or low.startswith("placeholder") or value[:1] == "<" and value[-1:] == ">"
        or low.startswith("your") and low.endswith("here") or low in ("changeme", "xxx")
    )


def confidence_of(value: str) -> float:
    rich, long = entropy(value) >= RICH_BITS, len(value.encode()) > LONG_BYTES
    return {(True, True): 0.90, (True, False): 0.80, (False, True): 0.75, (False, False): 0.60}[rich, long]


def bindings_in(source: str, ext: str, names=SENSITIVE_NAMES) -> list[Binding]:
    """Sensitive bindings in order. Keyword arguments, parameters and struct fields bind nothing; entries of objects and dictionaries do."""
    language = LANGUAGES.get(ext)
    if language is None:
        return []
    tokens = [(m.lastgroup, m.group(), m.start(), m.end()) for m in TOKENS[language].finditer(source) if m.lastgroup not in ("space", "comment")]
    out: list[Binding] = []
    opened = _opened(tokens, language)
    lines = [m.start() for m in re.finditer("\n", source)]
    brackets: list[str] = []
    for i, (kind, text, _, _) in enumerate(tokens):
        if kind == "other":
            if text in "([{":
                brackets.append(opened[i])
            elif text in ")]}" and brackets:
                brackets.pop()
        if kind != "bind" or text not in ("=", ":=", ":"):
            continue
        right = _right(tokens, i + 1, language)  # first, as few marks have a literal behind them
        left = right and _left(tokens, i, language, text, brackets[-1] if brackets else "")
        if not left:
            continue
        name, at = left
        value = right[0].strip("\"'`")
        if is_sensitive(name, names) and len(value.encode()) >= MIN_BYTES and not is_placeholder(value):
            out.append(Binding(name, bisect_left(lines, at), source[at : right[1]][:100], value, confidence_of(value)))
    return out


#: Words before a bracket that doesn't hold parameters.
TESTS = frozenset("if for while switch with".split())
#: Words that head a body of members, and those that declare the name after them.
BODIES = frozenset("class interface enum".split())
DECLARES = frozenset("const let var readonly public private protected static declare export final".split())


def _opened(tokens, language: str) -> dict[int, str]:
    """What each opening bracket opens: itself, or a script's parameters, pattern to take apart or body of members, or an annotation's arguments."""
    out: dict[int, str] = {}
    open_at: list[int] = []
    for i, (kind, text, _, _) in enumerate(tokens):
        if kind != "other":
            continue
        if text in "([{":
            open_at.append(i)
            annotated = language == "java" and text == "(" and i > 1 and tokens[i - 1][0] == "name" and tokens[i - 2][1] == "@"
            out[i] = "annotation" if annotated else "class" if language == "script" and text == "{" and _heads_body(tokens, i) else text
        elif text in ")]}" and open_at:
            at = open_at.pop()
            after = next((t for t in tokens[i + 1 : i + 3] if t[0] != "line"), ("", "", 0, 0))
            if language != "script":
                continue
            if out[at] == "(" and _are_parameters(tokens, at, i):
                out[at] = "parameters"
            elif out[at] in ("{", "[") and (after[1] == "=" or after[0] == "name" and after[1] in ("of", "in")):
                out[at] = "pattern"
    if language == "script":  # what a pattern or a list of parameters holds is a pattern too, but for values
        held: list[int] = []
        for i, (kind, text, _, _) in enumerate(tokens):
            if kind == "other" and text in "([{":
                value = i and tokens[i - 1][1] == "="
                if held and out[i] in ("{", "[") and out[held[-1]] in ("pattern", "parameters") and not value:
                    out[i] = "pattern"
                held.append(i)
            elif kind == "other" and text in ")]}" and held:
                held.pop()
    return out


def _heads_body(tokens, i: int) -> bool:
    """Whether before this brace stands the head of a class, an interface or an enum, or what makes it a type."""
    before = [t[1] for t in tokens[max(0, i - 3) : i]]
    if len(before) == 3 and before[2] == ":" and before[0] in DECLARES:
        return True  # let x: { ... }
    alias = before[-1:] == ["="]
    for kind, text, _, _ in reversed(tokens[max(0, i - 40) : i - alias]):
        if kind == "name" and text in ({"type"} if alias else BODIES):
            return True
        if alias and kind == "line" or kind not in ("name", "line") and text not in ("<", ">", ","):
            return False
    return False


def _annotated(tokens, i: int) -> tuple[str, int] | None:
    """The name whose declared type ends before token ``i``: back over the type, brackets counted, to its colon."""
    depth = 0
    for k in range(i - 1, 0, -1):
        kind, text = tokens[k][:2]
        if kind in ("other", "bind") and text in (">", "]", ")", "}"):
            depth += 1
        elif kind == "other" and text in ("<", "[", "(", "{"):
            depth -= 1
            if depth < 0:
                return None
        elif depth == 0 and text == ":" and kind == "bind":
            name = tokens[k - 1]
            before = tokens[k - 2] if k > 1 else ("line", "\n", 0, 0)
            starts = before[0] == "line" or before[1] in (";", "{", "}") or before[1] in DECLARES
            return (name[1], name[2]) if name[0] == "name" and starts and name[1] not in KEYWORDS | {"try", "finally"} else None
        elif depth == 0 and (kind in ("line", "comment") or text in (";", ",", "=", ":=")):
            return None
    return None


def _are_parameters(tokens, first: int, last: int) -> bool:
    """Whether brackets hold a function's parameters: an arrow or a body follows, and no test stands before."""
    before = [t[1] for t in tokens[max(0, first - 2) : first]]
    after = [t[1] for t in tokens[last + 1 : last + 6] if t[0] != "line"][:3]
    if after[:1] == ["=>"] or "function" in before:
        return True
    body = after[:1] == ["{"] or after[:1] == [":"] and after[2:3] in (["{"], ["=>"])
    return body and bool(before) and before[-1] not in TESTS


def _left(tokens, i: int, language: str, bind: str, inside: str) -> tuple[str, int] | None:
    """The bound name's text and place."""
    if i == 0:
        return None
    kind, text, at, _ = tokens[i - 1]
    before = tokens[i - 2] if i > 1 else ("line", "\n", 0, 0)
    if bind == ":":  # an entry of an object or dictionary
        if inside != "{" or language not in ("python", "script") or kind not in ("name", "string") or before[1] not in ("{", ",", "\n"):
            return None
        return text, at
    if bind == ":=" and language == "go" or bind == "=":
        if inside in ("parameters", "annotation", "class", "pattern"):
            return None
        if inside == "(" and language in ("python", "go") and not (language == "go" and before[0] in ("line",)):
            return None  # an argument or a parameter
        # a declared type between the name and the mark: name: Type = ..., var name Type = ...
        if language in ("python", "script") and (declared := _annotated(tokens, i)):
            return declared
        if kind != "name":
            return None
        if language == "go" and before[0] == "name" and before[1] not in KEYWORDS:
            return before[1], before[2]
        if language == "go" and before[1] == ",":  # of a list of names the first
            k = i - 2
            while k > 0 and tokens[k][1] == "," and tokens[k - 1][0] == "name":
                k -= 2
            return tokens[k + 1][1], tokens[k + 1][2]
        return text, at
    return None


def _right(tokens, i: int, language: str) -> tuple[str, int] | None:
    """The literal's text, neighbours in one expression joined as written, and where it ends; None if more than a literal follows."""
    if i >= len(tokens) or tokens[i][0] != "string":
        return None
    text, end = tokens[i][1], tokens[i][3]
    i += 1
    while language == "python" and i < len(tokens) and tokens[i][0] == "string":
        text, end = text + tokens[i][1], tokens[i][3]
        i += 1
    if i < len(tokens) and not (tokens[i][0] == "line" or tokens[i][1] in ",;)}]" or tokens[i][0] == "name"):
        return None
    return text, end
