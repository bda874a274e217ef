"""Visible prose of articles in typesetting markup, as sentences of plain words."""

from __future__ import annotations

import re
import unicodedata

_ARG = r"\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"
_COMMENT = re.compile(r"(?<!\\)%[^\n]*")
#: Where a definition begins; what follows the name is read by :func:`_definitions`.
_DEFINES = re.compile(
    r"\\(?:(?:(?:re)?newcommand|providecommand|DeclareRobustCommand|DeclareMathOperator)\*?\s*(?:\{\s*\\([A-Za-z@]+)\s*\}|\\([A-Za-z@]+))"
    r"|[egx]?def\s*\\([A-Za-z@]+)|let\s*\\([A-Za-z@]+)\s*=?\s*(\\[A-Za-z@]+|[^\s\\])|(?:re)?newenvironment\*?\s*\{([^{}]*)\})"
)
_BRACE = re.compile(r"\\.|[{}]", re.S)
_COUNT = re.compile(r"\s*\[(\d)\]")
_DEFAULT = re.compile(r"\s*\[([^\[\]]*)\]")
_PARAMETERS = re.compile(r"\s*((?:#\d|[^{}#\\\n])*)(?=\{)")
_PLACE = re.compile(r"#(\d)")
#: Characters, as so many times the text's own, to which macros may expand a text; beyond, macros stand for nothing.
GROWTH = 100
_HIDDEN = re.compile(
    r"\\begin\{comment\}.*?(?:\\end\{comment\}|\Z)|\\iffalse\b.*?(?:\\fi\b|\Z)"
    r"|\\begin\{thebibliography\}.*?(?:\\end\{thebibliography\}|\Z)|\\bibitem\b.*?(?:\\end\{thebibliography\}|\Z)",
    re.S,
)
_MATH = re.compile(
    r"\$\$.*?\$\$|\$[^$\n]*(?:\n[^$\n]+)*\$|\\\[.*?(?:\\\]|\Z)|\\\(.*?\\\)"
    r"|\\begin\{(equation|align|eqnarray|displaymath|gather|multline)\*?\}.*?(?:\\end\{\1\*?\}|\Z)",
    re.S,
)
_BREAK = re.compile(
    r"\\(?:sub)*(?:section|paragraph|chapter)\*?(?:\[[^\]]*\])?\{[^{}]*\}|\\(?:begin|end)\{[^}]*\}(?:\[[^\]]*\])?(?:\{[^}]*\})?|\n\s*\n"
    r"|\\(?:title|author|date|thanks)" + _ARG
)
_DROPPED = re.compile(
    r"\\(?:cite[a-z]*|ref|eqref|label|pageref|includegraphics|input|include|subfile|bibliography|bibliographystyle|usepackage|documentclass|documentstyle|footnotemark)\*?(?:\[[^\]]*\])*(?:\{[^{}]*\})?"
)
_ACCENT = re.compile(r"""\\(?:["'`^~=.]|[cvuHkr](?![A-Za-z]))\s*\{?\s*(\\?[A-Za-z])\}?""")
_LETTER = re.compile(r"\\(ss|ae|AE|oe|OE|o|O|l|L|aa|AA|i|j)(?![A-Za-z])(?:\{\}|\s)?")
_COMMAND = re.compile(r"\\[A-Za-z@]+\*?(?:\s|\{\})?|\\\\|[{}]|\\.")
_SENTENCE = re.compile("[.!?]\\s+(?=[A-Z0-9\"(\u00c0-\u00de\u0370-\u042f\u0590-\uffff]|$)|[\u3002\uff01\uff1f]|\x00")
#: Bytes to words: letters in lower case, blanks for the rest.
_LETTERS = bytes(c | 32 if chr(c).isalpha() else 32 for c in range(128)) + b" " * 128
#: Letters of scripts that put no blanks between words (Han, Hiragana, Katakana), and words of all others.
_UNSPACED = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
_WORD = re.compile(f"[{_UNSPACED}]+|[^\\W\\d_{_UNSPACED}]{{2,}}")
_WRONG = re.compile("[\u00c2\u00c3\u00c5][\u0080-\u00bf\u0152-\u02dc\u2013-\u2122]")
#: Letters that no decomposition reduces to a base letter. Fixed values.
_BASE = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ı": "i"})


def mend(text: str) -> str:
    """Undo UTF-8 read as a single-byte code, where the text shows it."""
    if text.isascii() or not _WRONG.search(text):
        return text

    def back(m: re.Match) -> str:
        for code in ("cp1252", "latin-1"):
            try:
                return m.group().encode(code).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
        return m.group()

    return _WRONG.sub(back, text)


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKD", text.translate(_BASE))
    return "".join([c for c in text if not unicodedata.combining(c)])


def words(text: str) -> list[bytes]:
    """Folded words of at least two letters of any script; where words aren't parted by blanks, pairs of neighbouring letters."""
    if not text.isascii():
        text = fold(text)
    if text.isascii():
        return [w for w in text.encode().translate(_LETTERS).split() if len(w) > 1]
    out = []
    for w in _WORD.findall(text):
        if "\u3040" <= w[0] <= "\u9fff":
            out += [w[i : i + 2].encode() for i in range(max(1, len(w) - 1))]
        else:
            out.append(w.encode())
    return out


def _group(text: str, at: int) -> int:
    """The end of the group that opens at ``at``; of one that is never closed, the end of the text."""
    depth = 0
    for m in _BRACE.finditer(text, at):
        depth += {"{": 1, "}": -1}.get(m.group(), 0)
        if depth == 0:
            return m.end()
    return len(text)


def _definitions(text: str) -> tuple[str, dict[str, tuple[int, str | None, str]]]:
    """The text without definitions, and what they define: name -> (arguments, default of the first, body)."""
    macros, out, at = {}, [], 0
    for m in _DEFINES.finditer(text):
        if m.start() < at:
            continue
        name, end, n, default = next((g for g in m.groups()[:4] if g), None), m.end(), 0, None
        if m.group(4):
            body = m.group(5)
        else:
            if m.group(3):
                if (p := _PARAMETERS.match(text, end)) is None:
                    continue
                n, end = len(_PLACE.findall(p.group(1))), p.end()
            elif (c := _COUNT.match(text, end)) is not None:
                n, end = int(c.group(1)), c.end()
                if (d := _DEFAULT.match(text, end)) is not None:
                    default, end = d.group(1), d.end()
            gap = len(text[end:]) - len(text[end:].lstrip()) if text[end : end + 1].isspace() else 0
            if text[end + gap : end + gap + 1] != "{":
                continue
            first, end = end + gap, _group(text, end + gap)
            body = text[first + 1 : end - 1]
            if name is None and text[end : end + 1] == "{":  # an environment has two bodies
                end = _group(text, end)
        if name is not None:
            macros[name] = (n, default, body)
        out.append(text[at : m.start()])
        at = end
    return ("".join(out) + text[at:] if out else text), macros


def _expanded(text: str, macros: dict[str, tuple[int, str | None, str]]) -> str:
    """The text with own macros replaced by what they stand for, to any depth; a macro within itself stands for nothing."""
    own = re.compile(r"\\(" + "|".join(sorted(map(re.escape, macros), key=len, reverse=True)) + r")(?![A-Za-z@])(?:\{\}|\\(?=\s))?")
    plain: dict[str, str] = {}
    left = [GROWTH * (len(text) + 1000)]

    def argument(t: str, at: int) -> tuple[str, int]:
        while at < len(t) and t[at].isspace():
            at += 1
        if t[at : at + 1] == "{":
            end = _group(t, at)
            return t[at + 1 : end - 1], end
        return t[at : at + 1], at + 1

    def expand(t: str, within: tuple[str, ...]) -> str:
        out, at = [], 0
        for m in own.finditer(t):
            if m.start() < at:
                continue
            name, end = m.group(1), m.end()
            n, default, body = macros[name]
            if name in within or left[0] < 0:
                got = ""
            elif n == 0:
                if name not in plain:
                    made = expand(body, (*within, name))
                    if within:  # what stands for nothing here may not do so elsewhere
                        got = made
                    else:
                        got = plain[name] = made
                else:
                    got = plain[name]
            else:
                end, given = m.start() + 1 + len(name), []
                if default is not None:
                    d = _DEFAULT.match(t, end)
                    given, end = ([d.group(1)], d.end()) if d else ([default], end)
                while len(given) < n:
                    value, end = argument(t, end)
                    given.append(value)
                got = expand(_PLACE.sub(lambda k: given[int(k.group(1)) - 1] if 0 < int(k.group(1)) <= n else "", body), (*within, name))
            left[0] -= len(got)
            out += [t[at : m.start()], got]
            at = end
        return "".join(out) + t[at:] if out else t

    return expand(text, ())


def visible(text: str) -> str:
    """The text as it is read: no comments, definitions, bibliography or maths, own macros replaced; ``\\x00`` parts blocks."""
    t = mend(text)
    if "%" in t:
        t = _COMMENT.sub("", t)
    if "\\" in t:
        t = _HIDDEN.sub("\x00", t)
        t, macros = _definitions(t)
        start = t.find("\\begin{document}")
        if start >= 0:
            t = t[start + 16 :]
        end = t.find("\\end{document}")
        if end >= 0:
            t = t[:end]
        if macros:
            t = _expanded(t, macros)
    if "$" in t or "\\" in t:
        t = _MATH.sub(" ", t)
    t = _BREAK.sub("\x00", t)
    if "\\" in t:
        t = _DROPPED.sub(" ", t)
        t = t.replace("\\-", "")
        t = _ACCENT.sub(lambda m: m.group(1)[-1], t)
        t = _LETTER.sub(lambda m: m.group(1), t)
        t = _COMMAND.sub(lambda m: " " if m.group()[0] == "\\" else "", t)
    return t.replace("~", " ")


def sentences(text: str | None) -> list[list[bytes]]:
    """The visible sentences, each as its folded words; sentences without a word are left out. None for no text."""
    if not text:
        return []
    return [w for s in _SENTENCE.split(visible(text)) if s and (w := words(s))]
