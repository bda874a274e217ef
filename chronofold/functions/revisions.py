"""The revision grammar: a start (name, id or its beginning), then ``^n``, ``~n``, ``^{type}`` and ``:path``."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_STEP = re.compile(r"\^\{([a-z]*)\}|\^(\d*)|~(\d*)")


@dataclass
class Revision:
    """``steps`` are ``("parent", n)``, ``("first", n)`` or ``("type", name)``, in order."""

    start: str
    steps: list[tuple[str, int | str]] = field(default_factory=list)
    path: str | None = None


def parse(text: str) -> Revision:
    """Parse a revision; ``^0`` and ``~0`` are the commit itself, an absent number is 1, ``^{}`` is any type."""
    text = text.strip()
    body, colon, path = text.partition(":")
    m = re.match(r"[^\^~:]*", body)
    out = Revision(m.group() or "HEAD", path=path if colon else None)
    at = m.end()
    while at < len(body):
        s = _STEP.match(body, at)
        if not s:
            raise ValueError(f"not a revision: {text!r}")
        kind, parent, back = s.groups()
        if kind is not None:
            out.steps.append(("type", kind))
        elif parent is not None:
            out.steps.append(("parent", int(parent or 1)))
        else:
            out.steps.append(("first", int(back or 1)))
        at = s.end()
    return out


def is_id_prefix(text: str) -> bool:
    """At least seven hex digits may abbreviate an id."""
    return re.fullmatch(r"[0-9a-fA-F]{7,40}", text) is not None
