"""Rules of robots files (RFC 9309): which agent may fetch which path."""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import unquote, urlsplit


@lru_cache(maxsize=4096)
def groups(text: str) -> dict[str, list[tuple[bool, str]]]:
    """agent -> its rules (allow, pattern); lines of agents one after another share the rules that follow."""
    out: dict[str, list[tuple[bool, str]]] = {}
    agents: list[str] = []
    in_rules = False
    for line in text.splitlines():
        field, colon, value = line.split("#", 1)[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if not colon:
            continue
        if field == "user-agent":
            agents = [value.lower()] if in_rules else [*agents, value.lower()]
            in_rules = False
            out.setdefault(value.lower(), [])
        elif field in ("allow", "disallow"):
            in_rules = True
            for a in agents if value else ():
                out[a].append((field == "allow", value))
    return out


def fits(pattern: str, path: str) -> bool:
    """* stands for anything, $ at the end for the path's end."""
    end = pattern.endswith("$")
    body = ".*".join(re.escape(unquote(p)) for p in (pattern[:-1] if end else pattern).split("*"))
    return re.match(body + ("$" if end else ""), unquote(path)) is not None


def allowed(text: str | None, agent: str, url: str) -> bool:
    """The longest fitting rule of the agent's group (else of *) decides, allow on a tie; no rule: allowed."""
    known = groups(text or "")
    name = agent.lower().split("/", 1)[0]
    rules = next((known[a] for a in sorted(known, key=len, reverse=True) if a != "*" and a and a in name), known.get("*", []))
    parts = urlsplit(url)
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    if parts.path == "/robots.txt":
        return True
    found = [(len(p), ok) for ok, p in rules if fits(p, path)]
    return max(found)[1] if found else True
