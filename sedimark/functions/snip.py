"""Shortening quotations in mail bodies."""

from __future__ import annotations

import re

CONTEXT = 6
_REPLY = re.compile(r"(?i)^(on\b.*wrote:|.*\bwrote:|.*\bwrites:)\s*$")


def snip_quotes(body: str, context: int = CONTEXT) -> str:
    """Quoted lines further than ``context`` lines from the mail's own words give way to ``[...]``.

    Lines that announce a quotation belong to it; what is already cut (``[...]``, ``<snip>``) stays as one mark.
    """
    lines = body.split("\n")
    quoted = [line.lstrip().startswith(">") for line in lines]
    announces = [bool(_REPLY.match(line)) and any(quoted[i + 1 : i + 3]) for i, line in enumerate(lines)]
    own = [i for i, line in enumerate(lines) if line.strip() and not quoted[i] and not announces[i]]
    if not any(quoted) or not own:
        return body
    near = [False] * len(lines)
    for i in own:
        for j in range(max(0, i - context), min(len(lines), i + context + 1)):
            near[j] = True
    out: list[str] = []
    for i, line in enumerate(lines):
        mark = line.strip().lstrip("> ").lower() in ("[...]", "<snip>", "[snip]")
        if quoted[i] and (mark or not near[i]):
            if not out or out[-1] != "[...]":
                out.append("[...]")
        else:
            out.append(line)
    return "\n".join(out)
