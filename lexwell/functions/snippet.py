"""Highlighted excerpts of a text around the tokens of a query."""

from __future__ import annotations

from lexwell.functions.text import fold_text, fold_with_map
from lexwell.schema import SnippetOptions


def _starts(text: str, part: str) -> list[int]:
    out, at = [], text.find(part)
    while at >= 0:
        out.append(at)
        at = text.find(part, at + 1)
    return out


def build_snippet(content: str, tokens: list[str], options: SnippetOptions = SnippetOptions()) -> str:
    """A window of up to ``max_length`` characters centred on the first token found, all tokens in it marked.

    Tokens match as parts of words, without regard to case and accents. Touching marks are merged. If no token is found
    the excerpt is the beginning of the text; an empty text or length gives an empty excerpt.
    """
    most = options.max_length
    if not content or most <= 0:
        return ""
    folded, starts, ends = fold_with_map(content)
    wanted = list(dict.fromkeys(f for t in tokens if (f := fold_text(t))))
    spans = [(at, at + len(w)) for w in wanted for at in _starts(folded, w)]
    if not spans:
        return content[:most]
    firsts = {w: folded.find(w) for w in wanted}
    lead = min((w for w in wanted if firsts[w] >= 0), key=lambda w: firsts[w])
    width = min(most, len(content))
    middle = (starts[firsts[lead]] + ends[firsts[lead] + len(lead) - 1]) // 2
    left = min(max(middle - width // 2, 0), len(content) - width)
    right = left + width
    marks: list[list[int]] = []
    inside = sorted((max(starts[a], left), min(ends[b - 1], right)) for a, b in spans if starts[a] < right and ends[b - 1] > left)
    for a, b in inside:
        if marks and a <= marks[-1][1]:
            marks[-1][1] = max(marks[-1][1], b)
        else:
            marks.append([a, b])
    out, at = [], left
    for a, b in marks:
        out += (content[at:a], options.start_marker, content[a:b], options.end_marker)
        at = b
    return "".join((*out, content[at:right]))
