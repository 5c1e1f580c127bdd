"""The prose of a document, its sentences and their measures."""

from __future__ import annotations

import re

#: Abbreviations whose point ends no sentence (fixed values).
ABBREVIATIONS = frozenset(
    "e.g i.e approx cf etc vs al fig figs eq eqs sec secs no nos vol ch pp ed eds incl resp ca viz dept est max min "
    "mr mrs ms dr prof st jr sr inc ltd co corp "
    "z.b d.h bzw usw vgl u.a s.o ggf evtl nr abb kap "
    "p.ex c.-à-d env m mme p.ej ej sra pág núm a.k.a w.r.t".split()
)

_LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
_FENCE = re.compile(r"\s{0,3}(```+|~~~+)")
_OPEN = re.compile(r"\s*<(pre|code|script|style|table|ul|ol)\b[^>]*>", re.I)
_OTHER = re.compile(
    r"""(?:\ {4}|\ {0,3}\t)\S                       # indented code
      | \s*(?:
          \#{1,6}\s | (?:=+|-+|\*+|_+)\s*$            # headings, underlines, rules
        | [-*+\u2022\u2013]\s | \(?\d{1,3}[.)]\s | [A-Za-z][.)]\s+\S   # lists
        | \|                                           # tables
        | @\d+\s | \#\d+\s | at\s\S+\(.*\)\s*$ | File\ ".*line\ \d | Traceback\b | ={3,}   # traces
        | \[[^\]]*\d[^\]]*\] | \d{4}-\d\d-\d\d[T\ ]\d\d:\d\d | \d\d:\d\d:\d\d\b | (?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE)\b[:\s]   # logs
        | // | /\* | \*/ | --\s | [{}]                 # comments, braces
        | </?[A-Za-z][^>]*>\s*$                        # markup
      )
      | .*[{}]\s*$ | .*\S\ *\|\ *\S.*\|               # blocks, table rows
    """,
    re.X,
)
#: Statements and logs of key=value, unless the words around them make a sentence of the line (see ``_wordy``).
_MAYBE = re.compile(r".*;\s*$|.*\b\w+=\S+\s+\w+=\S+")
_PLAIN = re.compile(r"[(\"'\u201c\u2018\u00ab]*[^\W\d_]+(?:['\u2019-][^\W\d_]+)*[.,:;!?)\"'\u201d\u2019\u00bb]*$")
_QUOTE = re.compile(r"\s{0,3}(?:>+\s?)+")
#: A point after such an ending, or before a small letter, ends no sentence.
_STOP = re.compile(r"([.!?\u2026]+)[\"'\u201d\u2019\u00bb)\]*_]*(?:\s+|$)")
_NOT_ALNUM = re.compile(r"[\W_]+")


def _wordy(line: str) -> bool:
    """Five or more plain words that are two thirds of the line or more."""
    words = line.split()
    plain = sum(1 for w in words if _PLAIN.match(w))
    return plain >= 5 and 3 * plain >= 2 * len(words)


def prose_paragraphs(text: str | None) -> list[str]:
    """Paragraphs of running text: what is outside code, logs, traces, tables, headings and lists.

    A fence or element left open reaches to the end. Lines of one paragraph are joined by blanks.
    """
    if not text or text.isspace():
        return []
    out, now = [], []
    fence = closing = None
    for line in _LINE.split(text):
        if fence:
            if line.strip().startswith(fence):
                fence = None
            continue
        if closing:
            if closing in line.lower():
                closing = None
            continue
        if not line or line.isspace():
            if now:
                out.append(" ".join(now))
                now = []
            continue
        if line[0] == ">":
            line = line[_QUOTE.match(line).end() :]
        other = None
        if (m := _FENCE.match(line)) is not None:
            other, fence = m, m.group(1)[:3]
        elif (m := _OPEN.match(line)) is not None:
            other, closing = m, f"</{m.group(1).lower()}>"
            if closing in line.lower():
                closing = None
        elif _OTHER.match(line) is not None or (_MAYBE.match(line) is not None and not _wordy(line)):
            other = line
        if other is not None:
            if now:
                out.append(" ".join(now))
                now = []
        else:
            now.append(line.strip())
    if now:
        out.append(" ".join(now))
    return out


def sentences(paragraph: str) -> list[str]:
    """Sentences of a paragraph. ``!``, ``?`` and points followed by a blank end one; a point does not after an
    abbreviation or single letter, nor before a small letter. Points inside words (numbers, versions, file names) have no
    blank after them."""
    out, start = [], 0
    for m in _STOP.finditer(paragraph):
        end, mark = m.end(), m.group(1)
        if mark[-1] == "." and "!" not in mark and "?" not in mark and end < len(paragraph):
            if paragraph[end].islower():
                continue
            word = paragraph[max(start, paragraph.rfind(" ", start, m.start()) + 1) : m.start()].lstrip("([\"'").lower()
            if word in ABBREVIATIONS or (len(word) == 1 and word.isalpha()):
                continue
        if s := paragraph[start:end].strip():
            out.append(s)
        start = end
    if s := paragraph[start:].strip():
        out.append(s)
    return out


def letters(text: str) -> int:
    """Letters and digits in ``text``."""
    return len(_NOT_ALNUM.sub("", text))
