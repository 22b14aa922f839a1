"""Binding a query on the driver: terms, intent, places, options. Inputs are one query long."""

from __future__ import annotations

import re
import unicodedata

from lodestar.functions import dictionaries as D

_PHRASES = {tuple(p.split()) for p in D.INDUSTRY_PHRASES + D.CITY_PHRASES}
_LONGEST = max(map(len, _PHRASES))
_STOPS, _GENERIC = set(D.STOP_WORDS), set(D.GENERIC)
_CITIES = {p.replace(" ", "_") for p in D.CITY_PHRASES}


def fold(text: str) -> str:
    return unicodedata.normalize("NFC", text).lower()


def terms(text: str) -> list[str]:
    """The same terms as ``functions.text.terms`` makes of a column."""
    words = re.sub(r"[^\w\s]+", " ", fold(text)).split()
    out, i = [], 0
    while i < len(words):
        n = next((k for k in range(_LONGEST, 1, -1) if tuple(words[i:i + k]) in _PHRASES), 1)
        out.append("_".join(words[i:i + n]))
        i += n
    return [t for t in out if len(t) > 1 and t not in _STOPS]


def search_terms(query: str) -> tuple[list[str], list[str]]:
    """(terms to search, terms of the intent).

    Terms that trigger an intent group call in the group's expansions, unless a place is
    named; without a group a term calls in its own. Expansions are cut into terms like
    any text. Intent terms leave generic words out and are filled up to eight.
    """
    base = terms(query)
    groups = [g for g, words in D.TRIGGERS.items() if set(words) & set(base)]
    spelled = lambda words: [t for w in words for t in terms(w.replace("_", " "))]
    wide: list[str] = []
    for t in base:
        wide += [t, *([] if groups else spelled(D.EXPANSIONS.get(t, [])))]
    if not _CITIES & set(base):
        wide += spelled([w for g in groups for w in D.GROUP_EXPANSIONS[g]])
    wide = list(dict.fromkeys(wide))
    intent = list(dict.fromkeys(t for t in base if t not in _GENERIC))
    more = [t for t in wide if t not in _GENERIC and t not in intent]
    return wide, intent + more[: max(0, 8 - len(intent))]


def intent_group(found: list[str]) -> str | None:
    return next((g for g in D.GROUP_PRIORITY if set(D.TRIGGERS[g]) & set(found)), None)


def place(query: str, names: list[str] = D.SEARCH_PLACES) -> str | None:
    """The longest place named in the query, ties by the alphabet."""
    q = fold(query)
    return next((p for p in sorted(names, key=lambda p: (-len(p), p)) if p in q), None)


def split_top(line: str, default: int = 10, most: int = 100) -> tuple[str, int]:
    """Query and result count of 'query --top N'; a bad count leaves the line a query."""
    query, mark, count = line.rpartition(" --top ")
    if mark and re.fullmatch(r"\s*\+?\d+\s*", count) and int(count) > 0:
        return query.strip(), min(int(count), most)
    return line.strip(), default


def effective(*parts: str | None) -> str:
    return " ".join(p.strip() for p in parts if p and p.strip())
