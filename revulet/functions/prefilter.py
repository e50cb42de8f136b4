"""Substrings that a pattern needs: a cheap test before the pattern itself.

Most texts match none of the rules. Looking for a few substrings costs a fraction of what a pattern with alternatives,
boundaries and gaps costs, so a pattern only runs over texts that have one of the substrings without which it can't match.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from re import _constants as op
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CJK, LETTERS, portable, strings, wide

#: Most strings that a part of a pattern is spelt out to.
MOST = 24
#: Least letters that strings are grouped by; fewer are in too many texts.
STEM = 5
#: Letters that ignoring case equates with ASCII ones, though they are no capitals of them.
_ODD, _PLAIN = "ſıİK", "siik"


def _least(words: Iterable[str]) -> frozenset[str]:
    """Without those that contain another one."""
    words = set(words)
    return frozenset(w for w in words if not any(o in w for o in words if o != w))


def _better(sets: Iterable[frozenset[str]]) -> frozenset[str] | None:
    """The most telling set: of strings of four letters or more, then few, then long."""
    usable = [s for s in sets if s and "" not in s]
    return max(usable, key=lambda s: (min(4, min(map(len, s))), -len(s), min(map(len, s))), default=None)


def _read(items) -> tuple[frozenset[str] | None, frozenset[str] | None]:
    """All strings that a sequence matches, if few, and strings of which each of its matches has one, if known."""
    run, needed, whole = frozenset([""]), [], True
    for kind, value in items:
        exact, need = _one(kind, value)
        if exact is not None and len(run) * len(exact) <= MOST:
            run = frozenset(a + b for a in run for b in exact)
            continue
        whole = False
        needed += [_least(run), *([need] if need else [])]
        run = exact if exact is not None and len(exact) <= MOST else frozenset([""])
    needed.append(_least(run))
    return (run if whole else None), _better(needed)


def _one(kind, value) -> tuple[frozenset[str] | None, frozenset[str] | None]:
    if kind is op.LITERAL:
        return frozenset([chr(value).lower()]), None
    if kind is op.AT:
        return frozenset([""]), None
    if kind is op.IN and all(k is op.LITERAL for k, _ in value):
        return frozenset(chr(c).lower() for _, c in value), None
    if kind is op.SUBPATTERN:
        return _read(value[3])
    if kind is op.BRANCH:
        parts = [_read(p) for p in value[1]]
        exact = None if any(e is None for e, _ in parts) else frozenset().union(*(e for e, _ in parts))
        return exact, None if any(n is None for _, n in parts) else _least(frozenset().union(*(n for _, n in parts)))
    if kind is op.MAX_REPEAT:
        low, high, body = value
        if list(body) == [(op.IN, [(op.CATEGORY, op.CATEGORY_SPACE)])]:  # white space is collapsed
            return frozenset([" "] if low else ["", " "]), None
        exact, need = _read(body)
        if (low, high) == (0, 1):
            return None if exact is None else exact | {""}, None
        return (exact, need) if (low, high) == (1, 1) else (None, need if low else None)
    return None, None


def needed(pattern: str) -> tuple[str, ...] | None:
    """Lower-case strings of which every text that the pattern matches has at least one, whatever its case; None if
    there are none. White space in the text must be single blanks."""
    exact, need = _read(_parser.parse(pattern))
    return None if need is None else tuple(sorted(need))


def folded(text: Column) -> Column:
    """The text in lower case, to look for needed() strings."""
    return F.lower(F.when(wide(text), F.translate(text, _ODD, _PLAIN)).otherwise(text))


def run_of(word: str) -> str:
    """The longest run of letters of a lower-case string, '' if it has none."""
    return max(re.findall(f"[{LETTERS}]+", word), key=len, default="")


def shared_stems(words: Iterable[str]) -> dict[str, list[str]]:
    """words by the strings that they are looked for by: parts of STEM letters or more of their longest runs that several
    share, or the runs themselves. Words without letters have ''."""
    left = {word: run_of(word) for word in words}
    parts: dict[str, list[str]] = {}
    for word, run in left.items():
        for part in {run[i:j] for i in range(len(run)) for j in range(i + STEM, len(run) + 1)}:
            parts.setdefault(part, []).append(word)
    out: dict[str, list[str]] = {}
    while left:
        stem, found = max(((p, [w for w in ws if w in left]) for p, ws in parts.items()), key=lambda x: (len({left[w] for w in x[1]}), len(x[0]), x[0]), default=("", []))
        if len({left[w] for w in found}) < 2:
            break
        out[stem] = found
        for word in found:
            del left[word]
    for word, run in left.items():
        out.setdefault(run, []).append(word)
    return out


def _openings(items) -> tuple[set[str] | None, bool]:
    """The signs that a match of a sequence can begin with, if known, and whether it can be empty."""
    found: set[str] = set()
    for kind, value in items:
        if kind is op.AT:
            continue
        if kind is op.LITERAL:
            own, empty = {chr(value)}, False
        elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
            own, empty = {chr(c) for _, c in value}, False
        elif kind is op.SUBPATTERN:
            own, empty = _openings(value[3])
        elif kind is op.BRANCH:
            parts = [_openings(p) for p in value[1]]
            own, empty = None if any(o is None for o, _ in parts) else set().union(*(o for o, _ in parts)), any(e for _, e in parts)
        elif kind is op.MAX_REPEAT:
            own, empty = _openings(value[2])
            empty = empty or value[0] == 0
        else:
            own, empty = None, False
        if own is None:
            return None, False
        found |= own
        if not empty:
            return found, False
    return found, True


def opened(pattern: str) -> str:
    """The pattern for the JVM, after a look at the next sign: one that a match can begin with, or any beyond ASCII. That
    rules out most places of a text at less cost than a boundary."""
    signs, empty = _openings(_parser.parse(pattern))
    if signs is None or empty:
        return portable(pattern)
    ascii_signs = sorted({c for sign in signs if sign.isascii() for c in (sign.lower(), sign.upper())})
    return f"(?=[{''.join(map(re.escape, ascii_signs))}\\x{{80}}-\\x{{10FFFF}}])" + portable(pattern)


def dotted(text: Column) -> Column:
    """Whether a text has a number with a decimal point, as versions have."""
    return text.rlike(r"[0-9]\.[0-9]")


def matching(rules, text: Column, folded_text: Column, is_wide: Column, is_cjk: Column, is_dotted: Column) -> Column:
    """The ids of the rules (id, pattern) that a text matches, in order. is_wide: whether the text has letters beyond
    ASCII; is_cjk: Chinese or Japanese ones; is_dotted: dotted(). Rules are constants of the plan, and their patterns run
    only where they can match.

    A string that a pattern needs is looked for by its longest run of letters, or a part that it shares with others;
    where that is found, the text must have the string itself."""
    plain, beyond, signs, always, numbered = {}, {}, {}, [], []
    for name, pattern in rules:
        words = needed(pattern)
        if r"\d+(?:\.\d+){1,3}" in pattern:
            numbered.append(name)
        elif words is None:
            always.append(name)
        else:
            for word in words:
                (signs if re.search(f"[{CJK}]", word) else plain if word.isascii() else beyond).setdefault(word, []).append(name)

    def named(by: dict[str, list[str]], where: Column) -> Column:
        of = F.str_to_map(F.lit("\n".join(f"{word}\t{'|'.join(names)}" for word, names in by.items())), F.lit("\n"), F.lit("\t"))
        return F.flatten(F.transform(F.filter(where, lambda w: folded_text.contains(w)), lambda w: F.split(F.element_at(of, w), r"\|")))

    def by_runs(by: dict[str, list[str]]) -> Column:
        stems = shared_stems(by)
        rest = stems.pop("", [])
        of = F.str_to_map(F.lit("\n".join(f"{stem}\t{'|'.join(words)}" for stem, words in stems.items())), F.lit("\n"), F.lit("\t"))
        found = F.flatten(F.transform(F.filter(strings(stems), lambda r: folded_text.contains(r)), lambda r: F.split(F.element_at(of, r), r"\|")))
        return named(by, F.concat(found, strings(rest)) if rest else found)

    parts = [strings(always)]
    parts += [by_runs(plain)] if plain else []
    parts += [F.when(is_wide, by_runs(beyond)).otherwise(strings([]))] if beyond else []
    parts += [F.when(is_cjk, named(signs, strings(signs))).otherwise(strings([]))] if signs else []
    parts += [F.when(is_dotted, strings(numbered)).otherwise(strings([]))] if numbered else []
    patterns = F.str_to_map(F.lit("\n".join(f"{name}\t{opened(pattern)}" for name, pattern in rules)), F.lit("\n"), F.lit("\t"))
    return F.filter(F.array_intersect(strings(name for name, _ in rules), F.concat(*parts)), lambda i: F.rlike(text, F.element_at(patterns, i)))
