"""Text functions as column expressions, with explicit white space and ASCII word boundaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\t\n\x0B\f\r\x20\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
WIDE_WHITE = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
LETTERS = "a-zà-öø-ÿ"
#: What stands between runs of letters. The JVM looks single signs up in a table, but tests ranges beyond ASCII slowly.
APART = f"[^a-z{''.join(chr(c) for c in range(0xE0, 0x100) if c != 0xF7)}]+"
#: Endings that a theme word of four letters or more may have.
ENDINGS = ("s", "es", "ed", "ing")
#: An ASCII word boundary; the engine's own \b counts accented letters as word characters.
BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
CJK = r"\u3400-\u9fff\u3040-\u30ff"


def strings(words) -> Column:
    """A constant array; the plan holds the array, not a call for each word."""
    words = list(words)
    return F.split(F.lit("|".join(words)), r"\|") if words else F.array().cast("array<string>")


def once(value: Column, use) -> Column:
    """use(value), for a use that refers to value many times: value is evaluated once for a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def wide(text: Column) -> Column:
    """Whether a text has letters beyond ASCII."""
    return F.octet_length(text) > F.char_length(text)


def collapse(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends. Signs are replaced one by one, which costs much less than
    a pattern; patterns see texts with white space beyond ASCII and with more than one blank."""

    def ascii_only(t: Column) -> Column:
        for sign in "\t\n\x0b\f\r":
            t = F.replace(t, F.lit(sign), F.lit(" "))
        return t

    def rest(t: Column) -> Column:
        odd = wide(t) & F.exists(strings(WIDE_WHITE), lambda w: t.contains(w))
        return F.when(odd, F.regexp_replace(t, WHITE + "+", " ")).when(t.contains("  "), F.regexp_replace(t, "  +", " ")).otherwise(t)

    return F.trim(once(ascii_only(text), rest))


def clean_text(text: Column) -> Column:
    """Without markup; white space collapsed."""
    return collapse(once(text, lambda t: F.when(t.contains("<"), F.regexp_replace(t, "<[^>]+>", " ")).otherwise(t)))


def portable(pattern: str) -> str:
    """A rule's pattern for the JVM: any case, ASCII boundaries, explicit white space."""
    return "(?iu)" + pattern.replace(r"\b", BOUNDARY).replace(r"\s", WHITE)


def word_pattern(word: str) -> str | None:
    """The pattern of a theme word that stands between non-letters, with plain inflections; None for substring words."""
    if re.search(rf"[^{LETTERS}\s'-]", word):
        return None
    ending = f"(?:{'|'.join(ENDINGS)})?" if " " not in word and len(word) >= 4 else ""
    inner = re.escape(word).replace(r"\ ", " ").replace(" ", r"\s+")
    return f"(?:^|[^{LETTERS}]){inner}{ending}(?:$|[^{LETTERS}])"


def contains_word(haystack: Column, word: str) -> Column:
    """Whether a lower-case text has a theme word."""
    pattern = word_pattern(word)
    return haystack.contains(word) if pattern is None else haystack.rlike(pattern.replace(r"\s", WHITE))


def stem(token: Column) -> Column:
    """A light English stem: plural, -ing, -ed and -es endings, then a doubled last letter."""
    last = lambda w, k: F.substring(w, F.lit(-k), F.lit(1))

    def single(w: Column) -> Column:
        return F.when((F.char_length(w) > 1) & (last(w, 1) == last(w, 2)) & last(w, 1).between("a", "z"), F.substring(w, F.lit(1), F.char_length(w) - 1)).otherwise(w)

    def cut(w: Column) -> Column:
        n = F.char_length(w)
        less = lambda k: F.substring(w, F.lit(1), n - k)
        ed = F.when(less(2).endswith("at") | less(2).endswith("iz"), F.concat(less(2), F.lit("e"))).otherwise(less(2))
        shorter = (
            F.when((n > 5) & w.endswith("ing"), less(3))
            .when((n > 4) & w.endswith("ed"), ed)
            .when((n > 4) & w.endswith("es"), less(2))
            .when((n > 4) & w.endswith("s"), less(1))
            .otherwise(w)
        )
        return F.when((n > 5) & w.endswith("ies"), F.concat(less(3), F.lit("y"))).otherwise(once(shorter, single))

    return once(F.when(token.contains("'"), F.regexp_replace(token, "^'+|'+$", "")).otherwise(token), cut)


def kept_apart(rows: DataFrame, *names: str) -> DataFrame:
    """rows, to be filtered by these columns: they pass a generator, so a filter is not pushed below the expressions
    that they are made of, which would evaluate those a second time."""
    made = F.inline(F.array(F.struct(*(F.col(n).alias(n) for n in names))))
    return rows.select(*(c for c in rows.columns if c not in names), made)
