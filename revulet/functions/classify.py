"""Classification of reviews by word lists and patterns: themes, link to a release, scope."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .prefilter import dotted, folded, matching, run_of
from .text import APART, CJK, ENDINGS, LETTERS, collapse, strings, wide, word_pattern

SOFTWARE_THEMES = ("stability", "performance", "account", "sync", "notifications")
POLICY_THEMES = ("pricing", "privacy", "usability")
REQUESTABLE = {"sync": fixed.REQUESTABLE_SYNC, "notifications": fixed.REQUESTABLE_NOTIFICATIONS}
PROBLEMS = [t for t, (_, intent, _) in fixed.THEMES.items() if intent == "problem"]
REQUESTS = [t for t, (_, intent, _) in fixed.THEMES.items() if intent == "request"]


def haystack() -> Column:
    """Title and body as one text with collapsed white space."""
    return collapse(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))))


EVERY_WORD = tuple(dict.fromkeys(w for _, _, words in fixed.THEMES.values() for w in words))
SINGLE = [w for w in EVERY_WORD if re.fullmatch(f"[{LETTERS}]+", w)]
INSIDE = [w for w in EVERY_WORD if word_pattern(w) is None]
PHRASES = [w for w in EVERY_WORD if w not in SINGLE and w not in INSIDE]


def _forms() -> dict[str, list[str]]:
    """The theme words that a run of letters shows: words of letters alone by each of their inflections, phrases by
    their longest run."""
    out: dict[str, list[str]] = {}
    for word in SINGLE:
        for ending in ("", *ENDINGS) if len(word) >= 4 else ("",):
            out.setdefault(word + ending, []).append(word)
    for phrase in PHRASES:
        out.setdefault(run_of(phrase), []).append(phrase)
    return out


def matched_words(text: Column) -> Column:
    """All theme words that a lower-case text with collapsed white space has.

    Words are looked up by the text's runs of letters; phrases found so must match their patterns. Words of other
    scripts are substrings.
    """
    forms = _forms()
    of = F.str_to_map(F.lit(",".join(f"{form}:{'|'.join(words)}" for form, words in forms.items())))
    runs = F.array_intersect(strings(forms), F.split(text, APART))
    found = F.flatten(F.transform(runs, lambda t: F.split(F.element_at(of, t), r"\|")))
    pattern = F.str_to_map(F.lit("\n".join(f"{w}\t{word_pattern(w).replace(chr(92) + 's+', ' ')}" for w in PHRASES)), F.lit("\n"), F.lit("\t"))
    words = F.filter(found, lambda w: ~F.map_contains_key(pattern, w) | F.rlike(text, F.element_at(pattern, w)))
    inside = F.when(wide(text) & text.rlike(f"[ß{CJK}]"), F.filter(strings(INSIDE), lambda w: text.contains(w))).otherwise(strings([]))
    return F.concat(words, inside)


def rule_hits(rules) -> Column:
    """The ids of the rules whose patterns a row matches, in order; for rows with_plain()."""
    return matching(rules, F.col("_plain"), F.col("_folded"), F.col("_wide"), F.col("_cjk"), F.col("_dotted"))


PLAIN = ("_plain", "_text", "_folded", "_wide", "_cjk", "_dotted")


def with_plain(rows: DataFrame) -> DataFrame:
    """rows with what the rules look at."""
    text, lower = F.col("_plain"), F.col("_text")
    rows = rows.withColumn("_plain", haystack()).withColumns({"_text": F.lower(text), "_wide": wide(text), "_dotted": dotted(text)})
    return rows.withColumns({"_folded": F.when(F.col("_wide"), folded(text)).otherwise(lower), "_cjk": F.col("_wide") & text.rlike(f"[{CJK}]")})


def hit(theme: str) -> Column:
    return F.col("hits")[theme]


def has(theme: str) -> Column:
    return F.size(hit(theme)) > 0


def asks() -> Column:
    """Whether a review has a request theme."""
    out = F.lit(False)
    for theme in REQUESTS:
        out = out | has(theme)
    return out


def only_requested(theme: str) -> Column:
    """Whether a problem theme's words all name something that is asked for, in a review that asks."""
    if theme not in REQUESTABLE:
        return F.lit(False)
    return asks() & has(theme) & (F.size(F.array_except(hit(theme), strings(REQUESTABLE[theme]))) == 0)


def with_themes(reviews: DataFrame) -> DataFrame:
    """reviews (title, body) with hits: a struct of the words found for each theme. Null texts have none."""
    return _themed(with_plain(reviews)).drop(*PLAIN)


def _themed(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("_words", matched_words(F.col("_text")))
    return rows.withColumn("hits", F.struct(*(F.array_intersect(strings(words), F.col("_words")).alias(t) for t, (_, _, words) in fixed.THEMES.items()))).drop("_words")


def confidence(count: Column) -> Column:
    return F.least(F.lit(0.98), F.lit(0.56) + count * F.lit(0.13))


def themes() -> Column:
    """Matches as array of (id, intent, hits, confidence), from hits."""
    every = [F.struct(F.lit(t).alias("id"), F.lit(intent).alias("intent"), hit(t).alias("hits"), confidence(F.size(hit(t))).alias("confidence")) for t, (_, intent, _) in fixed.THEMES.items()]
    return F.filter(F.array(*every), lambda x: F.size(x["hits"]) > 0)


def _linked(rows: DataFrame) -> DataFrame:
    out = rows.withColumns({"_explicit": rule_hits(fixed.EXPLICIT_RULES), "_change": rule_hits(fixed.CHANGE_RULES)})
    kind = F.when(F.size("_explicit") > 0, "explicit").when(F.size("_change") > 0, "change").otherwise("none")
    return out.withColumn("link", F.struct(kind.alias("kind"), F.col("_explicit").alias("explicit_hits"), F.col("_change").alias("change_hits"))).drop("_explicit", "_change")


def with_link(reviews: DataFrame) -> DataFrame:
    """reviews with link: (kind, explicit_hits, change_hits)."""
    return _linked(with_plain(reviews)).drop(*PLAIN)


def _named(theme: str) -> Column:
    return F.transform(hit(theme), lambda w: F.concat(F.lit(f"theme-{theme}:"), w))


def with_scope(classified: DataFrame) -> DataFrame:
    """A frame with hits gets scope: (primary, actionable, software, product_policy, community, support, software_themes)."""
    return _scoped(with_plain(classified)).drop(*PLAIN)


def _scoped(rows: DataFrame) -> DataFrame:
    rules = {"_strong": fixed.SOFTWARE_RULES, "_community": fixed.COMMUNITY_RULES, "_support": fixed.SUPPORT_RULES, "_policy": fixed.POLICY_RULES}
    out = rows.withColumns({name: rule_hits(r) for name, r in rules.items()})

    def usable(theme: str) -> Column:
        left = lambda words: F.size(F.array_except(hit(theme), strings(words))) > 0
        if theme == "account":
            return left(fixed.AMBIGUOUS_ACCOUNT)
        if theme in REQUESTABLE:
            return F.when(asks(), left(REQUESTABLE[theme])).otherwise(has(theme))
        return has(theme)

    order = [t for t in fixed.THEMES if t in SOFTWARE_THEMES]
    software = F.array_compact(F.array(*(F.when(usable(t), F.lit(t)) for t in order)))
    named = [_named(t) for t in [*(t for t in fixed.THEMES if t in POLICY_THEMES), *REQUESTS]]
    out = out.withColumn("_themes", software).withColumn("_policy", F.array_distinct(F.concat("_policy", *named)))
    primary = (
        F.when(F.size("_strong") > 0, "software")
        .when(F.size("_community") > 0, "community")
        .when(F.size("_support") > 0, "support")
        .when(F.size("_policy") > 0, "product-policy")
        .when(F.size("_themes") > 0, "software")
        .otherwise("unclear")
    )
    both = F.concat("_strong", F.transform("_themes", lambda t: F.concat(F.lit("theme-"), t)))
    scope = F.struct(
        primary.alias("primary"),
        (primary == "software").alias("actionable"),
        both.alias("software"),
        F.col("_policy").alias("product_policy"),
        F.col("_community").alias("community"),
        F.col("_support").alias("support"),
        F.col("_themes").alias("software_themes"),
    )
    return out.withColumn("scope", scope).drop("_themes", *rules)


def classify(reviews: DataFrame) -> DataFrame:
    """reviews with hits, link and scope."""
    return _scoped(_linked(_themed(with_plain(reviews)))).drop(*PLAIN)
