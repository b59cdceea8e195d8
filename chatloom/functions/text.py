"""Text expressions. All are native columns: nothing here leaves the JVM."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatloom.schema import MENTION_PATTERN, MENTION_TAG, URL_PATTERN, URL_TAG

# Java needs (?U) for the Unicode meaning of \w and \S.
_MENTION = "(?U)" + MENTION_PATTERN
_URL = "(?U)" + URL_PATTERN


def _literal_replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def replace_mention(message: Column, replace: str = MENTION_TAG) -> Column:
    return F.regexp_replace(message, _MENTION, _literal_replacement(replace))


def replace_url(message: Column, replace: str = URL_TAG) -> Column:
    return F.regexp_replace(message, _URL, _literal_replacement(replace))


def clean_message(message: Column) -> Column:
    """Mentions first, then URLs: ``https://h.tv/@bob`` becomes ``<url><mention>``."""
    return replace_url(replace_mention(message))


def count_mentions(message: Column) -> Column:
    return F.regexp_count(message, F.lit(_MENTION))


def count_urls(message: Column) -> Column:
    return F.regexp_count(message, F.lit(_URL))


def strip(message: Column) -> Column:
    return F.regexp_replace(message, r"(?U)^\s+|\s+$", "")


def first_word(message: Column) -> Column:
    """Lower-cased text before the first space; a leading space gives an empty word."""
    return F.split(F.lower(message), " ", 2)[0]


def count_emotes(message: Column, emotes: Sequence[str]) -> Column:
    """Matches of the emote names as one ordered alternation, without word boundaries."""
    if not emotes:
        return F.lit(0)
    pattern = "|".join(re.escape(name) for name in emotes)
    return F.regexp_count(message, F.lit(pattern))


def shorten(message: Column, size: int = 75) -> Column:
    return F.when(
        F.length(message) > size, F.concat(F.substring(message, 1, size), F.lit("..."))
    ).otherwise(message)


def preview(messages: Column, count: int = 20, size: int = 75) -> Column:
    """The first ``count`` messages of an ordered array, each cut to ``size``, joined by ``<br>``."""
    return F.array_join(F.transform(F.slice(messages, 1, count), lambda m: shorten(m, size)), "<br>")


def terms_label(terms: Column, count: int = 5) -> Column:
    return F.array_join(F.slice(terms, 1, count), " / ")


@lru_cache(maxsize=1)
def _ascii_tables() -> tuple[str, str, dict[str, str], str]:
    """Compatibility decompositions reduced to ASCII: one-letter pairs, the longer ones, their class."""
    source, target, longer, ranges = [], [], {}, []
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        folded = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            source.append(char)
            target.append(folded)
        elif len(folded) > 1:
            longer[char] = folded
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    listed = "".join(rf"\x{{{first:x}}}-\x{{{last:x}}}" for first, last in ranges)
    return "".join(source), "".join(target), longer, f"[{listed}]"


def fold_ascii(text: Column) -> Column:
    """Lower-case, then strip accents down to ASCII; what has no ASCII form is dropped."""
    source, target, longer, longer_class = _ascii_tables()
    lowered = F.lower(text)
    beyond = F.lit(r"[^\x00-\x7F]")
    # Characters that unfold to several letters (ligatures, units) are rare: looked up one by
    # one, and only in texts that hold one. The table is a single folded constant.
    table = F.from_json(F.lit(json.dumps(longer)), "map<string,string>")
    spelled = F.array_join(
        F.transform(F.split(lowered, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), ""
    )
    unfolded = F.when(F.regexp_like(lowered, F.lit(longer_class)), spelled).otherwise(lowered)
    return F.when(
        F.regexp_like(lowered, beyond), F.regexp_replace(F.translate(unfolded, source, target), beyond, F.lit(""))
    ).otherwise(lowered)


def term_words(text: Column) -> Column:
    """Words of the folded text, one-letter words kept."""
    return F.regexp_extract_all(fold_ascii(text), F.lit(r"\w+"), F.lit(0))


def without_stop_words(words: str, stop_words: Sequence[str]) -> Column:
    """The named word array without stop words. Entries a folded word can never equal are left out."""
    usable = sorted({w for w in stop_words if re.fullmatch(r"[a-z0-9_]+", w)})
    if not usable:
        return F.col(words)
    listed = ", ".join(f"'{w}'" for w in usable)
    return F.expr(f"filter(`{words}`, word -> word NOT IN ({listed}))")


def bigrams(words: Column) -> Column:
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda left, right: F.concat_ws(" ", left, right),
    )
    return F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))


def terms_of(words: Column) -> Column:
    """One- and two-word terms of a stop-word-free word array; pass a column, not a long expression."""
    return F.concat(words, bigrams(words))


def inner_tokens(tokens: Column) -> Column:
    """Without the first and last element (the sequence markers)."""
    return F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 2, F.lit(0)))


def capped_text(words: Column, shown: int = 21, limit: int = 20) -> Column:
    """Words joined by spaces; over ``limit`` words, the first ``shown`` and an ellipsis."""
    return F.when(
        F.size(words) > limit, F.concat(F.array_join(F.slice(words, 1, shown), " "), F.lit("..."))
    ).otherwise(F.array_join(words, " "))


def two_lines(text: Column, limit: int = 20) -> Column:
    """Texts over ``limit`` characters break after word ``n div 2 + 1``."""
    words = F.split(text, " ")
    cut = F.floor(F.size(words) / 2).cast("int") + 1
    broken = F.concat(
        F.array_join(F.slice(words, F.lit(1), cut), " "),
        F.lit("\n"),
        F.array_join(F.slice(words, cut + 1, F.greatest(F.size(words) - cut, F.lit(0))), " "),
    )
    return F.when(F.length(text) > limit, broken).otherwise(text)


def legend(message: Column, word: Column, word_mean: Column, terms: Sequence[tuple[Column, Column]]) -> Column:
    """Representative message and, in brackets, the dominant first word or the frequent terms."""
    frequent = [F.when((freq > 1) & (term != ""), term) for term, freq in terms]
    subject = F.when(word_mean > 0.5, word).otherwise(F.concat_ws(" / ", *frequent))
    return F.when(F.lower(subject) == F.lower(message), subject).otherwise(
        F.concat(message, F.lit(" ("), subject, F.lit(")"))
    )


def decimal_comma(value: Column) -> Column:
    return F.replace(value.cast("string"), F.lit("."), F.lit(","))


def seeded_hash(seed: int, *ids: Column) -> Column:
    """Repeatable 60-bit draw per row: no dependence on partitioning, same in any SQL engine."""
    key = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in ids])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")
