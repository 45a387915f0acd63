"""Text functions of search and audit: folding, words, quotes, tags, link signatures."""

from __future__ import annotations

import html
import html.entities
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: fixed values: how a text cites a moment, with its frame or without; quotes; where a block begins
FRAME_TAG = r"(?U)\[\s*(\d{1,2}(?::\d{2}){1,2})\s*/\s*(f\d{3,})\s*\]"
TIME_TAG = r"(?U)\[\s*(\d{1,2}(?::\d{2}){1,2})\s*\]"
QUOTE = r"""[«"'][^«»"']{3,200}[»"']|`[^`]{3,200}`"""
WORD = r"(?U)[\w./:-]{2,}"
BLOCK = r"(?U)^\s*(?:[-*+>]\s|\d+[.)]\s|#{1,6}\s|\|)"
MARKER = r"(?U)^\s*[-*+>]\s*|^\s*\d+[.)]\s*|^#+\s*"
#: fixed values: share of a quote's words that has to be found, words below which a quote is not judged
QUOTE_SHARE, QUOTE_WORDS = 0.6, 2
#: fixed values: phrases by which a speaker points at the screen
POINTING = (
    "вот тут", "вот здесь", "вот так", "вот эта", "вот этот", "вот это",
    "смотрите", "посмотрите", "обратите внимание", "видите", "как видите",
    "вот я", "вот сюда", "нажимаю", "нажимаем", "кликаю", "вставляю", "ввожу",
    "на экране", "здесь у нас", "тут у нас", "покажу", "показываю",
    "look here", "look at", "right here", "as you can see", "you can see",
    "notice", "watch this", "over here", "on screen", "i'm clicking", "i click",
)


def folded(text: Column) -> Column:
    """Lower case, with one letter for both of a Cyrillic pair."""
    return F.replace(F.lower(text), F.lit("ё"), F.lit("е"))


def normalized(text: Column) -> Column:
    """Folded, with white space of any kind as single spaces."""
    return F.trim(F.regexp_replace(folded(text), r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """Words of two characters or more, in order, repeats included. No white space is part of a word, so it need not be made even first."""
    return F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0))


def holds(quote: Column, quote_words: Column, haystack: Column, haystack_words: Column) -> Column:
    """Whether a normalized text with its words holds a normalized quote: literally, or QUOTE_SHARE of its words.

    Words of a quote count as often as they come. An empty text holds none.
    """
    common = F.array_intersect(quote_words, haystack_words)
    # repeated as one value: named inside the lambda it would be worked out anew for each word
    hits = F.zip_with(quote_words, F.array_repeat(common, F.size(quote_words)), lambda w, known: F.array_contains(known, w))
    found = F.size(F.filter(hits, lambda h: h))
    near = (F.size(quote_words) < QUOTE_WORDS) | (found * 10 >= F.size(quote_words) * int(QUOTE_SHARE * 10))
    return haystack.contains(quote) | near


def quote_supported(quote: Column, haystack: Column) -> Column:
    """``holds`` of a quote and a text as they are; an empty or null text holds none."""
    return F.when(F.coalesce(haystack, F.lit("")) == "", False).otherwise(holds(normalized(quote), words(quote), normalized(haystack), words(haystack)))


def claim_text(line: Column) -> Column:
    """A line without its tags, one list or heading mark, and the signs around."""
    bare = F.regexp_replace(F.regexp_replace(line, FRAME_TAG, ""), TIME_TAG, "")
    return F.btrim(F.regexp_replace(bare, MARKER, ""), F.lit(" \t—–-·:"))


def quotes(text: Column) -> Column:
    """Contents of quotes in order of place."""
    return F.transform(F.regexp_extract_all(text, F.lit(QUOTE), F.lit(0)), lambda q: F.substr(q, F.lit(2), F.length(q) - 2))


def tags(line: Column) -> Column:
    """Citations of a line as structs (time, frame): first those with a frame, then the others."""
    all_of = lambda pattern, group: F.regexp_extract_all(line, F.lit(pattern), F.lit(group))
    framed = F.zip_with(all_of(FRAME_TAG, 1), all_of(FRAME_TAG, 2), lambda t, f: F.struct(t.alias("time"), f.alias("frame")))
    return F.concat(framed, F.transform(all_of(TIME_TAG, 1), lambda t: F.struct(t.alias("time"), F.lit(None).cast("string").alias("frame"))))


def points_at_screen(text: Column, phrases: tuple[str, ...] = POINTING) -> Column:
    """Whether a line holds one of the phrases."""
    return normalized(text).rlike("|".join(rf"\Q{p}\E" for p in phrases))


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Named and numbered character entities, which no built-in function knows all of."""
    return text.map(lambda t: None if t is None else html.unescape(t))


#: fixed value: a character reference that its semicolon ends
CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([A-Za-z][A-Za-z0-9]*));")


def _closed_only(text: str) -> str:
    return CLOSED.sub(lambda m: m[0] if m[1] and f"{m[1]};" not in html.entities.html5 else html.unescape(m[0]), text)


@F.pandas_udf(StringType())
def unescaped_closed(text: pd.Series) -> pd.Series:
    """As ``unescaped``, but what no semicolon ends is text."""
    return text.map(lambda t: None if t is None else _closed_only(t))


def bare_text(markup: Column, closed: bool = False) -> Column:
    """Entities first, then tags, so that escaped tags go too. With ``closed``, entities cut off before their semicolon stay as they are."""
    return F.trim(F.regexp_replace((unescaped_closed if closed else unescaped)(markup), r"<[^>]+>", ""))


def plain_escapes(text: Column) -> Column:
    r"""``\uXXXX`` as the character, where that is printable ASCII; a backslash comes last, so that it makes no new escape."""
    # fixed value: JavaScript's escape of four hexadecimal digits
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\\u([0-9a-fA-F]{4})"), F.lit(1)))
    number = lambda c: F.conv(c, 16, 10).cast("int")
    plain = F.filter(codes, lambda c: number(c).between(0x20, 0x7E))
    ordered = F.concat(F.filter(plain, lambda c: number(c) != 0x5C), F.filter(plain, lambda c: number(c) == 0x5C))
    return F.aggregate(ordered, text, lambda acc, c: F.replace(acc, F.concat(F.lit("\\u"), c), F.char(number(c))))


def link_signature(source: Column, keys: tuple[str, ...] = ("expires", "sign", "token")) -> Column:
    """``key=value`` of each signing key, the first value of it, in the order of first places."""
    # fixed value: how links and pages write a signing key; what else ended a value would give other results
    pattern = rf"(?i)\b({'|'.join(keys)})=([^&\"'\s<>]+)"
    clean = plain_escapes(F.coalesce(source, F.lit("")))
    all_of = lambda group: F.regexp_extract_all(clean, F.lit(pattern), F.lit(group))
    names = F.transform(all_of(1), lambda k: F.lower(k))
    pairs = F.zip_with(names, all_of(2), lambda k, v: F.concat(k, F.lit("="), v))
    first = F.filter(F.transform(pairs, lambda p, i: F.when(F.array_position(names, F.element_at(names, i + 1)) == i + 1, p)), lambda p: p.isNotNull())
    return F.array_join(first, "&")


def page_video_id(page: Column) -> Column:
    """The first UUID or number of six digits or more that a page's script gives as ``id``, quoted name or not; null without one."""
    # fixed value: the two ways in which players write it
    found = F.regexp_extract(F.lower(page), r"\bid\"?\s*:\s*\"([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|\d{6,})\"", 1)
    return F.when(found != "", found)


def video_id(url: Column, host: str | None = None) -> Column:
    """A UUID or a number of six digits or more that stands as a part of a link's path; null without one.

    With ``host``, links of that host and its subdomains alone count; a link without a scheme counts too.
    """
    if host is not None:
        own = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))
        url = F.when((own == host) | own.endswith("." + host), url)
    found = F.regexp_extract(F.lower(url), r"/(?:embed/)?([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|\d{6,})(?:[/?#]|$)", 1)
    return F.when(found != "", found)
