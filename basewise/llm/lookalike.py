"""One consistent form for texts that look the same.

The form replaces full-width by ordinary characters, every blank as wide as a character by a
space, and Cyrillic and Greek letters drawn like a Latin letter by that letter, removes
characters without width, and composes accents (NFC). Case, accents, the number of blanks,
tabs and line ends stay.

Only unstable segments are normalised. A character is unstable if it doesn't pass the quick
check of NFC (its property is No or Maybe), has a combining class, or is, or decomposes to, a
character of the tables below. A segment is a run of such characters with its boundary
context, the character before it: that one is a starter which what follows may compose with.
No context is needed behind, as a character that passes the quick check and has no combining
class never composes with what stands before it. Canonical segments are spliced into the
unchanged text. A text in ASCII has none and never leaves the JVM; one without unstable
characters is never normalised, nor is the rest of any other.

Lower-case nu is not folded to v: it is the lower case of a letter drawn like N, so n and v
would become one where case doesn't count.

Null stays null, an empty text stays empty.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basewise.session import cut_lineage

# Letters of other scripts drawn like a Latin letter.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХаеѕіјорсухһԁԛԝ", "ABESIJKMHOPCTXaesijopcyxhdqw")) | dict(zip("УҮѴѵԚԜ", "YYVvQW"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo")) | dict(zip("ϹϲͿϳ", "CcJj"))
# Blanks of one character, by code point.
BLANKS = [0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
# Characters without width, by code point.
WIDTHLESS = [0x00AD, 0x034F, 0x061C, *range(0x180B, 0x1810), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF, *range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0)]


_TABLE = (
    {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    | dict(zip(range(0xFFE0, 0xFFE7), "¢£¬¯¦¥₩"))
    | {ord(a): b for a, b in (CYRILLIC | GREEK).items()}
    | dict.fromkeys(BLANKS, " ")
    | dict.fromkeys(WIDTHLESS)
)
#: Longer segments aren't kept in the memory of results.
_REMEMBERED = 64
#: No code point from here on, nor any of the planes 4 to 13, is named by Unicode's normal forms or the tables.
_SEARCHED = [*range(0x80, 0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200)]


_BEYOND_BMP = re.compile("[\U00010000-\U0010ffff]")


@functools.cache
def _unstable_run(beyond_bmp: bool = True) -> re.Pattern:
    """A run of unstable characters, from the properties of all code points; those of the basic plane alone are looked up faster."""
    unstable = set(_TABLE)
    for c in _SEARCHED:
        x = chr(c)
        parts = unicodedata.normalize("NFD", x)
        if unicodedata.combining(x) or not _TABLE.keys().isdisjoint(map(ord, parts)):
            unstable.add(c)
        elif parts != x:
            if unicodedata.normalize("NFC", parts) != x:
                unstable.add(c)  # quick check: No
            else:
                # what a pair composes with behind its first part: Maybe; a pair's first part is one character or composes in turn
                unstable.add(ord(parts[-1]))
    unstable = {c for c in unstable if c >= 0x80 and (beyond_bmp or c < 0x10000)}
    edges = sorted(unstable)
    first = [c for c in edges if c - 1 not in unstable]
    last = [c for c in edges if c + 1 not in unstable]
    return re.compile("[" + "".join(rf"\U{a:08x}-\U{z:08x}" for a, z in zip(first, last)) + "]+")


def _canonical_segment(segment: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", segment).translate(_TABLE))


_remembered_segment = functools.lru_cache(maxsize=1 << 16)(_canonical_segment)


def canonical(text: str | None) -> str | None:
    """The consistent form of one text."""
    if text is None or text.isascii():
        return text
    out, done = [], 0
    for m in _unstable_run(_BEYOND_BMP.search(text) is not None).finditer(text):
        start, end = m.span()
        start -= start > done  # the starter before the run, which it may compose with
        out.append(text[done:start])
        segment = text[start:end]
        out.append(_remembered_segment(segment) if end - start <= _REMEMBERED else _canonical_segment(segment))
        done = end
    out.append(text[done:])
    return "".join(out)


@F.pandas_udf(T.StringType())
def _canonical_udf(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


def canonical_column(text: str) -> Column:
    """``canonical`` as a column. ASCII texts are passed by; Python gets only the others."""
    c = F.col(text)
    other = F.when(c.rlike(r"[^\x00-\x7F]"), c)
    return F.coalesce(_canonical_udf(other), c)


def canonical_texts(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_column, canonical``: the consistent form of every text, null and empty ones included."""
    return documents.select(id_column, canonical_column(text).alias("canonical"))


def lookalike_classes(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``look, spelling, id_column`` of every text that isn't null or empty.

    Texts of one ``look`` (digest of the consistent form) look the same; those of one
    ``spelling`` (digest of the text) are the same. Digests, not texts, are shuffled.
    """
    d = documents.where(F.length(text) > 0)
    return d.select(
        F.unhex(F.md5(canonical_column(text).cast("binary"))).alias("look"),
        F.unhex(F.md5(F.col(text).cast("binary"))).alias("spelling"),
        id_column,
    )


def lookalike_pairs(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``{id}_a, {id}_b``, the smaller first: documents whose texts differ but look the same.

    Looks with a single spelling, however often it is copied, leave before anything is joined;
    they are found on counts combined before the shuffle. Spellings are paired first and only
    then joined with their documents, so copies of one text are never compared with each other.
    A document id that is repeated gives its pairs once.
    """
    # three steps read the digests; the documents are read once
    members = cut_lineage(lookalike_classes(documents, id_column, text))
    spellings = members.groupBy("look", "spelling").count().select("look", "spelling")
    several = spellings.groupBy("look").agg(F.count("*").alias("n")).where("n > 1").select("look")
    kept = spellings.join(several, "look")
    a, b = (kept.select("look", F.col("spelling").alias(f"spelling_{x}")) for x in "ab")
    pairs = a.join(b, "look").where("spelling_a < spelling_b")
    docs = members.join(several, "look", "left_semi").select("spelling", F.col(id_column).alias("_id"))
    left, right = (docs.select(F.col("spelling").alias(f"spelling_{x}"), F.col("_id").alias(f"_{x}")) for x in "ab")
    both = pairs.join(left, "spelling_a").join(right, "spelling_b").where("_a <> _b")
    return both.select(F.least("_a", "_b").alias(f"{id_column}_a"), F.greatest("_a", "_b").alias(f"{id_column}_b")).distinct()
