"""Tokenizers: column expressions from a text to an array of tokens.

A null in the result is a hole: a token that is skipped but keeps its place, as removed stop words may do.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token classes.
#: Abbreviations with dots, else words that may go on after an apostrophe. Possessive: no word is scanned twice.
PISA_PATTERN = r"[a-zA-Z]++\.[a-zA-Z]++\.(?:[a-zA-Z]++\.)*+|[a-zA-Z0-9]++(?:'[a-zA-Z]++)?+"
_IDEOGRAPH = r"\p{IsHan}\p{IsHiragana}"
_KATAKANA = r"\p{IsKatakana}ー"
_SOUTH_EAST = r"\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_RUN = rf"(?:[a-zA-Z0-9_]++|[\p{{L}}\p{{N}}\p{{M}}&&[^{_IDEOGRAPH}{_KATAKANA}{_SOUTH_EAST}]]++)++"
STANDARD_PATTERN = (
    rf"(?!_++(?![\p{{L}}\p{{N}}])){_RUN}(?:(?:(?<=[\p{{L}}\p{{M}}])['’‘.·:](?=\p{{L}})|(?<=\p{{N}})[.,;'’](?=\p{{N}})){_RUN})*+"
    rf"|[{_IDEOGRAPH}]\p{{M}}*+|[{_KATAKANA}]++|[{_SOUTH_EAST}]++"
)
JAVA_WHITE = r"[\t-\r\x1C-\x20  -  -    　]+"
CJK_RUN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}ー]"
LONGEST = 255


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def pisa(text: Column) -> Column:
    """ASCII words: abbreviations without dots, possessives and contractions cut at the apostrophe, lower-cased."""
    return F.transform(_all(text, PISA_PATTERN), lambda x: F.lower(F.substring_index(F.replace(x, F.lit("."), F.lit("")), "'", 1)))


def standard(text: Column) -> Column:
    """Unicode words, lower-cased; ideographs stand alone."""
    return F.transform(_all(text, STANDARD_PATTERN), F.lower)


def lucene_english(text: Column) -> Column:
    """Unicode words without a possessive 's."""
    return F.transform(standard(text), lambda x: F.regexp_replace(x, r"['’＇]s$", ""))


def lucene_standard(text: Column) -> Column:
    """Unicode words; those over 255 UTF-16 units leave a hole."""
    return F.transform(standard(text), lambda x: F.when(F.octet_length(F.encode(x, "UTF-16BE")) <= 2 * LONGEST, x))


def whitespace(text: Column) -> Column:
    """Runs of anything but white space, as they are; long ones in pieces of 255."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), JAVA_WHITE, -1), lambda x: x != "")
    return F.flatten(F.transform(parts, lambda x: F.when(F.length(x) <= LONGEST, F.array(x)).otherwise(F.regexp_extract_all(x, F.lit("(?s).{1,%d}" % LONGEST), F.lit(0)))))


def _width_table() -> tuple[str, str]:
    """Full-width Latin and half-width Katakana, and their common forms (by Unicode's own compatibility mapping)."""
    pairs = [(chr(c), n) for c in [*range(0xFF01, 0xFF5F), *range(0xFF66, 0xFF9E)] if len(n := unicodedata.normalize("NFKC", chr(c))) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_width(text: Column) -> Column:
    wide, common = _width_table()
    return F.translate(text, wide, common)


def cjk(text: Column) -> Column:
    """Runs of CJK characters become overlapping bigrams (a lone one stays), other words are standard."""
    words = _all(fold_width(text), rf"{CJK_RUN}+|(?:[\p{{L}}\p{{N}}_&&[^\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}\p{{IsHangul}}]]\p{{M}}*)+")
    pair = lambda run: F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
    return F.flatten(F.transform(words, lambda w: F.when(w.rlike(rf"^{CJK_RUN}{{2,}}$"), pair(w)).otherwise(F.array(F.lower(w)))))


TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "pisa": pisa,
    "standard": standard,
    "lucene-english": lucene_english,
    "lucene-standard": lucene_standard,
    "whitespace": whitespace,
    "cjk": cjk,
    "icu": standard,  # no dictionaries here, see DEGRADED: runs of South-East Asian scripts stay whole
}
#: Tokenizers that fall short of their names in languages that need a dictionary, and what they do instead.
DEGRADED = {"icu": "without a dictionary, runs of South-East Asian scripts stay whole and ideographs stand alone; register() a segmenter for better words"}


def register(name: str, tokenizer: Callable[[Column], Column]) -> None:
    """Adds a tokenizer of one's own, such as a Pandas UDF around a dictionary segmenter, under a name that analyzers may use."""
    if name.lower() != name or not name:
        raise ValueError("names of tokenizers are lower case")
    TOKENIZERS[name] = tokenizer
    DEGRADED.pop(name, None)


# Language codes and names.
LANGUAGES = {
    "ar": "arabic", "bn": "bengali", "bg": "bulgarian", "ca": "catalan", "cs": "czech", "da": "danish", "nl": "dutch", "en": "english",
    "et": "estonian", "fa": "persian", "fi": "finnish", "fr": "french", "de": "german", "el": "greek", "hi": "hindi", "hu": "hungarian",
    "id": "indonesian", "it": "italian", "ja": "japanese", "ko": "korean", "lt": "lithuanian", "no": "norwegian", "pl": "polish", "pt": "portuguese",
    "ro": "romanian", "ru": "russian", "es": "spanish", "sv": "swedish", "ta": "tamil", "te": "telugu", "th": "thai", "tr": "turkish", "zh": "chinese",
}
#: Languages whose words aren't set apart by spaces.
NEEDS_SEGMENTATION = {"chinese", "japanese", "korean", "thai", "lao", "khmer", "burmese"}


def language(name: str) -> str:
    """The full name of a language given by name or code."""
    low = name.strip().lower()
    low = low.split("-")[0].split("_")[0] if low[:2] in LANGUAGES and len(low) > 2 and not low[2].isalpha() else low
    if low in LANGUAGES:
        return LANGUAGES[low]
    if low in LANGUAGES.values() or low in NEEDS_SEGMENTATION:
        return low
    raise ValueError(f"unknown language '{name}'")


def choose(name: str | None, lang: str = "english") -> str:
    """The tokenizer's name: the given one, or the language's usual one."""
    if name is None:
        full = language(lang)
        return "cjk" if full in ("chinese", "japanese", "korean") else "icu" if full in NEEDS_SEGMENTATION else "standard"
    if name.lower() not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer '{name}', expected one of: {', '.join(TOKENIZERS)}")
    return name.lower()
