"""Column functions on text: tokens, token cost, line parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that queries leave out (fixed values).
STOPWORDS = "a an and are as at be by for from how in is it of on or that the to with".split()

#: Combining marks that belong to a word and go from it (fixed values, as ranges of a pattern).
MARKS = r"\u0300-\u0304\u0306-\u030c\u030f\u0311\u031b\u0323-\u0328\u032d\u032e\u0330\u0331"
#: A word: it begins with a letter or digit.
WORD = rf"[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}{MARKS}]*"
_PAIRS: dict[str, str] = {}


def _fold_table() -> tuple[str, str]:
    """Letters in lower case and what they fold to, over all of Unicode, then the marks that go.

    Letters that are an ASCII letter with marks lose these, others keep theirs; variants of a letter in lower case (a final sigma, a long s) become the letter.
    """
    import re
    import sys
    import unicodedata

    if not _PAIRS:
        for c in map(chr, range(0x80, sys.maxunicode + 1)):
            if c != c.lower() or not c.isalpha():
                continue
            other = c.casefold()
            base, *marks = unicodedata.normalize("NFD", other)
            if marks and base.isascii() and all(unicodedata.category(m) == "Mn" for m in marks):
                other = base
            if len(other) == 1 and other != c:
                _PAIRS[c] = other
    gone = re.findall(f"[{MARKS}]", "".join(map(chr, range(0x300, 0x370))))
    return "".join(_PAIRS) + "".join(gone), "".join(_PAIRS.values())


def fold(text: Column) -> Column:
    """Lower case without the accents of Latin letters; texts without other bytes than ASCII are only lowered."""
    low = F.lower(text)
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, *_fold_table()))


def tokens(text: Column) -> Column:
    """Runs of letters and digits with their marks, folded; ``_`` separates. Null has none. Folding is for the tokens that need it, not for whole texts."""
    low = F.lower(text)
    plain = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    other = F.transform(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), fold)
    return F.coalesce(F.when(F.octet_length(low) == F.length(low), plain).otherwise(other), F.array().cast("array<string>"))


def token_count(text: Column) -> Column:
    """How many tokens a text has."""
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(WORD)), F.lit(0)).cast("long")


def query_words(text: str) -> list[list[str]]:
    """The words of a query as lists of terms: a word with ``_`` or quotes inside is a phrase of several terms."""
    import re

    words = [w for w in re.findall(rf"[\w\"{MARKS}]+", text.lower()) if w not in STOPWORDS]
    return [terms for terms in map(_terms, words) if terms]


def _terms(word: str) -> list[str]:
    """The same folding as of texts."""
    import re

    source, target = _fold_table()
    table = str.maketrans(source[: len(target)], target, source[len(target) :])
    return [t.translate(table) for t in re.findall(rf"[^\W_][^\W_{MARKS}]*(?:[{MARKS}]+[^\W_]*)*", word)]


def query_terms(text: str) -> list[str]:
    """Terms of a query in order, with repeats, without stopwords."""
    return [term for word in query_words(text) for term in word]


def token_cost(text: Column) -> Column:
    """Estimated tokens of a text: a quarter of its bytes, at least one."""
    return F.greatest(F.lit(1), F.floor(F.octet_length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def character_cost(text: Column) -> Column:
    """Estimated tokens of a text by its characters: a quarter of them, at least one."""
    return F.greatest(F.lit(1), F.floor(F.char_length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def glob_regex(pattern: str) -> str:
    """A regular expression for a path glob: ``*`` and ``?`` stop at ``/``, ``**`` does not; relative patterns match at any depth."""
    import re

    if pattern.count("[") != pattern.count("]") or pattern.count("{") != pattern.count("}"):
        raise ValueError(f"invalid filter: {pattern}")
    text, out, i, depth = pattern if pattern.startswith("/") else "**/" + pattern, "", 0, 0
    while i < len(text):
        c = text[i]
        if text.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if text.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}":
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "[":
            end = text.index("]", i)
            out, i = out + text[i : end + 1].replace("[!", "[^"), end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"
