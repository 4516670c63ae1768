"""Text columns: lines, trimming, tokens, sizes."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

NEWLINE = "\n"


def lines(text: Column) -> Column:
    """The lines of a text: split at \\n, one trailing \\r dropped from each, no empty last line."""
    parts = F.split(F.coalesce(text, F.lit("")), NEWLINE, -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(kept, lambda x: F.when(x.endswith("\r"), F.left(x, F.length(x) - 1)).otherwise(x))


def trimmed(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def _folds() -> tuple[str, str]:
    """Letters with diacritics of the Latin, Greek and Cyrillic blocks and what they are without, by their decompositions."""
    pairs = []
    for c in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        base = "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))
        if len(base) == 1 and base != chr(c):
            pairs.append((chr(c), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folds()


def once(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used; projections of their own may be merged again."""
    return F.transform(F.array(value), use)[0]


def folded(text: Column) -> Column:
    """Lower case without diacritics. ASCII texts, known by their length, have none."""
    plain = lambda t: F.regexp_replace(F.translate(F.lower(t), ACCENTED, PLAIN), r"\p{Mn}+", "")
    return once(text, lambda t: F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(plain(t)))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded, in order."""
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def format_bytes(n: Column) -> Column:
    """B, KB, MB or GB on base 1024; one decimal from KB on, exact ties to the even digit."""
    kb, mb, gb = 1024, 1024**2, 1024**3
    scaled = lambda unit, name: F.format_string(f"%.1f {name}", F.bround(n / F.lit(float(unit)), 1))
    return F.when(n >= gb, scaled(gb, "GB")).when(n >= mb, scaled(mb, "MB")).when(n >= kb, scaled(kb, "KB")).otherwise(F.format_string("%d B", n.cast("long")))


def like_escaped(pattern: str) -> str:
    """A LIKE pattern that matches the text literally, anywhere."""
    for c in ("\\", "%", "_"):
        pattern = pattern.replace(c, "\\" + c)
    return f"%{pattern}%"
