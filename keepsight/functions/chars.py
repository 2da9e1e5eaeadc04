"""Character classes spelled out, so a pattern means the same in every regex dialect.

Java makes ``\\b`` Unicode-aware and keeps ``\\s`` ASCII; other dialects choose
differently. Every pattern in this package uses these classes instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space characters of the text format being matched.
WHITESPACE = (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
WORD = "A-Za-z0-9_"

SPACE_CLASS = f"[{WHITESPACE}]"
NON_SPACE_CLASS = f"[^{WHITESPACE}]"

# ASCII word boundary. WORD_START is the short form for a pattern whose next
# character is known to be a word character.
BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
WORD_START = f"(?<![{WORD}])"


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only U+0020 as ``trim`` does."""
    return F.regexp_replace(text, rf"\A{SPACE_CLASS}+|{SPACE_CLASS}+\z", "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` mentions it.

    A fold over no elements that ends in ``use``. An element taken out of an array would have
    Spark work out the type of all that ``use`` says anew in every row.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, use)
