"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with accents and what they fold to.
ACCENTED = "áàâãäåāéèêëēíìîïīóòôõöōúùûüūçñýÿ"
PLAIN = "aaaaaaaeeeeeiiiiioooooouuuuucnyy"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def strip_column(c: Column) -> Column:
    """Without white space (of Unicode) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fold_column(c: Column) -> Column:
    """Lower case without the accents of Latin letters, composed or decomposed."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"\p{M}+", "")


def ascii_lower(c: Column) -> Column:
    """Lower case of A to Z only."""
    return F.translate(c, UPPER, LOWER)


def like_any_case(c: Column, term: str) -> Column:
    """Whether c holds term, with A to Z in any case; % and _ in the term are wildcards."""
    return ascii_lower(c).like("%" + term.translate(str.maketrans(UPPER, LOWER)) + "%")


def token_estimate(c: Column) -> Column:
    """A quarter of the length in characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def shorten(c: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def letter_share(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / F.when(F.length(c) > 0, F.length(c))


def chunk_count(length: Column, size: int, step: int) -> Column:
    return F.when(length <= 0, 0).when(length <= size, 1).otherwise(F.ceil((length - size) / step) + 1)
