"""Tokens of the lexical leg as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from supportlake.functions.text import _c

_CJK = "㐀-鿿"
_WORDS = rf"[{_CJK}]+|[\p{{L}}\p{{N}}_&&[^{_CJK}]]+"


def tokenize(col: Column | str) -> Column:
    """Lower-cased words; a CJK run gives its overlapping character pairs."""
    lowered = F.lower(_c(col))
    pieces = F.regexp_extract_all(lowered, F.lit(_WORDS), F.lit(0))

    def expand(piece: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(piece) - 1), lambda i: F.substring(piece, i, F.lit(2)))
        cut = piece.rlike(f"^[{_CJK}]") & (F.length(piece) > 2)
        return F.when(cut, pairs).otherwise(F.array(piece))

    # One look at the text spares most texts a look at each of their words.
    return F.when(lowered.rlike(f"[{_CJK}]"), F.flatten(F.transform(pieces, expand))).otherwise(pieces)
