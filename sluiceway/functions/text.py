"""Word splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column | str) -> Column:
    """Lower-cased words of a text as an array.

    Separators are runs of characters outside ``[a-zA-Z0-9_]``. A separator at the start leaves
    one empty word, separators at the end leave nothing, and the empty text is one empty word.
    Spark's ``split`` keeps the empty string behind a last separator, so that one is taken off; a
    text of separators only has then just the empty word before them, which does not count either.
    """
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.lower(text), r"\W+")
    ends_open = (F.size(parts) > 1) & (F.element_at(parts, -1) == "")
    nothing = (F.size(parts) == 2) & (F.element_at(parts, 1) == "")
    return (
        F.when(~ends_open, parts)
        .when(nothing, F.array().cast("array<string>"))
        .otherwise(F.slice(parts, F.lit(1), F.size(parts) - 1))
    )
