"""Text columns: the contents field and the analysers that turn text into terms.

An analyser is any function ``Column(string) -> Column(array<string>)`` built
from Spark functions, so analysis stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Analyzer = Callable[[Column], Column]

# The split pattern and the classic English stop list.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
ENGLISH_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in",
    "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)


def contents(title: str = "title", text: str = "text") -> Column:
    """Title, one blank, text. A missing part is empty, the blank stays."""
    return F.concat(
        F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(text), F.lit(""))
    )


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in text order."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_SPLIT), "")


def label(analyzer: Analyzer) -> str:
    """What an index keeps of its analyser: ``analyzer.label`` if it has one, else its name."""
    return getattr(analyzer, "label", None) or f"{analyzer.__module__}.{analyzer.__qualname__}"


def without(analyzer: Analyzer, stop_words: Sequence[str]) -> Analyzer:
    """The same analyser with a short stop list taken out."""
    stops = list(stop_words)

    def stopped(text: Column) -> Column:
        return F.filter(analyzer(text), lambda term: ~term.isin(stops))

    stopped.label = f"{label(analyzer)} without {' '.join(sorted(stops))}"
    return stopped
