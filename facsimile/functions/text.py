"""Text helpers: HTML preview, code-fence stripping, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from facsimile.functions.fmt import strip

# Tag pattern, preview length and suffix of the text preview.
TAG_PATTERN = r"<[^<]+?>"
PREVIEW_CHARS = 1000
PREVIEW_SUFFIX = "..."


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, TAG_PATTERN, "")


def html_preview(c: Column, n: int = PREVIEW_CHARS) -> Column:
    """Tags removed, then the first ``n`` characters plus '...' when longer."""
    text = strip_tags(c)
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit(PREVIEW_SUFFIX))) \
        .otherwise(text)


def strip_fences(c: Column) -> Column:
    """Drop a leading ```html or ``` fence and a trailing ``` fence, then strip.

    Each test looks at the stripped text, as the source does; strip is Python's
    (all Unicode whitespace), not Spark's ``trim`` (spaces only).
    """
    s = strip(c)
    s = F.when(s.startswith("```html"), F.substring(s, F.lit(8), F.char_length(s))) \
        .when(s.startswith("```"), F.substring(s, F.lit(4), F.char_length(s))).otherwise(s)
    s = strip(s)
    s = F.when(s.endswith("```"), F.substring(s, F.lit(1), F.char_length(s) - F.lit(3))).otherwise(s)
    return strip(s)


def safe_file_name(c: Column, suffix: str = "_report.html") -> Column:
    """Spaces and slashes to underscores, then a suffix."""
    return F.concat(F.translate(c, " /", "__"), F.lit(suffix))


def synthetic_file_name(c: Column) -> Column:
    """'<name>.csv' -> '<name>_synthetic.csv' (every '.csv' is replaced, as str.replace does)."""
    return F.replace(c, F.lit(".csv"), F.lit("_synthetic.csv"))
