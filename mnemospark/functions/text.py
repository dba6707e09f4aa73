"""Text and name expressions (P11-P15, P21-P24) as JVM-side Column code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The instruction wrapper, message formats and the
# reserved device names of Windows file names.
INSTRUCT_PREFIX = "Instruct: "
INSTRUCT_QUERY = "\nQuery: "
DEFAULT_TASK = "Given a web search query, retrieve relevant passages that answer the query"
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL",
                  "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9",
                  "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9"]
INVALID_NAME_CHARS = r'[<>:"/\\|?*]'
DATE_IN_NAME = r"\d{4}-\d{2}-\d{2}"
PREVIEW_CHARS = 100


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instruct(query, task: str | Column = DEFAULT_TASK) -> Column:
    """The query-side instruction wrapper (documents stay plain)."""
    t = F.lit(task) if isinstance(task, str) else task
    return F.concat(F.lit(INSTRUCT_PREFIX), t, F.lit(INSTRUCT_QUERY), _c(query))


def strip_think(text) -> Column:
    """Delete every ``<think>...</think>`` span (non-greedy, across lines)."""
    return F.regexp_replace(_c(text), r"(?s)<think>.*?</think>", "")


def preview(text, n: int = PREVIEW_CHARS) -> Column:
    """The first n characters."""
    return F.substring(_c(text), 1, n)


def speaker_line(speaker, text) -> Column:
    """``speaker: text``."""
    return F.concat(_c(speaker), F.lit(": "), _c(text))


def input_reply(text, reply) -> Column:
    """``**Input**: text \\n\\n`` followed by the reply."""
    return F.concat(F.lit("**Input**: "), _c(text), F.lit(" \n\n"), _c(reply))


def page_line(i, n, mention, chunk) -> Column:
    """``Page i/n: mention chunk``."""
    return F.format_string("Page %d/%d: %s %s", _c(i), _c(n), _c(mention), _c(chunk))


def timed_text(ts, text) -> Column:
    """``yyyy-MM-dd HH:mm:ss: text``."""
    return F.concat(F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss"), F.lit(": "), _c(text))


def append_date(name, date, fmt: str = "yyyy-MM-dd") -> Column:
    """``name_<date>`` unless the name already holds a date."""
    n = _c(name)
    return F.when(n.rlike(DATE_IN_NAME), n).otherwise(F.concat_ws("_", n, F.date_format(_c(date), fmt)))


def split_extension(name) -> tuple[Column, Column]:
    """``(stem, ext)`` like ``os.path.splitext``: the last dot that is
    not part of the leading dots starts the extension."""
    n = _c(name)
    has_ext = F.regexp_replace(n, r"^\.+", "").contains(".")
    stem = F.when(has_ext, F.regexp_extract(n, r"^(.*)\.[^.]*$", 1)).otherwise(n)
    ext = F.when(has_ext, F.regexp_extract(n, r"(\.[^.]*)$", 1)).otherwise(F.lit(""))
    return stem, ext


def split_number(stem) -> tuple[Column, Column]:
    """``(base, number)`` from ``base_<digits>``; number NULL when absent."""
    s = _c(stem)
    m = s.rlike(r"_[0-9]+$")
    base = F.when(m, F.regexp_extract(s, r"^(.*)_[0-9]+$", 1)).otherwise(s)
    num = F.when(m, F.regexp_extract(s, r"_([0-9]+)$", 1).try_cast("long"))
    return base, num


def valid_file_name(name) -> Column:
    """Not empty, no trailing space or dot, stem not a reserved
    device name, none of ``< > : " / \\ | ? *``.  NULL is invalid."""
    n = _c(name)
    stem, _ = split_extension(n)
    return F.coalesce(
        (F.length(n) > 0)
        & ~n.endswith(" ") & ~n.endswith(".")
        & ~F.upper(stem).isin(RESERVED_NAMES)
        & ~n.rlike(INVALID_NAME_CHARS),
        F.lit(False))


def force_extension(name, ext: str) -> Column:
    """Trimmed name with the given extension (kept when it already
    matches, case-insensitively); NULL when the stem is not valid."""
    ext = ext.strip()
    ext = ext if ext.startswith(".") else "." + ext
    n = F.trim(_c(name))
    stem, cur = split_extension(n)
    out_ext = F.when(F.lower(cur) == F.lit(ext.lower()), cur).otherwise(F.lit(ext))
    return F.when(valid_file_name(stem), F.concat(stem, out_ext))
