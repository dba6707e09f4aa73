"""Splitting long text into numbered pages.

A text longer than the page width is wrapped greedily: white space becomes
spaces (tabs run to the next multiple of eight), a page ends at a space, after
a hyphen inside a word or at a dash between words, and a word longer than a
page is cut, after its last hyphen there if it has one.  Spaces at a page's
ends go, but for those the text begins with (a whole page of them goes too).
A text at or below the width stays one page, verbatim.  Letters outside the
basic plane allow no page end at a hyphen next to them.  One regular expression gives all pages of a text;
pages are Spark expressions, no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_WIDTH = 1900  # fixed: message length limit of the chat platform
TAB = 8

_WORD = r"[\p{L}\p{N}_]"
_LETTER = r"[\p{L}\p{Nl}\p{No}_]"
_PUNCT = r"""[\p{L}\p{N}_!"'&.,?]"""
#: A place inside a run without spaces where a page may end.
_INNER = (rf"(?:(?:(?<={_LETTER}{_LETTER}-)|(?<={_LETTER}-{_LETTER}-))(?={_LETTER}-?{_LETTER})"
          rf"|(?<={_PUNCT})(?=-{{2,}}{_WORD})|(?<={_PUNCT}-{{2,64}})(?={_WORD}))")


def page_pattern(width: int) -> str:
    """Group 1 is a page; the spaces after it are passed over, so that the
    next match (``\\G``) begins where its page begins."""
    long = rf"(?=[^ ]{{{width + 1}}})[^ ](?:(?!{_INNER})[^ ]){{{width}}}"
    before = rf"(?:|.{{1,{width}}}?(?:(?<= )|{_INNER}))"  # up to where a long word begins
    after_hyphen = rf"{before}(?={long})-*+[^ -][^ ]{{0,{width}}}-(?<=\G.{{1,{width}}})"
    cut = rf"(?={before}{long}).{{{width}}}"
    usual = rf".{{0,{width - 1}}}[^ ](?:(?= |\z)|{_INNER})"
    has_long = rf"(?=.{{0,{width}}}[^ ]{{{width + 1}}})"
    return rf"(?s)\G(?:{has_long}({after_hyphen}|{cut})|({usual})) *"


def spaced(text: Column) -> Column:
    """``text`` with every white space character as spaces.  After a tab the
    column is a multiple of ``TAB``, so each piece between tabs is filled up
    by itself."""
    pieces = F.split(text, "\t", -1)
    column = lambda p: F.length(F.regexp_extract(p, r"[^\n\r]*\z", 0)) % TAB
    filled = F.transform(pieces, lambda p, i: F.when(i == F.size(pieces) - 1, p).otherwise(
        F.concat(p, F.repeat(F.lit(" "), F.lit(TAB) - column(p)))))
    flat = F.when(F.contains(text, F.lit("\t")), F.array_join(filled, "")).otherwise(text)
    return F.translate(flat, "\n\x0b\x0c\r", "    ")


def wrapped(text: Column, width: int = PAGE_WIDTH) -> Column:
    """The pages of ``text`` as an array; null for null, none for a long text
    of spaces."""
    pattern = page_pattern(width)
    flat = F.regexp_replace(spaced(text), rf"\A(?: {{{width}}})+", "")
    # Spaces that the text begins with stay where the first word fits behind them.
    flat = F.when(flat.rlike(rf"\A(?:{pattern})"), flat).otherwise(F.ltrim(flat))
    return F.when(F.length(text) <= width, F.array(text)).otherwise(
        F.zip_with(F.regexp_extract_all(flat, F.lit(pattern), F.lit(1)),
                   F.regexp_extract_all(flat, F.lit(pattern), F.lit(2)), lambda a, b: F.concat(a, b)))


def pages(df: DataFrame, id_col: str, text_col: str, width: int = PAGE_WIDTH) -> DataFrame:
    """``id, page, pages, text`` with ``page`` counted from 1."""
    split = df.select(id_col, wrapped(F.col(text_col), width).alias("_p"))
    return split.select(id_col, F.size("_p").alias("pages"), F.posexplode("_p").alias("_i", "text")) \
        .select(id_col, (F.col("_i") + 1).alias("page"), "pages", "text")


def page_messages(pages_df: DataFrame, mention: str) -> DataFrame:
    """``Page i/n: mention text`` for texts of several pages, and
    ``mention text`` for a single page."""
    line = F.when(F.col("pages") > 1, F.format_string("Page %d/%d: %s %s", F.col("page"), F.col("pages"),
                                                      F.lit(mention), F.col("text"))) \
        .otherwise(F.concat(F.lit(mention + " "), F.col("text")))
    return pages_df.withColumn("message", line)
