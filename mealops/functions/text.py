"""Address, phone and scraped-block cleaning with Java-regex expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import as_col

__all__ = ["split_to", "suffix", "normalise_address", "split_phones", "parse_details",
           "strip_label", "norm_edit_distance", "match_rule", "coord_key", "split_coords",
           "coalesce_blank"]


def split_to(df: DataFrame, col: str, names: list[str], pattern: str | None = None,
             positions: list[int] | None = None, merge_tail: bool = False) -> DataFrame:
    """Split one column into named columns.

    By regex (missing pieces NULL, surplus dropped, or kept in the last column with
    ``merge_tail``) or by character positions (each the last index of its piece).
    """
    if (pattern is None) == (positions is None):
        raise ValueError("give exactly one of pattern and positions")
    if pattern is not None:
        parts = F.split(F.col(col), pattern, len(names) if merge_tail else -1)
        return df.withColumns({n: F.get(parts, F.lit(i)) for i, n in enumerate(names)})
    edges = [0, *positions]
    if len(names) != len(edges):
        raise ValueError("positions must be one fewer than names")
    pieces = {}
    for i, name in enumerate(names):
        stop = positions[i] if i < len(positions) else 2 ** 31 - 1
        pieces[name] = F.nullif(F.substring(F.col(col), edges[i] + 1, stop - edges[i]), F.lit(""))
    return df.withColumns(pieces)


def suffix(c: str | Column, n: int) -> Column:
    return F.right(as_col(c), F.lit(n))


def normalise_address(c: str | Column) -> tuple[Column, Column]:
    """(address, supplement): the text before the first opening bracket loses a trailing
    floor mark (one digit or 一二三四 before 楼) and then a trailing run of ``B``/``-``;
    the supplement is the text between the first and the second opening bracket."""
    pieces = F.split(as_col(c), "[(（]")
    head = F.get(pieces, F.lit(0))
    floor = head.rlike("[0-9一二三四]楼$")
    bare = F.regexp_replace(head, "[0-9一二三四]楼$", "")
    return (F.when(floor, F.regexp_replace(bare, "[B-]+$", "")).otherwise(head),
            F.get(pieces, F.lit(1)))


def split_phones(df: DataFrame, col: str) -> DataFrame:
    """Up to three numbers; ``转`` introduces an extension of the first two. A third number
    holding characters that do not belong in one loses the text around its first digits."""
    parts = F.split(F.col(col), "[, —]")
    first = F.split(F.get(parts, F.lit(0)), "转")
    second = F.split(F.get(parts, F.lit(1)), "转")
    third = F.get(parts, F.lit(2))
    odd = third.rlike("[^0-9()E-]")
    return df.withColumns({
        "tel1": F.get(first, F.lit(0)), "int1": F.get(first, F.lit(1)),
        "tel2": F.get(second, F.lit(0)), "int2": F.get(second, F.lit(1)),
        "tel3": F.when(odd, F.regexp_replace(third, "^[^0-9]*([0-9]+)[^0-9]*", "$1")).otherwise(third),
    })


# Field order of a scraped restaurant block, one field per line.
DETAIL_FIELDS = ["name", "d1", "tags", "d2", "from_addr_xms", "d3", "avgexp",
                 "taste", "envir", "service", "d7", "comment", "remarks"]
DETAIL_FILLER = ["d1", "d2", "d3", "d7"]


def parse_details(df: DataFrame, col: str = "details") -> DataFrame:
    """Scraped restaurant block to typed columns; blocks without a taste score are dropped.
    Surplus lines stay in the last field."""
    cleaned = df.withColumn(col, F.regexp_replace(F.col(col), "\n详情\n标签:", "\n标签:"))
    out = split_to(cleaned, col, DETAIL_FIELDS, pattern="\n", merge_tail=True).drop(*DETAIL_FILLER)
    spend = F.split(F.col("avgexp"), "-")
    number = lambda c: F.trim(c).try_cast("double")
    return (out.filter(F.col("taste").isNotNull())
            .withColumns({
                "avgexp_lo": number(F.regexp_replace(F.get(spend, F.lit(0)), "^¥", "")),
                "avgexp_up": number(F.get(spend, F.lit(1))),
                "taste": number(strip_label("taste", "^.*:")),
                "envir": number(strip_label("envir", "^.*:")),
                "service": number(strip_label("service", "^.*:")),
            }).drop("avgexp"))


def strip_label(c: str | Column, pattern: str) -> Column:
    return F.trim(F.regexp_replace(as_col(c), pattern, ""))


def norm_edit_distance(a: str | Column, b: str | Column) -> tuple[Column, Column]:
    """Edit distance over the longer and over the shorter text (NULL if one is empty)."""
    x, y = as_col(a), as_col(b)
    d = F.levenshtein(x, y).cast("double")
    lx, ly = F.length(x), F.length(y)
    return F.try_divide(d, F.greatest(lx, ly)), F.try_divide(d, F.least(lx, ly))


def match_rule(long: str | Column, short: str | Column) -> Column:
    """0 when the texts clearly differ, else 1 (a missing distance does not reject)."""
    return F.when((as_col(long) > 0.7) & (as_col(short) >= 1), F.lit(0)).otherwise(F.lit(1))


def coord_key(lat: str | Column, lon: str | Column) -> Column:
    return F.concat(as_col(lat).cast("string"), F.lit(","), as_col(lon).cast("string"))


def split_coords(df: DataFrame, col: str, lat: str, lon: str) -> DataFrame:
    parts = F.split(F.col(col), ",")
    return df.withColumns({lat: F.get(parts, F.lit(0)).try_cast("double"),
                           lon: F.get(parts, F.lit(1)).try_cast("double")})


def coalesce_blank(a: str | Column, b: str | Column) -> Column:
    """Second column where the first is the empty text; NULL stays NULL."""
    return F.when(as_col(a) == "", as_col(b)).otherwise(as_col(a))
