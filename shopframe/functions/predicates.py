"""Filter predicates as Column builders (catalog, search, admin lists).

Request parameters (a category, a price spec, a search text) are driver-side
literals; the predicate itself is a Catalyst expression, so simple ones reach
the parquet scan as pushed filters.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The storefront's top-level categories and gift types.
SHOP_ALL_CATEGORIES = ["men", "women", "unisex"]
GIFT_TYPES_WITH_CATEGORY = ["for-him", "for-her"]
GIFT_UNDER = ("under-1599", 1599)
GIFT_FROM = ("from-699", 699)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def eq_ci(col, value: str) -> Column:
    """Case-insensitive equality with a request value (B1)."""
    return F.lower(_c(col)) == F.lit(value.lower())


def category_filter(category: str | None = None, sub_category: str | None = None,
                    category_col="category", sub_col="sub_category") -> Column:
    """B1/B2: category and optional sub-category, both case-insensitive."""
    cond = F.lit(True)
    if category is not None:
        cond = cond & eq_ci(category_col, category)
    if sub_category:
        cond = cond & eq_ci(sub_col, sub_category)
    return cond


def collection_slug(col="collection_name") -> Column:
    """URL slug of a collection name: lower-case, spaces to dashes."""
    return F.lower(F.regexp_replace(_c(col), " ", "-"))


def shop_all_filter(col="category") -> Column:
    """The three top-level categories."""
    return F.lower(_c(col)).isin(*SHOP_ALL_CATEGORIES)


def _js_number(text: str | None) -> float | None:
    """JavaScript ``Number(text)`` for a price bound; NaN/undefined -> None
    (the SQL parameter becomes NULL and the comparison matches nothing)."""
    if text is None:
        return None
    s = text.strip()
    if s == "":
        return 0.0
    try:
        v = float(s)
    except ValueError:
        return None
    return None if math.isnan(v) else v


def parse_price_spec(spec: str | None) -> list[tuple[float | None, float | None, bool]]:
    """Parse ``"0-1000,4000+"`` into (low, high, open_ended) ranges.

    A range containing '+' is ``price >= low`` (only the first '+' removed);
    otherwise ``low-high`` is inclusive BETWEEN, a missing high bound is NULL.
    """
    if not spec:
        return []
    out = []
    for r in spec.split(","):
        if "+" in r:
            out.append((_js_number(r.replace("+", "", 1)), None, True))
        else:
            parts = r.split("-")
            lo = _js_number(parts[0])
            hi = _js_number(parts[1]) if len(parts) > 1 else None
            out.append((lo, hi, False))
    return out


def price_filter(spec: str | None, col="price") -> Column:
    """OR of inclusive ranges over the variant price; empty spec = no filter."""
    ranges = parse_price_spec(spec)
    if not ranges:
        return F.lit(True)
    price = _c(col)
    conds = []
    for lo, hi, open_ended in ranges:
        lo_l = F.lit(lo).cast("decimal(20,4)")
        if open_ended:
            conds.append(price >= lo_l)
        else:
            conds.append(price.between(lo_l, F.lit(hi).cast("decimal(20,4)")))
    # NULL (unknown) is not a match; coalesce so the predicate is two-valued.
    return F.coalesce(reduce(lambda a, b: a | b, conds), F.lit(False))


def finish_filter(spec: str | None, col="finish") -> Column:
    """Comma list of finishes, case-insensitive exact match."""
    if not spec:
        return F.lit(True)
    values = [f.lower() for f in spec.split(",")]
    return F.coalesce(F.lower(_c(col)).isin(*values), F.lit(False))


def gift_filter(gift_type: str | None) -> Column:
    """Gift products; for-him / for-her also match the gifting category.
    Any other type (including unknown ones) adds no extra predicate."""
    cond = F.col("is_gifting") == 1
    if gift_type in GIFT_TYPES_WITH_CATEGORY:
        cond = cond & eq_ci("gifting_category", gift_type)
    return cond


def gift_having(gift_type: str | None, price_col="price") -> Column:
    """D3: HAVING on the aggregated minimum price."""
    if gift_type == GIFT_UNDER[0]:
        return F.col(price_col) <= F.lit(GIFT_UNDER[1])
    if gift_type == GIFT_FROM[0]:
        return F.col(price_col) >= F.lit(GIFT_FROM[1])
    return F.lit(True)


def contains_ci(cols, text: str) -> Column:
    """Case-insensitive LIKE '%text%' over any of ``cols`` (user wildcards kept)."""
    pat = f"%{text}%"
    return F.coalesce(reduce(lambda a, b: a | b, [_c(c).ilike(pat) for c in cols]), F.lit(False))


def search_text(q: str | None) -> str | None:
    """Trimmed query; shorter than 2 characters means 'no search'."""
    if q is None:
        return None
    q = q.strip()
    return q if len(q) >= 2 else None


def admin_text_search(cols, q: str | None) -> Column:
    """Browser-side admin search: lower-cased haystack of the joined
    fields contains the lower-cased query; empty query matches everything."""
    if not q:
        return F.lit(True)
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols]))
    return hay.contains(q.lower())


def any_contains_ci(cols, q: str | None) -> Column:
    """OR of per-field lower-case contains; empty query matches all."""
    if not q:
        return F.lit(True)
    ql = q.lower()
    return F.coalesce(
        reduce(lambda a, b: a | b, [F.lower(_c(c)).contains(ql) for c in cols]), F.lit(False))


def sanitize_filter_value(values) -> str:
    """Keep only ``[A-Za-z0-9,+-]`` of each value, join by comma."""
    if isinstance(values, str):
        values = [values]
    return ",".join(re.sub(r"[^A-Za-z0-9,+\-]", "", v) for v in values)


def sanitize_filter_col(col) -> Column:
    """B20 as a column expression (for a table of logged filter requests)."""
    return F.regexp_replace(_c(col), r"[^A-Za-z0-9,+\-]", "")


def is_ring(col="sub_category") -> Column:
    """Sub-category contains 'ring' (so 'earrings' is a ring too)."""
    return F.coalesce(F.lower(_c(col)).contains("ring"), F.lit(False))


def out_of_stock(col="stock") -> Column:
    """Stock exactly zero."""
    return _c(col) == 0


def non_blank(col) -> Column:
    return _c(col).isNotNull() & (F.trim(_c(col).cast("string")) != "")


def images_list(cols=("image1", "image2", "image3", "image4")) -> Column:
    """Non-empty image names, order kept."""
    return F.filter(F.array(*[_c(c) for c in cols]), lambda x: x.isNotNull() & (x != ""))
