"""Display helpers of the shop as Column -> Column functions.

All are built-in Spark expressions (whole-stage codegen, no Python UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the shop's display text.
STAR_FULL = "★"
STAR_EMPTY = "☆"
GUEST = "Guest"
ANONYMOUS = "Anonymous"
ORDER_PREFIX = "ORD-"
IN_STOCK = "IN STOCK"
OUT_OF_STOCK = "OUT OF STOCK"
PAID_NOTE = "✔ Payment successful"
REFUND_NOTE = "Refund initiated. Amount will reflect in 5–7 days."
PREVIEW_CHARS = 50


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _blank_to_null(c: Column) -> Column:
    return F.when(c.cast("string") != "", c.cast("string"))


def format_price(col) -> Column:
    """H1: keep digits and dots, parse the leading number, group the integer
    part the Indian way (12,34,567), at most 3 decimals (half-up), trailing
    zeros dropped; NULL or unparsable -> "0" (a minus sign is lost)."""
    cleaned = F.regexp_replace(_c(col).cast("string"), r"[^0-9.]", "")
    num_txt = F.regexp_extract(cleaned, r"^[0-9]*(\.[0-9]*)?", 0)
    valid = num_txt.rlike(r"[0-9]")
    value = F.round(F.concat(F.lit("0"), num_txt).cast("decimal(38,10)"), 3)
    int_part = F.floor(value).cast("decimal(38,0)").cast("string")
    grouped = F.regexp_replace(int_part, r"(\d)(?=(\d\d)+\d$)", "$1,")
    frac = F.regexp_replace(
        F.lpad(((value - F.floor(value)) * 1000).cast("decimal(38,0)").cast("string"), 3, "0"),
        "0+$", "")
    text = F.when(frac == "", grouped).otherwise(F.concat(grouped, F.lit("."), frac))
    return F.when(_c(col).isNull() | ~valid, F.lit("0")).otherwise(text)


def stars(col) -> Column:
    """H2: n full stars then 5-n empty ones."""
    n = _c(col).cast("int")
    return F.concat(F.repeat(F.lit(STAR_FULL), n), F.repeat(F.lit(STAR_EMPTY), F.lit(5) - n))


def date_text(col) -> Column:
    """H3: '%d %b %Y' date text, e.g. '05 Jan 2024'."""
    return F.date_format(_c(col), "dd MMM yyyy")


def order_number(number_col="order_number", id_col="id") -> Column:
    """H4: stored order number, else 'ORD-<id>'."""
    return F.coalesce(_c(number_col), F.concat(F.lit(ORDER_PREFIX), _c(id_col).cast("string")))


def customer_name(first="first_name", last="last_name") -> Column:
    """H5: 'first last'; NULL when either part is NULL (SQL CONCAT), then 'Guest'."""
    return F.coalesce(F.concat(_c(first), F.lit(" "), _c(last)), F.lit(GUEST))


def reviewer_name(first="first_name", last="last_name", email="email") -> Column:
    """H6: full name (missing parts skipped), else the e-mail local part,
    else 'Anonymous'."""
    full = F.trim(F.concat_ws(" ", _c(first), _c(last)))
    local = F.split(_c(email), "@").getItem(0)
    return F.coalesce(F.when(full != "", full), F.when(local != "", local), F.lit(ANONYMOUS))


def variant_label(finish="finish", length="length_size") -> Column:
    """H7: 'finish / length' with blank parts dropped."""
    return F.concat_ws(" / ", _blank_to_null(_c(finish)), _blank_to_null(_c(length)))


def variant_description(finish="finish", stone="gemstones_colour", length="length_size",
                        width="width", thickness="thickness") -> Column:
    """H8: 'Finish: … | Stone: … | L: … | W: … | T: …', blank parts dropped."""
    parts = [("Finish: ", finish), ("Stone: ", stone), ("L: ", length), ("W: ", width),
             ("T: ", thickness)]
    return F.concat_ws(" | ", *[F.when(_blank_to_null(_c(c)).isNotNull(),
                                       F.concat(F.lit(p), _c(c).cast("string")))
                                for p, c in parts])


def dimension_line(is_ring_col, length="length_size", width="width", thickness="thickness") -> Column:
    """H9: 'Length: x cm | Width: y cm | Thickness: z cm'; no length for rings;
    NULL parts dropped (empty strings are kept, as in the page)."""
    def part(label, c, cond=F.lit(True)):
        return F.when(cond & _c(c).isNotNull(), F.concat(F.lit(label), _c(c).cast("string"), F.lit(" cm")))
    return F.concat_ws(" | ", part("Length: ", length, ~_c(is_ring_col)),
                       part("Width: ", width), part("Thickness: ", thickness))


def stock_label(col="stock") -> Column:
    """IN STOCK when stock > 0."""
    return F.when(_c(col) > 0, IN_STOCK).otherwise(OUT_OF_STOCK)


def message_preview(col="message", n: int = PREVIEW_CHARS) -> Column:
    """First 50 characters, '...' when longer."""
    c = _c(col)
    return F.concat(F.substring(c, 1, n), F.when(F.length(c) > n, F.lit("...")).otherwise(F.lit("")))


def html_escape(col) -> Column:
    """Escape &, < and > (NULL -> '')."""
    c = F.coalesce(_c(col).cast("string"), F.lit(""))
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def place_line(city="city", state="state", pincode="pincode") -> Column:
    """H13: 'city, state, pincode' with blank parts dropped."""
    return F.concat_ws(", ", _blank_to_null(_c(city)), _blank_to_null(_c(state)),
                       _blank_to_null(_c(pincode)))


def slug_title(col) -> Column:
    """Slug to title: dashes to spaces, first letter of each word upper."""
    words = F.split(F.regexp_replace(_c(col), "-", " "), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)),
                                                              F.substring(w, 2, 1 << 30))), " ")


def coupon_code(col) -> Column:
    """Trim and upper-case a typed coupon code."""
    return F.upper(F.trim(_c(col)))


def role_label(col="is_admin") -> Column:
    """Admin / User."""
    return F.when(F.coalesce(_c(col), F.lit(0)) != 0, "Admin").otherwise("User")


def login_label(col="provider") -> Column:
    """Login type, 'email' when none."""
    return F.coalesce(_blank_to_null(_c(col)), F.lit("email"))


def read_label(col="status") -> Column:
    """Message status 1 = Unread, else Read."""
    return F.when(_c(col) == 1, "Unread").otherwise("Read")


def payment_label(col="payment_status") -> Column:
    """Payment status with its first '_' shown as a space."""
    return F.regexp_replace(_c(col), "^([^_]*)_", "$1 ")


def at_stock_limit(qty="quantity", stock="stock") -> Column:
    """The cart line already holds all the stock."""
    return _c(qty) >= _c(stock)


def payment_note(col="payment_status") -> Column:
    """Customer-facing payment note (paid / refunded), else NULL."""
    return F.when(_c(col) == "paid", PAID_NOTE).when(_c(col) == "refunded", REFUND_NOTE)


def can_pay_now(col="payment_status") -> Column:
    """H20: 'Pay Now' is offered only for unpaid orders."""
    return F.coalesce(_c(col) == "unpaid", F.lit(False))
