"""Explicit Spark schemas of the storefront tables (never inferred)."""

from pyspark.sql.types import (DecimalType, IntegerType, LongType, StringType, StructField,
                               StructType, TimestampNTZType)

S, L, I, TS = StringType(), LongType(), IntegerType(), TimestampNTZType()
MONEY = DecimalType(12, 2)
PRICE = DecimalType(10, 2)


def _st(*cols):
    return StructType([StructField(n, t, True) for n, t in cols])


SCHEMAS = {
    "users": _st(("id", L), ("first_name", S), ("last_name", S), ("email", S), ("provider", S),
                 ("is_admin", I)),
    "products": _st(("id", L), ("name", S), ("description", S), ("category", S), ("sub_category", S),
                    ("collection_name", S), ("metal", S), ("is_gifting", I), ("gifting_category", S),
                    ("image1", S), ("image2", S), ("image3", S), ("image4", S)),
    "product_variants": _st(("id", L), ("product_id", L), ("sku", S), ("price", PRICE), ("stock", I),
                            ("finish", S), ("gemstones_colour", S), ("length_size", S), ("width", S),
                            ("thickness", S)),
    "cart_items": _st(("id", L), ("user_id", L), ("variant_id", L), ("quantity", L), ("is_gift", I)),
    "wishlist": _st(("id", L), ("user_id", L), ("product_id", L)),
    "orders": _st(("id", L), ("order_number", S), ("user_id", L), ("status", S), ("payment_status", S),
                  ("payment_method", S), ("coupon_id", I), ("coupon_code", S), ("subtotal", MONEY),
                  ("discount", MONEY), ("grand_total", MONEY), ("created_at", TS)),
    "order_items": _st(("order_id", L), ("product_id", L), ("variant_id", L), ("product_name", S),
                       ("sku", S), ("quantity", I), ("price", MONEY), ("is_gift", I)),
    "order_addresses": _st(("order_id", L), ("type", S), ("name", S), ("phone", S), ("city", S),
                           ("state", S), ("pincode", S), ("country", S)),
    "order_status_history": _st(("id", L), ("order_id", L), ("status", S), ("changed_by", S),
                                ("comment", S), ("created_at", TS)),
    "order_payment_history": _st(("order_id", L), ("payment_status", S), ("changed_by", S),
                                 ("comment", S), ("created_at", TS)),
    "coupons": _st(("id", I), ("code", S), ("type", S), ("value", PRICE), ("min_order", PRICE),
                   ("max_discount", PRICE), ("active", I), ("start_date", TS), ("end_date", TS),
                   ("usage_limit", I), ("used_count", I)),
    "coupon_usages": _st(("coupon_id", I), ("user_id", L)),
    "reviews": _st(("id", L), ("user_id", L), ("product_id", L), ("rating", I), ("title", S),
                   ("comment", S), ("created_at", TS)),
    "newsletter_subscribers": _st(("id", L), ("email", S), ("subscribed_at", TS)),
    "contact_messages": _st(("id", L), ("name", S), ("email", S), ("phone", S), ("message", S),
                            ("status", I)),
}
