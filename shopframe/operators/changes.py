"""Change application: each write of the shop becomes a batch
operator ``(current table(s), requested changes) -> (new table, outcomes)``.

Core moves are joins on the key, conditional columns and unions; no
row-at-a-time driver loop. Where the original's result depends on the order
of requests for one key (cart commands), the fold runs per key in request
order (``shopframe.operators.cart_fold``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .addresses import take_addresses


def email_taken(users: DataFrame, requests: DataFrame, id_col: str = "user_id") -> DataFrame:
    """Requests whose e-mail (case-insensitive) belongs to another
    user. Users are first reduced to one row per e-mail (holder count and
    lowest id), so a request meets one row however many users share the
    address: taken when two or more users hold it, or one user who is not
    the requester."""
    holders = users.groupBy(F.lower("email").alias("_e")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("id").alias("_one"))
    r = requests.withColumn("_e", F.lower("email"))
    return (r.join(holders, "_e", "inner")
            .where((F.col("_n") > 1) | (F.col("_one") != F.col(id_col)))
            .select(*requests.columns))


# --------------------------------------------------------------- helpers ----

def _first_per_key(df: DataFrame, keys, order_col: str = "seq") -> DataFrame:
    """Flag the first request per key (lowest ``order_col``). The flag is a
    grouped min joined back (partial aggregation), not a window, so a key with
    very many requests is one partial row per map task."""
    firsts = df.groupBy(*keys).agg(F.min(order_col).alias("_first_seq"))
    return (df.join(firsts, keys, "left")
            .withColumn("_is_first", F.col(order_col) == F.col("_first_seq")).drop("_first_seq"))


def _last_per_key(df: DataFrame, key: str, order_col: str = "seq") -> DataFrame:
    """The latest request per key (max ``order_col``) via max_by on a struct."""
    cols = [c for c in df.columns]
    return (df.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order_col)).alias("_r"))
            .select("_r.*"))


def _id_base(df: DataFrame, id_col: str = "id"):
    """max(existing id) as a scalar subquery (one value, no join); new rows get
    ``base + seq`` so ids stay unique without a global row number."""
    return df.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_b")).scalar()


def _js_truthy(c) -> F.Column:
    return F.coalesce(c.isNotNull() & (c.cast("string") != ""), F.lit(False))


def _js_trim_truthy(c) -> F.Column:
    return F.coalesce(c.isNotNull() & (F.trim(c.cast("string")) != ""), F.lit(False))


# ------------------------------------------------------------- wishlist -----

def wishlist_from_counts(wishlist: DataFrame, counts: DataFrame) -> DataFrame:
    """G4/S2 core: (user_id, product_id, n toggles, last seq) -> new wishlist.
    Final membership = stored XOR (n odd); a line (re)inserted by the batch
    was inserted by the key's last toggle and gets ``base + last seq``."""
    cur = wishlist.select("id", "user_id", "product_id")
    base = _id_base(wishlist)
    j = cur.join(counts, ["user_id", "product_id"], "full_outer")
    n = F.coalesce(F.col("_n"), F.lit(0))
    present_after = F.col("id").isNotNull() != ((n % 2) == 1)
    return (j.where(present_after)
            .select(F.when(n == 0, F.col("id")).otherwise(base + F.col("_last")).alias("id"),
                    "user_id", "product_id"))


def toggle_wishlist(wishlist: DataFrame, toggles: DataFrame):
    """Each toggle (seq, user_id, product_id) flips membership. The new
    table comes from per-key counts (partial aggregation); outcomes say
    'added' or 'removed' per toggle from its position within the key (a
    window per key, sorted with spilling). Returns ``(new_wishlist, outcomes)``."""
    from .paging import number_rows
    counts = toggles.groupBy("user_id", "product_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max("seq").alias("_last"))
    new = wishlist_from_counts(wishlist, counts)
    before = wishlist.select("user_id", "product_id", F.lit(True).alias("_had")).distinct()
    # Position of each toggle within its key: skew-safe numbering (a hot key
    # is split over range partitions), not a one-task window.
    numbered = number_rows(toggles.select("seq", "user_id", "product_id"), [F.col("seq").asc()],
                           ["user_id", "product_id"]).withColumnRenamed("position", "_k")
    outcomes = (numbered.join(before, ["user_id", "product_id"], "left")
                .withColumn("action", F.when(
                    F.coalesce(F.col("_had"), F.lit(False)) != ((F.col("_k") % 2) == 0),
                    F.lit("removed")).otherwise(F.lit("added")))
                .select("seq", "user_id", "product_id", "action"))
    return new, outcomes


# ------------------------------------------------------------ newsletter ----

def subscribe(subscribers: DataFrame, requests: DataFrame, now):
    """Subscribe requests (seq, email) at ``now``. Rejected: empty e-mail
    ('email_required'), e-mail already subscribed (case-insensitive) or asked
    earlier in the batch ('already_subscribed'). Returns
    ``(new_subscribers, outcomes)``."""
    existing = subscribers.select(F.lower("email").alias("_e")).distinct().withColumn("_exists", F.lit(True))
    r = _first_per_key(requests.withColumn("_e", F.lower("email")), ["_e"])
    r = r.join(existing, "_e", "left")
    reason = (F.when(~_js_truthy(F.col("email")), "email_required")
              .when(F.col("_exists").isNotNull() | ~F.col("_is_first"), "already_subscribed"))
    out = r.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
    base = _id_base(subscribers)
    added = out.where("accepted").select((base + F.col("seq")).alias("id"), "email",
                                         now.alias("subscribed_at"))
    new = subscribers.select("id", "email", "subscribed_at").unionByName(added)
    return new, out.select("seq", "email", "accepted", "reason")


def unsubscribe(subscribers: DataFrame, ids: DataFrame) -> DataFrame:
    """Delete subscribers by id."""
    return subscribers.join(ids.select(F.col("id")), "id", "left_anti")


# --------------------------------------------------------------- reviews ----

def submit_reviews(reviews: DataFrame, submissions: DataFrame, paid_pairs: DataFrame, now):
    """Review submissions (seq, user_id, product_id, title, rating,
    comment) at ``now`` need a paid purchase of the product ('purchase') and no
    review of that (user, product) yet, stored or earlier in the batch
    ('already_reviewed'). Returns ``(new_reviews, outcomes)``."""
    bought = paid_pairs.select("user_id", "product_id").distinct().withColumn("_b", F.lit(True))
    had = reviews.select("user_id", "product_id").distinct().withColumn("_h", F.lit(True))
    s = (_first_per_key(submissions, ["user_id", "product_id"])
         .join(bought, ["user_id", "product_id"], "left").join(had, ["user_id", "product_id"], "left"))
    reason = (F.when(F.col("_b").isNull(), "purchase")
              .when(F.col("_h").isNotNull() | ~F.col("_is_first"), "already_reviewed"))
    out = s.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
    base = _id_base(reviews)
    added = out.where("accepted").select(
        (base + F.col("seq")).alias("id"), "user_id", "product_id",
        F.col("rating").cast("int").alias("rating"), "title", "comment", now.alias("created_at"))
    new = reviews.select("id", "user_id", "product_id", "rating", "title", "comment",
                         "created_at").unionByName(added)
    return new, out.select("seq", "user_id", "product_id", "accepted", "reason")


def edit_reviews(reviews: DataFrame, requests: DataFrame, admin: bool = False):
    """Update / delete requests (seq, review_id, user_id, op, rating,
    title, comment). A customer may only touch their own review (C19); the
    admin path skips that check. Requests apply in ``seq`` order: the last
    update stands, and after a delete the review is 'not_found'. Returns
    ``(new_reviews, outcomes)``."""
    r = requests
    if not admin:
        own = reviews.select(F.col("id").alias("review_id"), "user_id").withColumn("_own", F.lit(True))
        r = r.join(own, ["review_id", "user_id"], "left")
        ok = F.col("_own").isNotNull()
    else:
        exists = reviews.select(F.col("id").alias("review_id")).withColumn("_own", F.lit(True))
        r = r.join(exists, ["review_id"], "left")
        ok = F.col("_own").isNotNull()
    deleted = (r.where(ok & (F.col("op") == "delete")).groupBy("review_id")
               .agg(F.min("seq").alias("_deleted")))
    r = r.join(deleted, "review_id", "left")
    ok = ok & ~F.coalesce(F.col("seq") > F.col("_deleted"), F.lit(False))
    outcomes = r.select("seq", "review_id", "user_id", "op", ok.alias("accepted"),
                        F.when(~ok, "not_found").alias("reason"))
    good = r.where(ok).drop("_own", "_deleted")
    last = _last_per_key(good, "review_id")
    cur = reviews.alias("c")
    j = cur.join(last.alias("u"), F.col("c.id") == F.col("u.review_id"), "left")
    keep = j.where(F.col("u.op").isNull() | (F.col("u.op") != "delete"))
    upd = F.col("u.op") == "update"
    new = keep.select(
        F.col("c.id").alias("id"), F.col("c.user_id").alias("user_id"), F.col("c.product_id").alias("product_id"),
        F.when(upd, F.col("u.rating")).otherwise(F.col("c.rating")).cast("int").alias("rating"),
        F.when(upd, F.col("u.title")).otherwise(F.col("c.title")).alias("title"),
        F.when(upd, F.col("u.comment")).otherwise(F.col("c.comment")).alias("comment"),
        F.col("c.created_at").alias("created_at"))
    return new, outcomes


# ----------------------------------------------------------------- users ----

def register_users(users: DataFrame, requests: DataFrame, check_email: bool = True,
                   trim_check: bool = True):
    """Registrations (seq, first_name, last_name, email[, provider]).
    Self-service sign-up needs non-blank fields ('missing_fields') and an
    unused e-mail, case-insensitive, stored or of an earlier valid request of
    the batch ('email_taken'); the admin create path (``check_email=False``)
    does not check the e-mail and takes ``is_admin`` from the request. Passwords
    never enter a DataFrame. Returns ``(new_users, outcomes)``."""
    truthy = _js_trim_truthy if trim_check else _js_truthy
    fields_ok = truthy(F.col("first_name")) & truthy(F.col("last_name")) & truthy(F.col("email"))
    # Requests without the fields hold no e-mail: they have no key.
    req = requests.withColumn("_e", F.when(fields_ok, F.lower("email")))
    if check_email:
        taken = users.select(F.lower("email").alias("_e")).distinct().withColumn("_t", F.lit(True))
        firsts = req.where(F.col("_e").isNotNull()).groupBy("_e").agg(F.min("seq").alias("_first_seq"))
        req = req.join(firsts, "_e", "left").join(taken, "_e", "left")
        dup = F.col("_t").isNotNull() | (F.col("seq") != F.col("_first_seq"))
    else:
        dup = F.lit(False)
    reason = F.when(~fields_ok, "missing_fields").when(dup, "email_taken")
    out = req.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
    base = _id_base(users)
    prov = F.col("provider") if "provider" in requests.columns else F.lit(None).cast("string")
    admin = F.coalesce(F.col("is_admin").cast("int"), F.lit(0)) \
        if not check_email and "is_admin" in requests.columns else F.lit(0)
    added = out.where("accepted").select(
        (base + F.col("seq")).alias("id"), "first_name", "last_name", "email",
        prov.alias("provider"), admin.alias("is_admin"))
    new = users.select("id", "first_name", "last_name", "email", "provider", "is_admin").unionByName(added)
    return new, out.select("seq", "email", "accepted", "reason")


def social_sign_in(users: DataFrame, logins: DataFrame, provider: str = "google"):
    """G9 (social): insert-if-absent by e-mail for (seq, first_name,
    last_name, email) logins; an existing e-mail signs in the stored user."""
    known = users.select(F.lower("email").alias("_e")).distinct().withColumn("_k", F.lit(True))
    req = _first_per_key(logins.withColumn("_e", F.lower("email")), ["_e"]).join(known, "_e", "left")
    new_rows = req.where(F.col("_k").isNull() & F.col("_is_first"))
    base = _id_base(users)
    added = new_rows.select((base + F.col("seq")).alias("id"), "first_name", "last_name", "email",
                            F.lit(provider).alias("provider"), F.lit(0).alias("is_admin"))
    return users.select("id", "first_name", "last_name", "email", "provider", "is_admin").unionByName(added)


def edit_users(users: DataFrame, requests: DataFrame, admin: bool = False):
    """Profile edits (user_id, first_name, last_name, email). The
    customer path rejects empty fields ('missing_fields') and an e-mail that
    another user holds when the request's turn comes ('email_taken', B27): an
    address that an earlier accepted request gave up is free, one it took is
    not (``addresses.take_addresses``). The admin path applies as given, with
    ``is_admin`` where the request has it. Turns follow ``seq``, or ``user_id``
    without it; a user may have several requests, and the last accepted one
    stands. Returns ``(new_users, outcomes)``."""
    ordered = "seq" in requests.columns
    r = requests if ordered else requests.withColumn("seq", F.col("user_id"))
    if admin:
        reason = F.lit(None).cast("string")
    else:
        fields_ok = _js_truthy(F.col("first_name")) & _js_truthy(F.col("last_name")) & _js_truthy(F.col("email"))
        # A stored address of nothing is nobody's, as in the original's lookup.
        held = users.select(F.col("id").alias("user_id"), F.lower("email").alias("address"))
        turns = take_addresses(held.withColumn("address", F.coalesce("address", F.lit(""))),
                               r.where(fields_ok).select("seq", "user_id", F.lower("email").alias("address")))
        r = r.join(turns, "seq", "left")
        reason = F.when(~fields_ok, "missing_fields").when(F.col("taken"), "email_taken")
    out = r.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
    flag = F.col("is_admin").cast("int") if admin and "is_admin" in requests.columns else F.lit(None).cast("int")
    acc = _last_per_key(out.where("accepted").select(
        F.col("user_id").alias("_uid"), F.col("first_name").alias("_f"), F.col("last_name").alias("_l"),
        F.col("email").alias("_m"), flag.alias("_a"), "seq"), "_uid").drop("seq")
    j = users.join(acc, users["id"] == acc["_uid"], "left")
    hit = F.col("_uid").isNotNull()
    new = j.select("id", F.when(hit, F.col("_f")).otherwise(F.col("first_name")).alias("first_name"),
                   F.when(hit, F.col("_l")).otherwise(F.col("last_name")).alias("last_name"),
                   F.when(hit, F.col("_m")).otherwise(F.col("email")).alias("email"),
                   "provider", F.coalesce("_a", "is_admin").cast("int").alias("is_admin"))
    return new, out.select(*(["seq"] if ordered else []), "user_id", "accepted", "reason")


def delete_users(users: DataFrame, ids: DataFrame) -> DataFrame:
    """Delete users by id."""
    return users.join(ids.select("id"), "id", "left_anti")


# -------------------------------------------------------------- catalog -----

IMAGE_COLS = ("image1", "image2", "image3", "image4")
GIFT_COLS = ("is_gifting", "gifting_category")


def upsert_products(products: DataFrame, requests: DataFrame) -> DataFrame:
    """Product create / update requests (seq, id or NULL, and every
    product column). Updates apply in ``seq`` order: each overwrites all
    columns but the gift ones, which no update touches, and the images, which
    keep the value before where the new one is NULL (IFNULL(new, old)). A
    create needs a name and gets ``base + seq`` as id."""
    cols = [c for c in products.columns if c != "id"]
    image = [c for c in cols if c in IMAGE_COLS]
    u = requests.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("_uid")).agg(
        F.max_by(F.struct(*[c for c in cols if c not in image], "seq"), "seq").alias("_r"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_n_{c}") for c in image])
    u = u.select("_uid", *[F.col(f"_n_{c}") if c in image else F.col(f"_r.{c}").alias(f"_n_{c}") for c in cols])
    j = products.join(u, products["id"] == u["_uid"], "left")
    hit = F.col("_uid").isNotNull()

    def pick(c):
        if c in GIFT_COLS:
            return F.col(c)
        if c in IMAGE_COLS:
            return F.when(hit, F.coalesce(F.col(f"_n_{c}"), F.col(c))).otherwise(F.col(c)).alias(c)
        return F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)
    updated = j.select("id", *[pick(c) for c in cols])
    base = _id_base(products)
    created = requests.where(F.col("id").isNull() & _js_truthy(F.col("name"))).select(
        (base + F.col("seq")).alias("id"), *cols)
    return updated.unionByName(created)


def delete_products(products: DataFrame, variants: DataFrame, ids: DataFrame):
    """Delete products and, in cascade, their variants."""
    k = ids.select(F.col("id").alias("_pid")).distinct()
    p = products.join(k, products["id"] == k["_pid"], "left_anti")
    v = variants.join(k, variants["product_id"] == k["_pid"], "left_anti")
    return p, v


def upsert_variants(variants: DataFrame, requests: DataFrame, api: bool = False):
    """Variant requests (seq, id or NULL, product_id, sku, price, stock,
    finish, gemstones_colour, length_size, width, thickness).

    Validation (B25): product_id and a price other than 0 required
    ('missing_fields'); the API path also requires sku, turns blank optional
    fields into NULL and defaults stock to 0. With an id: update every column
    but product and sku (the last valid request stands). Without: insert unless
    the sku exists in the table or in an earlier valid request of the batch
    ('duplicate_sku'). Returns ``(new_variants, outcomes)``."""
    r = requests
    opt = ["finish", "gemstones_colour", "length_size", "width", "thickness"]
    if api:
        for c in opt:
            r = r.withColumn(c, F.when(F.trim(F.col(c)) != "", F.col(c)))
        r = r.withColumn("stock", F.coalesce(F.col("stock"), F.lit(0)))
    need = F.col("product_id").isNotNull() & F.coalesce(F.col("price") != 0, F.lit(False))
    if api:
        need = need & _js_truthy(F.col("sku"))
    existing_skus = variants.select(F.col("sku").alias("_s")).distinct().withColumn("_dup", F.lit(True))
    ins = r.where(F.col("id").isNull())
    ins = ins.withColumn("_s", F.when(need, F.col("sku")))
    firsts = ins.where(F.col("_s").isNotNull()).groupBy("_s").agg(F.min("seq").alias("_first_seq"))
    ins = ins.join(firsts, "_s", "left").join(existing_skus, "_s", "left")
    ins_reason = (F.when(~need, "missing_fields")
                  .when(F.col("_dup").isNotNull() | (F.col("seq") != F.col("_first_seq")), "duplicate_sku"))
    ins = ins.withColumn("reason", ins_reason)
    upd = r.where(F.col("id").isNotNull()).withColumn("reason", F.when(~need, "missing_fields"))
    cols = [c for c in variants.columns if c not in ("id",)]
    last = _last_per_key(upd.where(F.col("reason").isNull()), "id")
    u = last.select(F.col("id").alias("_uid"), *[F.col(c).alias(f"_n_{c}") for c in cols])
    j = variants.join(u, variants["id"] == u["_uid"], "left")
    hit = F.col("_uid").isNotNull()
    updated = j.select("id", *[(F.col(c) if c in ("sku", "product_id") else
                                F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c))).alias(c) for c in cols])
    base = _id_base(variants)
    created = ins.where(F.col("reason").isNull()).select((base + F.col("seq")).alias("id"),
                                                         *[F.col(c).cast(variants.schema[c].dataType)
                                                           for c in cols])
    new = updated.unionByName(created)
    outcomes = (ins.select("seq", "id", "sku", "reason").unionByName(upd.select("seq", "id", "sku", "reason"))
                .withColumn("accepted", F.col("reason").isNull()))
    return new, outcomes


def delete_variants(variants: DataFrame, ids: DataFrame) -> DataFrame:
    """Delete variants by id."""
    return variants.join(ids.select("id"), "id", "left_anti")


# --------------------------------------------------------------- messages ---

PHONE_RE = r"^[0-9]{10}$"
EMAIL_RE = r"^\S+@\S+\.\S+$"


def validate_messages(submissions: DataFrame, client_rules: bool = True) -> DataFrame:
    """Contact form checks: name, e-mail and message required (non-empty),
    phone optional but ten digits when given; with ``client_rules`` the
    form's e-mail shape check too. Adds ``reason`` (NULL = valid) and the
    trimmed values that would be stored."""
    ph = F.col("phone")
    reason = (F.when(~(_js_truthy(F.col("name")) & _js_truthy(F.col("email")) & _js_truthy(F.col("message"))),
                     "missing_fields")
              .when(_js_truthy(ph) & ~F.coalesce(ph.rlike(PHONE_RE), F.lit(False)), "bad_phone"))
    if client_rules:
        reason = reason.when(~F.coalesce(F.trim("email").rlike(EMAIL_RE), F.lit(False)), "bad_email")
    return (submissions.withColumn("reason", reason)
            .withColumn("valid", F.col("reason").isNull())
            .withColumn("name_clean", F.trim("name")).withColumn("email_clean", F.trim("email"))
            .withColumn("phone_clean", F.when(_js_truthy(ph), F.trim(ph)))
            .withColumn("message_clean", F.trim("message")))


def insert_messages(messages: DataFrame, submissions: DataFrame):
    """Store the valid submissions (status 1 = unread)."""
    v = validate_messages(submissions)
    base = _id_base(messages)
    added = v.where("valid").select((base + F.col("seq")).alias("id"), F.col("name_clean").alias("name"),
                                    F.col("email_clean").alias("email"), F.col("phone_clean").alias("phone"),
                                    F.col("message_clean").alias("message"), F.lit(1).alias("status"))
    return messages.select("id", "name", "email", "phone", "message", "status").unionByName(added), v


def edit_messages(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """Admin edits (seq, id, name, email, phone, message, status): when
    all text fields are absent only the status changes (read/unread toggle);
    otherwise every field is overwritten. Requests apply in ``seq`` order, so
    the last full edit gives the texts and the last request the status."""
    full = F.coalesce("name", "email", "phone", "message").isNotNull()
    u = requests.groupBy(F.col("id").alias("_id")).agg(
        F.max_by(F.struct(F.col("status").alias("v")), "seq").alias("_s"),
        F.max_by(F.struct("name", "email", "phone", "message"), F.when(full, F.col("seq"))).alias("_r"))
    u = u.select("_id", F.col("_s.v").alias("_s"), F.col("_r").isNotNull().alias("_full"), F.col("_r.name").alias("_n"),
                 F.col("_r.email").alias("_e"), F.col("_r.phone").alias("_p"), F.col("_r.message").alias("_m"))
    j = messages.join(u, messages["id"] == u["_id"], "left")
    hit = F.col("_id").isNotNull()

    def pick(c, n):
        return F.when(F.col("_full"), F.col(n)).otherwise(F.col(c)).alias(c)
    return j.select("id", pick("name", "_n"), pick("email", "_e"), pick("phone", "_p"), pick("message", "_m"),
                    F.when(hit, F.col("_s")).otherwise(F.col("status")).cast("int").alias("status"))


def delete_messages(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """Delete messages by id."""
    return messages.join(ids.select("id"), "id", "left_anti")
