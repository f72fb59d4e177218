"""Accounts, sessions and settings as plain filters and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeline.functions import text
from sedgeline.operators.lists import has_role

#: What stands for the hidden part of a secret, and how much of its end is shown.
MASK, SHOWN = "••••••••", 4


def live_devices(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions of named devices that have not run out, the newest first."""
    return sessions.where(F.col("device_name").isNotNull() & (F.col("expires_at") > now)).orderBy(F.desc("created_at"), F.desc("session_id"))


def session_owners(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Live sessions with their users; sessions of nobody are left out.  Who has run out never reaches the join."""
    return sessions.where(F.col("expires_at") > now).join(users, "user_id")


def usable_credentials(accounts: DataFrame) -> DataFrame:
    """Accounts that can sign in with a password."""
    return accounts.where((F.col("provider") == "credential") & F.col("password").isNotNull())


def recipients(users: DataFrame, settings: DataFrame, locales: list[str], fallback: str, role: str | None = None) -> DataFrame:
    """``user_id, email, locale``: users (of a role) with their language, or the fallback where none or an unknown one is set."""
    rows = users.where(has_role(role)) if role else users
    joined = rows.join(settings.select("user_id", "language"), "user_id", "left")
    return joined.select("user_id", "email", F.when(F.col("language").isin(locales), F.col("language")).otherwise(F.lit(fallback)).alias("locale"))


def active_provider(stored: Column, flags: dict[str, Column]) -> Column:
    """The stored provider if its own flag is set, else empty."""
    return F.coalesce(*[F.when((stored == k) & on, F.lit(k)) for k, on in flags.items()], F.lit(""))


def masked(secret: Column) -> Column:
    """A secret as it is shown: nothing of a short one but that it is there, the end of a longer one; null if there is none."""
    tail = F.when(F.length(secret) > 2 * SHOWN, F.right(secret, F.lit(SHOWN))).otherwise(F.lit(""))
    return F.when(F.coalesce(secret, F.lit("")) != "", F.concat(F.lit(MASK), tail))


def admitted(users: DataFrame, wanted: DataFrame) -> DataFrame:
    """``position, email, outcome`` of new users: addresses are compared without case, and the first of a batch counts."""
    first = wanted.groupBy(F.lower("email").alias("__low")).agg(F.min("position").alias("__first"))
    taken = users.select(F.lower("email").alias("__low"), F.lit(True).alias("__taken")).distinct()
    rows = wanted.withColumn("__low", F.lower("email")).join(first, "__low").join(taken, "__low", "left")
    clash = F.col("__taken").isNotNull() | (F.col("position") != F.col("__first"))
    return rows.select("position", "email", F.when(clash, "taken").otherwise("created").alias("outcome"))


def changed_addresses(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Users with the changed addresses (``user_id, email``) that no other user has; the others stay as they are."""
    low = users.select(F.lower("email").alias("__low"), F.col("user_id").alias("__has"))
    clashes = changes.withColumn("__low", F.lower("email")).join(low, "__low").where("user_id <> __has").select("user_id")
    twice = changes.withColumn("__low", F.lower("email")).groupBy("__low").agg(F.min("user_id").alias("user_id"))  # of equal wishes the first user's
    good = changes.join(clashes, "user_id", "left_anti").join(twice, "user_id", "left_semi").select("user_id", F.col("email").alias("__new"))
    joined = users.join(good, "user_id", "left")
    return joined.select(*[F.coalesce("__new", "email").alias(c) if c == "email" else F.col(c) for c in users.columns])


# --- wire forms


def wire_tag(tag_id: Column, name: Column, color: Column) -> Column:
    """A tag as JSON."""
    return F.to_json(F.struct(tag_id.alias("id"), name.alias("name"), color.alias("color")), {"ignoreNullFields": "false"})


def wire_position(article_id: Column, updated_at: Column) -> Column:
    """A reading position as JSON; both are null before the first one."""
    return F.to_json(F.struct(article_id.alias("articleId"), text.iso_millis(updated_at).alias("updatedAt")), {"ignoreNullFields": "false"})


def list_address(q: Column, page: Column, page_size: Column, sort: Column, descending: Column, filters: dict[str, Column] | None = None, resets: Column | None = None, usual_size: int = 25) -> Column:
    """The query string of a list without what is usual, as :func:`sedgeline.params.to_query` writes it; the page is left out
    where ``resets`` says that what is listed has changed."""
    coded = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    first = page <= 1 if resets is None else (page <= 1) | resets
    values = {
        "q": F.nullif(F.trim(F.coalesce(q, F.lit(""))), F.lit("")), "page": F.when(~first, page.cast("string")), "pageSize": F.when(page_size != usual_size, page_size.cast("string")), "sort": F.nullif(sort, F.lit("")), "dir": F.when(~descending, "asc"),
        **{k: F.nullif(v, F.lit("")) for k, v in (filters or {}).items()},
    }
    return F.concat_ws("&", *[F.concat(F.lit(f"{k}="), coded(v)) for k, v in values.items()])
