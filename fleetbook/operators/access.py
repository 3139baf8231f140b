"""Access-token audits: validity, purges, last access and expiry.

Tokens are audit rows of two kinds, ``remember`` (remember-me) and ``reset``
(password reset), which share one shape but not their rules; no secret is
ever read.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbook.functions.display import datetime_ar

# Token lifetimes.
REMEMBER_DAYS = 30
RESET_HOURS = 1


def valid_tokens(tokens: DataFrame, users: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Tokens usable at ``as_of``: not expired, of an active user; a reset
    token works once, a remember token again and again."""
    u = users.where(F.col("is_active") == 1).select(F.col("id").alias("_u_id"),
                                                      F.col("username"), F.col("role"))
    # wall-clock literal: built from text, so no session or process time zone applies
    at = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    t = tokens.where((F.col("expires_at") > at) & ((F.col("kind") == "remember") | F.col("used_at").isNull()))
    return t.join(u, t.user_id == u._u_id).drop("_u_id")


def purge_tokens(tokens: DataFrame, requests: DataFrame, resets: DataFrame) -> DataFrame:
    """Tokens left after purges: a new request drops the user's unused reset
    tokens; a completed reset drops the user's remember tokens.

    Users of either event are joined to the tokens once, as two flags.
    """
    events = (requests.select("user_id", F.lit(True).alias("_asked"), F.lit(False).alias("_done"))
              .unionByName(resets.select("user_id", F.lit(False).alias("_asked"), F.lit(True).alias("_done"))))
    flags = events.groupBy("user_id").agg(F.max("_asked").alias("_asked"), F.max("_done").alias("_done"))
    drop = (((F.col("kind") == "reset") & F.col("used_at").isNull() & F.col("_asked"))
            | ((F.col("kind") == "remember") & F.col("_done")))
    return tokens.join(flags, "user_id", "left").where(~F.coalesce(drop, F.lit(False))).select(*tokens.columns)


def last_access(users: DataFrame, tokens: DataFrame) -> DataFrame:
    """Users with ``last_login_at`` stamped from their latest token use, and
    its display text (``dd/mm/yyyy HH:mm``, ``-`` when never)."""
    last = (tokens.where(F.col("used_at").isNotNull()).groupBy("user_id")
                  .agg(F.max("used_at").alias("_last")))
    j = users.join(last, users.id == last.user_id, "left")
    prev = F.col("last_login_at") if "last_login_at" in users.columns else F.lit(None).cast("timestamp_ntz")
    stamped = F.greatest(prev, F.col("_last"))
    cols = [c for c in users.columns if c != "last_login_at"]
    return j.select(*[users[c] for c in cols], stamped.alias("last_login_at"),
                    datetime_ar(stamped).alias("last_login_text"))


def token_expiry(tokens: DataFrame) -> DataFrame:
    """Expiry of a token created at ``created_at``: 30 days (remember-me) and
    1 hour (password reset)."""
    return tokens.select(
        "id", "user_id", "created_at",
        (F.col("created_at") + F.make_dt_interval(days=F.lit(REMEMBER_DAYS))).alias("remember_expires_at"),
        (F.col("created_at") + F.make_dt_interval(hours=F.lit(RESET_HOURS))).alias("reset_expires_at"))
