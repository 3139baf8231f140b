"""Unique keys claimed by posts that are applied in order.

A batch of edits claims unique keys (an entry's period, date, driver and car; a
driver's dni; a car's plate; a username). Applied one by one, a post succeeds
when no other row holds the key it wants *at that time*: an earlier accepted post
may have taken it, or may have freed it by moving its own row to another key.
``settle`` gives every post the outcome of that order without running the posts
one by one.

All decisions are first assumed, then judged again and again from the decisions
of the earlier posts: the key a row has before a post is that of the row's
last accepted post, and the number of rows that hold a key before a post is the
number stored plus those that moved in, less those that moved out. A post's
decision depends on earlier posts only, so each round makes right all posts whose
chain of decisions is one longer, and the fixpoint is the sequential result.
There are as many rounds as the longest chain has links (a post refused, so
its row keeps a key, so another post is refused, ...), usually a handful.

A row or key that a third of the posts want is no single group: posts are laid
out in ranges of the sequence, "before" is a window inside a (group, range)
plus one carried row per (group, range). Each round is written to the shared
folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from fleetbook.session import written

#: Posts in a range of the sequence, about.
RANGE_POSTS = 1_000_000
#: Codes that ``settle`` gives.
GUARDED, TAKEN = "guarded", "taken"


def _all_set(cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def whole_key(cols: list[str]) -> Column:
    """The key as one value; NULL when a part is NULL (such keys never collide)."""
    return F.when(_all_set(cols), F.struct(*cols))


def _before(rows: DataFrame, group: str, seq: str, out: str, inside, total, carry, merge, ranges: int) -> DataFrame:
    """``rows`` with ``out``: what the group's rows of smaller ``seq`` come to.

    ``inside`` is the window aggregate, ``total`` a range's aggregate, ``carry``
    the aggregate of earlier totals, ``merge`` joins carried and inside values.
    A batch of one range carries nothing. ``group`` is a struct, so never NULL: rows
    stay where the window has put them when they meet what is carried.
    """
    up_to = Window.partitionBy(group, "_range").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    if ranges == 1:
        return rows.withColumn("_inside", inside.over(up_to)).withColumn(out, merge(F.lit(None), F.col("_inside"))).drop("_inside")
    earlier = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(total.alias("_total"))
    carried = totals.select("_g", "_r", carry(F.col("_total")).over(earlier).alias("_carried"))
    rows = rows.withColumn("_inside", inside.over(up_to)).join(carried, (F.col(group) == F.col("_g")) & (F.col("_range") == F.col("_r")), "left")
    return rows.withColumn(out, merge(F.col("_carried"), F.col("_inside"))).drop("_g", "_r", "_inside", "_carried")


def _last_before(rows: DataFrame, group: str, seq: str, value: Column, out: str, ranges: int) -> DataFrame:
    stamped = F.when(value.isNotNull(), F.struct(F.col(seq).alias("s"), value.alias("v")))
    return _before(rows, group, seq, out, F.last(value, ignorenulls=True), F.max(stamped).getField("v"),
                   lambda c: F.last(c, ignorenulls=True), lambda carried, own: F.coalesce(own, carried), ranges)


def _sum_before(rows: DataFrame, group: str, seq: str, value: Column, out: str, ranges: int) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return _before(rows, group, seq, out, F.sum(value), F.sum(value), F.sum,
                   lambda carried, own: F.coalesce(own, zero) + F.coalesce(carried, zero), ranges)


def settle(posts: DataFrame, rows: DataFrame, key: list[str], seq: str = "change_seq", entity: str = "id",
           may: str = "may", claims: Column | None = None, guard: Callable[[Column], Column] | None = None,
           guard_columns: tuple[str, ...] = (), range_posts: int = RANGE_POSTS, free: Column | None = None,
           stored: str | None = None) -> DataFrame:
    """``posts`` with ``outcome``: NULL (accepted, or not judged as ``may`` is false), ``guarded`` or ``taken``.

    ``posts`` have a sequence without ties, the row they change (one that is not
    stored is created by its first accepted post), the ``key`` that they give it
    and ``may``: whether the post passes every other rule. Posts for which ``claims`` is
    false write no key. ``guard`` says, from the row's current key and the post's
    ``guard_columns``, whether the post is still admissible; posts that are ``free`` always are.
    ``rows`` are the stored rows (``entity`` and ``key``); posts that have met theirs
    already name the column that holds its key (``stored``).
    """
    wants = whole_key(key) if claims is None else F.when(claims, whole_key(key))
    writes = F.lit(True) if claims is None else F.coalesce(claims, F.lit(False))
    unguarded = F.lit(True) if guard is None else F.lit(False) if free is None else F.coalesce(free, F.lit(False))
    p = posts.select(F.col(seq).alias("_seq"), F.col(entity).alias("_entity"), F.coalesce(F.col(may), F.lit(False)).alias("_may"), writes.alias("_writes"), wants.alias("_wants"),
                     unguarded.alias("_free"), *posts.columns)
    p = written(p, "claims-posts")
    held_by = F.struct("_entity").alias("_who")
    kept = ["_seq", "_who", "_may", "_writes", "_wants", "_free", F.struct(*[F.col(c) for c in (may, *guard_columns)]).alias("_post")]
    judged = F.col("_may") | ~F.col("_free")
    if stored is None:
        there = rows.select(F.col(entity).alias("_entity"), whole_key(key).alias("_stored"))
        base = there.join(p.select("_entity"), "_entity", "left_semi")
        slim = p.withColumn("_who", held_by).select("_entity", *kept).join(base, "_entity", "left").drop("_entity")
    else:
        # a post that fails another rule and that no guard looks at needs no judging at all
        slim = p.where(judged).withColumn("_who", held_by).select(*kept, F.col(stored).alias("_stored"))
    contested, holders = _contested(p, rows, key, entity)
    # posts of a row are judged in rounds when one of them meets others at a key, or when whether
    # one is admissible hangs on an earlier one
    asks = p.where(F.col("_may") & F.col("_wants").isNotNull()).select(held_by, *_parts("_wants", key))
    open_ = asks.join(contested.select(*_names(key)), _names(key), "left_semi").select("_who")
    open_ = open_.unionByName(holders.join(contested.select(*_names(key)), _names(key), "left_semi").select(held_by))
    marks, most = open_.select("_who", F.lit(True).alias("_open"), F.lit(False).alias("_watched")), 0
    many = p.count() > range_posts
    if guard is not None or many:
        seen = Observation()
        per_row = p.groupBy(held_by).agg(F.count_if("_may").alias("_n"), F.bool_or(~F.col("_free")).alias("_watched"), F.count(F.lit(1)).alias("_posts"))
        per_row = per_row.observe(seen, F.max("_posts").alias("most")).where("_watched")
        marks = marks.unionByName(written(per_row.select("_who", (F.col("_n") > 1).alias("_open"), "_watched"), "claims-rows"))
        most = max(seen.get["most"] or 0, contested.select(F.max("_events")).first()[0] or 0) if many else 0
    marks = marks.groupBy("_who").agg(F.max("_open").alias("_open"), F.max("_watched").alias("_watched"))
    # only a group of more posts than a range has is cut
    ranges = -(-p.count() // range_posts) if most > range_posts else 1
    laid = slim.repartitionByRange(ranges, "_seq").withColumn("_range", F.shiftright(F.monotonically_increasing_id(), 33)) if ranges > 1 else slim.withColumn("_range", F.lit(0).cast("bigint"))
    flagged = laid.join(marks, "_who", "left").withColumn("_open", F.coalesce("_open", F.lit(False)) & F.col("_may")).withColumn("_watched", F.coalesce("_watched", F.lit(False)))
    flagged = written(flagged, "claims-flagged")
    first = written(_numbered(flagged.where("_open"), contested, key), "claims-round")
    now, changed = first, first.limit(1).count()
    while changed:
        seen = Observation()
        after = _round(now, guard, guard_columns, ranges)
        now = written(after.observe(seen, F.count_if(F.col("_ok") != F.col("_was")).alias("changed")), "claims-round").drop("_was")
        changed = seen.get["changed"]
    others = flagged.where("not _open")
    said = now.select(F.col("_seq").alias("_s"), F.col("_why").alias("outcome"))
    said = said.unionByName(others.where("_free").select(F.col("_seq").alias("_s"), F.lit(None).cast("string").alias("outcome")))
    if stored is not None:
        said = said.unionByName(p.where(~judged).select(F.col("_seq").alias("_s"), F.lit(None).cast("string").alias("outcome")))
    if guard is not None:
        said = said.unionByName(_watched(now, others, guard, guard_columns, ranges))
    return p.join(said, p["_seq"] == said["_s"]).select(*posts.columns, "outcome")


def _names(key: list[str]) -> list[str]:
    return [f"_k{i}" for i in range(len(key))]


def _parts(struct: str, key: list[str]) -> list[Column]:
    """The key as columns: stored rows may lie by them already."""
    return [F.col(f"{struct}.{c}").alias(n) for c, n in zip(key, _names(key), strict=True)]


def _contested(p: DataFrame, rows: DataFrame, key: list[str], entity: str) -> tuple[DataFrame, DataFrame]:
    """Keys that posts of several rows may meet at, and the stored rows that hold a wanted key.

    A key is contested if several posts want it or a stored row holds it that is not the one
    post's own. At any other key no post can be refused. A contested key goes by the sequence of its first post
    (``_kid``); ``_holders`` stored rows hold it, ``_events`` bounds what happens at it.
    """
    names = _names(key)
    asked = p.where(F.col("_may") & F.col("_wants").isNotNull()).groupBy(*_parts("_wants", key)).agg(
        F.min("_seq").alias("_kid"), F.count(F.lit(1)).alias("_n"), F.min(F.struct("_entity")).alias("_asker"))
    there = rows.select(F.col(entity).alias("_entity"), *[F.col(c).alias(n) for c, n in zip(key, names, strict=True)])
    held = written(there.join(asked, names).select("_entity", *names, (F.struct("_entity") != F.col("_asker")).alias("_other")), "claims-held")
    rivals = held.groupBy(*names).agg(F.count(F.lit(1)).alias("_holders"), F.max("_other").alias("_other"))
    zero = F.lit(0).cast("bigint")
    contested = asked.join(rivals, names, "left").where((F.col("_n") > 1) | F.coalesce("_other", F.lit(False)))
    contested = contested.select(*names, "_kid", F.coalesce("_holders", zero).alias("_holders"), (2 * F.col("_n") + F.coalesce("_holders", zero)).alias("_events"))
    return written(contested, "claims-keys"), held


def _numbered(posts: DataFrame, contested: DataFrame, key: list[str]) -> DataFrame:
    """Open posts as the rounds see them: contested keys by number, whole keys only where a guard looks at them."""
    names = _names(key)
    wanted = contested.select(*names, F.col("_kid").alias("_wkid"), "_holders")
    stored = contested.select(*names, F.col("_kid").alias("_skid"))
    x = posts.select("*", *_parts("_wants", key)).join(wanted, names, "left").drop(*names)
    x = x.select("*", *_parts("_stored", key)).join(stored, names, "left").drop(*names)
    return x.select("_seq", "_range", "_who", "_writes", "_watched", "_free", F.when(F.col("_watched"), F.col("_wants")).alias("_wants"),
                    F.when(F.col("_watched"), F.col("_stored")).alias("_stored"), F.when(~F.col("_free"), F.col("_post")).alias("_post"),
                    "_wkid", "_skid", "_holders", F.lit(True).alias("_ok"), F.lit(None).cast("string").alias("_why"))


def _admissible(rows: DataFrame, had: Column, guard, guard_columns: tuple[str, ...], out: str) -> DataFrame:
    if guard is None:
        return rows.withColumn(out, F.lit(True))
    rows = rows.select("*", *[F.col(f"_post.{c}").alias(c) for c in guard_columns])
    return rows.withColumn(out, F.col("_free") | F.coalesce(guard(had), F.lit(False))).drop(*guard_columns)


def _round(now: DataFrame, guard, guard_columns: tuple[str, ...], ranges: int) -> DataFrame:
    """All open decisions, judged from those of the round before."""
    # a post that writes no key leaves the row's key as it is
    set_key = F.when(F.col("_ok") & F.col("_writes"), F.struct(F.col("_wkid").alias("n"), F.col("_wants").alias("k")))
    rows = _last_before(now, "_who", "_seq", set_key, "_last", ranges)
    moved = F.col("_last").isNotNull()
    rows = rows.withColumn("_hkid", F.when(moved, F.col("_last.n")).otherwise(F.col("_skid")))
    rows = _admissible(rows, F.when(moved, F.col("_last.k")).otherwise(F.col("_stored")), guard, guard_columns, "_fits").drop("_last")
    moves = F.col("_ok") & F.col("_writes") & ~F.col("_hkid").eqNullSafe(F.col("_wkid"))
    # a post asks for its key where it may move in; where it moves out of another one it only counts there
    into = F.struct(F.col("_wkid").alias("key"), F.when(moves, 1).otherwise(0).cast("bigint").alias("delta"), F.lit(True).alias("asks"))
    out_of = F.struct(F.col("_hkid").alias("key"), F.lit(-1).cast("bigint").alias("delta"), F.lit(False).alias("asks"))
    events = rows.withColumn("_e", F.explode(F.array(into, F.when(moves & F.col("_hkid").isNotNull(), out_of)))).where("_e is not null")
    # posts that want no contested key stand apart, each on its own
    events = events.withColumn("_at", F.struct(F.col("_e.key").alias("key"), F.when(F.col("_e.key").isNull(), F.col("_seq")).alias("seq")))
    # what only counts takes nothing else along
    bare = [c for c in ("_who", "_wants", "_stored", "_post") if c in events.columns]
    events = events.select(*[F.when(F.col("_e.asks"), F.col(c)).alias(c) if c in bare else F.col(c) for c in events.columns])
    rows = _sum_before(events, "_at", "_seq", F.col("_e.delta"), "_moved", ranges).where("_e.asks")
    others = F.coalesce("_holders", F.lit(0)) + F.col("_moved") - F.when(F.col("_hkid").eqNullSafe(F.col("_wkid")), 1).otherwise(0)
    taken = F.col("_writes") & F.col("_wkid").isNotNull() & (others > 0)
    why = F.when(~F.col("_fits"), F.lit(GUARDED)).when(taken, F.lit(TAKEN))
    return rows.select("_seq", "_range", "_who", "_writes", "_watched", "_free", "_wants", "_stored", "_post", "_wkid", "_skid", "_holders",
                       why.isNull().alias("_ok"), why.alias("_why"), F.col("_ok").alias("_was"))


def _watched(now: DataFrame, others: DataFrame, guard, guard_columns: tuple[str, ...], ranges: int) -> DataFrame:
    """Outcomes of the guarded posts that no round judges: those that fail another rule, and a row's only post that may write."""
    cols = ["_seq", "_range", "_who", "_free", "_writes", "_wants", "_stored", "_post"]
    alone = _admissible(others.where("_watched"), F.col("_stored"), guard, guard_columns, "_fits")
    closed = alone.select(*cols, (F.col("_fits") & F.col("_may")).alias("_ok"), (~F.col("_free")).alias("_asked"))
    both = now.where("_watched").select(*cols, "_ok", F.lit(False).alias("_asked")).unionByName(closed)
    set_key = F.when(F.col("_ok") & F.col("_writes"), F.struct(F.col("_wants").alias("k")))
    rows = _last_before(both, "_who", "_seq", set_key, "_last", ranges).where("_asked")
    had = F.when(F.col("_last").isNotNull(), F.col("_last.k")).otherwise(F.col("_stored"))
    rows = _admissible(rows, had, guard, guard_columns, "_fits")
    return rows.select(F.col("_seq").alias("_s"), F.when(~F.col("_fits"), F.lit(GUARDED)).alias("outcome"))
