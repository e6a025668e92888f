"""Message and file state from logs; the batch twins of the stateful streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import backoff_ms
from ..session import checkpointed
from .ordered import ordered_scan

MAX_RETRIES = 3
SMALL_GROUP = 10_000


def latest_state(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write per key wins. The position filter also runs before the shuffle."""
    newest_first = Window.partitionBy(*keys).orderBy(*[F.desc(column) for column in order])
    return (log.withColumn("__position", F.row_number().over(newest_first))
            .filter(F.col("__position") == 1).drop("__position"))


def retry_history(
    log: DataFrame, *, key: str = "message_id", order: list[str], failed: Column, time: str = "ts",
    max_retries: int = MAX_RETRIES, base_ms: int = 1000, slices: int | None = None,
) -> DataFrame:
    """What each arrival of a message meets: failures so far, and what becomes of it.

    A message that arrives with ``max_retries`` failures is dead-lettered unprocessed; failures are
    carried on and never reset. A failed arrival is due again after the backoff.
    """
    bad = F.coalesce(failed, F.lit(False))
    counted = ordered_scan(log, [key], order, sums={"__failures": bad.cast("int")}, slices=slices)
    before = F.col("__failures") - bad.cast("int")
    dead = before >= max_retries
    wait = backoff_ms(F.lit(base_ms), before + 1)
    return counted.withColumns({
        "retry_count": F.least(F.when(dead, before).otherwise(F.col("__failures")), F.lit(max_retries)).cast("int"),
        "outcome": F.when(dead, "dead_letter").when(bad, "retry").otherwise("completed"),
        "next_attempt_at": F.when(~dead & bad, F.timestamp_add("SECOND", F.floor(wait / 1000), F.col(time))),
    }).drop("__failures")


def dedupe_files(
    arrivals: DataFrame, *, name: str = "name", version: list[str], order: list[str], keep_all: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """Skips a file whose version equals the last processed one of its name; A, B, A is three versions.

    A skipped arrival equals the one before it, so comparing neighbours is comparing with the last
    processed version.
    """
    marked = ordered_scan(
        arrivals, [name], order, previous={"__before": F.struct(*version)}, slices=slices)
    is_new = F.col("__before").isNull() | ~F.col("__before").eqNullSafe(F.struct(*version))
    marked = marked.withColumn("is_new", is_new).drop("__before")
    return marked if keep_all else marked.filter("is_new").drop("is_new")


def dedupe_messages(
    arrivals: DataFrame, *, key: str = "id", time: str = "ts", ttl_seconds: int = 300,
    slices: int | None = None, small_group: int = SMALL_GROUP,
) -> DataFrame:
    """Times at which a key is handled when handling it locks the key for ``ttl_seconds``.

    The lock runs from the first arrival and duplicates do not extend it. Result: (key, time).

    An arrival ``ttl`` or more after its predecessor always opens a lock, so the arrivals between two such
    gaps form a session of their own. Sessions shorter than the TTL are settled by their first arrival.
    Longer ones are folded one by one while they are small; the others are followed by doubling jumps,
    which needs a number of joins logarithmic in their length and never gathers a session.
    """
    ttl = ttl_seconds * 1_000_000
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                              F.col(time).cast("timestamp_ntz"))
    moments = arrivals.select(key, micros.alias("t"))
    gaps = ordered_scan(moments.distinct(), [key], ["t"], previous={"__before": F.col("t")}, slices=slices,
                        sample_from=moments)
    opens = F.col("__before").isNull() | (F.col("t") - F.col("__before") >= ttl)
    sessions = ordered_scan(gaps.withColumn("__opens", opens), [key], ["t"],
                            sums={"session": F.col("__opens").cast("bigint")}, slices=slices,
                            sample_from=moments)
    sessions = checkpointed(sessions.select(key, "session", "t", "__opens"))
    sizes = sessions.groupBy(key, "session").agg(
        F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("n"))
    openers = sessions.filter("__opens").select(key, "t")
    long_ones = sizes.filter(F.col("last") - F.col("first") >= ttl)

    small = long_ones.filter(F.col("n") <= small_group).select(key, "session")
    folded = (sessions.join(small, [key, "session"], "left_semi")
              .groupBy(key, "session").agg(F.array_sort(F.collect_list("t")).alias("times"))
              .select(key, F.explode(_fold(F.col("times"), ttl)).alias("t")))

    large = long_ones.filter(F.col("n") > small_group).select(key, "session", "first", "last")
    handled = openers.union(folded)
    longest = large.agg(F.max(F.col("last") - F.col("first"))).first()[0]
    if longest is not None:
        handled = handled.union(_follow(sessions, large, key, ttl, int(longest)))
    instant = F.timestamp_add("MICROSECOND", F.col("t"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return handled.distinct().select(key, instant.alias(time))


def mark_duplicates(
    arrivals: DataFrame, *, key: str = "id", time: str = "ts", order: list[str], ttl_seconds: int = 300,
    slices: int | None = None,
) -> DataFrame:
    """All arrivals, whole, with ``handled``: whether this one opens a lock on its key (see ``dedupe_messages``).

    Of arrivals of one key at one time the first by ``order`` opens it. One without a key is handled: it locks nothing.
    """
    keyed = arrivals.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    opened = dedupe_messages(keyed, key=key, time=time, ttl_seconds=ttl_seconds, slices=slices).select(
        F.col(key).alias("__key"), F.col(time).alias("__time"), F.lit(True).alias("__opens"))
    ranked = ordered_scan(keyed, [key, time], order, rank="__same", slices=slices)
    joined = ranked.join(opened, (F.col(key) == F.col("__key")) & (F.col(time).cast("timestamp_ntz") == F.col("__time")), "left")
    marked = joined.withColumn("handled", F.coalesce("__opens", F.lit(False)) & (F.col("__same") == 1))
    rest = arrivals.filter(F.col(key).isNull() | F.col(time).isNull()).withColumn("handled", F.lit(True))
    return marked.select(*arrivals.columns, "handled").unionByName(rest)


def _fold(times: Column, ttl: int) -> Column:
    """Sorted times of one session that open a lock."""
    return F.aggregate(
        times, F.array().cast("array<bigint>"),
        lambda kept, t: F.when((F.size(kept) == 0) | (t - F.try_element_at(kept, F.lit(-1)) >= ttl),
                               F.array_append(kept, t)).otherwise(kept))


def _follow(sessions: DataFrame, large: DataFrame, key: str, ttl: int, longest: int) -> DataFrame:
    """Lock openings of large sessions, by pointer doubling over (key, t) -> next possible opening."""
    rows = sessions.join(large.select(key, "session"), [key, "session"], "left_semi")
    jumps = checkpointed(_next_opening(rows, key, ttl))
    reached = large.select(key, F.col("first").alias("t"))
    for _ in range((longest // ttl + 1).bit_length()):
        hop = jumps.select(key, F.col("t"), "next")
        landed = reached.join(hop, [key, "t"]).select(key, F.col("next").alias("t"))
        reached = checkpointed(reached.union(landed).distinct())
        onward = jumps.select(key, F.col("t").alias("next"), F.col("next").alias("beyond"))
        jumps = checkpointed(jumps.join(onward, [key, "next"]).select(key, "t", F.col("beyond").alias("next")))
    return reached


def _next_opening(rows: DataFrame, key: str, ttl: int) -> DataFrame:
    """(key, t, next): the first arrival at or after t + ttl, found by merging targets into arrivals."""
    arrivals = rows.select(key, "session", (-F.col("t")).alias("u"), F.lit(0).alias("kind"), F.col("t"))
    targets = rows.select(key, "session", (-(F.col("t") + ttl)).alias("u"), F.lit(1).alias("kind"), F.col("t"))
    merged = arrivals.union(targets)
    # Order is descending in time (u = -time); an arrival at the very target time sorts before the target.
    seen = ordered_scan(merged, [key, "session"], ["u", "kind", "t"],
                        maxima={"__u": F.when(F.col("kind") == 0, F.col("u"))})
    return (seen.filter((F.col("kind") == 1) & F.col("__u").isNotNull())
            .select(key, "t", (-F.col("__u")).alias("next")))
