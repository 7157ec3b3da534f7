"""Chat sessions, their messages, and the text grouped out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.plans.scan import Running, first_per, numbered, ordered_scan


def active_session(sessions: DataFrame, phone: str, started: str, not_ended: Column, tie: str) -> DataFrame:
    """The latest session of each phone that has not ended."""
    return first_per(sessions.filter(not_ended), [phone], [F.col(started).desc(), F.col(tie).desc()])


def session_snapshot(sessions: DataFrame, messages: DataFrame, session: str, order: list[str]) -> DataFrame:
    """Sessions with their messages, one row each, numbered in message order.

    A session without messages keeps one row with a null position. Rows instead of
    a nested list keep a session of any length spread over tasks.
    """
    return sessions.join(numbered(messages, [session], order, "message_no"), session, "left")


def has_category(sessions: DataFrame, messages: DataFrame, session: str, wanted: Column) -> DataFrame:
    """Sessions holding at least one message of a category."""
    holding = messages.filter(wanted).select(session).distinct()
    return sessions.join(holding, session, "left_semi")


def recent(sessions: DataFrame, started: str, as_of: Column | None, hours: int = 3) -> DataFrame:
    """Sessions started within the last ``hours``; all of them without ``as_of``."""
    if as_of is None:
        return sessions
    return sessions.filter(F.col(started) >= as_of - F.make_dt_interval(hours=F.lit(hours)))


def status_counts(sessions: DataFrame, status: str, names: list[str]) -> DataFrame:
    return sessions.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(status) == n).alias(n) for n in names],
    )


def latest_state(changes: DataFrame, key: list[str], ts: list[str], fields: list[str]) -> DataFrame:
    """Last-write-wins view over a change log: each field's last non-null write.

    ``changes`` counts the writes, which is how counters are kept.
    """
    at = F.struct(*ts)
    return changes.groupBy(*key).agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields],
        F.count(F.lit(1)).alias("changes"),
    )


def photo_count(messages: DataFrame, session: str, order: list[str], is_photo: Column) -> DataFrame:
    """Running photo number on each photo row, null on the others."""
    flagged = messages.withColumn("__photo", F.when(is_photo, F.lit(1)))
    out = ordered_scan(flagged, [session], order, {"photo_num": Running("count", "__photo")})
    return out.withColumn("photo_num", F.when(F.col("__photo") == 1, F.col("photo_num"))).drop("__photo")


def group_lines(messages: DataFrame, session: list[str], category: str, content: str, order: list[str]) -> DataFrame:
    """Trimmed non-empty texts per category, numbered in message order."""
    text = F.trim(F.col(content))
    kept = messages.filter(text.isNotNull() & (text != "")).withColumn("line", text)
    return numbered(kept, [*session, category], order, "line_no")


def group_text(
    messages: DataFrame, session: list[str], category: str, content: str, order: list[str], headings: dict[str, str]
) -> DataFrame:
    """The text of each category under its heading as rows, categories in a fixed order.

    ``headings`` maps category to heading in the wanted order; other categories are
    left out. Line 0 is the heading, the lines follow in message order. Rows keep a
    category of any length spread over tasks.
    """
    lines = group_lines(messages.filter(F.col(category).isin(*headings)), session, category, content, order)
    rank, head = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (name, title) in enumerate(headings.items()):
        hit = F.col(category) == name
        rank = F.when(hit, F.lit(i)).otherwise(rank)
        head = F.when(hit, F.lit(title)).otherwise(head)
    shape = [*session, rank.alias("category_no"), category]
    heads = lines.select(*session, category).distinct()
    return lines.select(*shape, "line_no", "line").unionByName(
        heads.select(*shape, F.lit(0).cast("bigint").alias("line_no"), head.alias("line"))
    )
