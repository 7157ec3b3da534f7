"""Review listings, versions, batches and issue ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.plans.scan import Neighbour, Running, first_per, numbered, ordered_scan


def issue_counts(issues: DataFrame, review: str, is_error: Column, is_warning: Column, is_open: Column) -> DataFrame:
    """Open errors, open warnings and all open issues of each review."""
    return issues.groupBy(review).agg(
        F.count_if(is_error & is_open).alias("open_errors"),
        F.count_if(is_warning & is_open).alias("open_warnings"),
        F.count_if(is_open).alias("open_total"),
    )


def review_listing(reviews: DataFrame, drawings: DataFrame, counts: DataFrame, review: str, drawing: str) -> DataFrame:
    """Reviews with their drawing and, where they have issues, the counts.

    The issues arrive pre-aggregated, so the joins see one row per review.
    """
    listed = reviews.join(drawings, drawing).join(counts, review, "left")
    return listed.fillna(0, ["open_errors", "open_warnings", "open_total"])


def page(df: DataFrame, order: list[Column], number: int, per_page: int = 10) -> DataFrame:
    """One page of a listing; a page number below 1 reads as 1."""
    skip = (max(1, number) - 1) * per_page
    return df.orderBy(*order).offset(skip).limit(per_page)


def total_pages(df: DataFrame, per_page: int = 10) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("total"),
        F.greatest(F.ceil(n / per_page), F.lit(1)).cast("bigint").alias("total_pages"),
    )


def latest_versions(reviews: DataFrame, drawing: str, version: str, carry: list[str]) -> DataFrame:
    """The newest review of each drawing, with the columns in ``carry``."""
    newest = F.max_by(F.struct(*carry), F.struct(version, *carry))
    return reviews.groupBy(drawing).agg(
        F.max(version).alias(version), newest.alias("__new")
    ).select(drawing, version, *[F.col("__new")[c].alias(c) for c in carry])


def version_append(reviews: DataFrame, uploads: DataFrame, drawing: str) -> DataFrame:
    """The next version row for each upload of a known drawing.

    ``reviews`` has version, design_data and drawing_file; ``uploads`` has
    design_uploaded, design_data (null when unreadable) and drawing_file (null when
    absent or unreadable). Without a design upload the old design stays, an
    unreadable one clears it; the drawing file changes only for a readable new one.
    """
    last = latest_versions(reviews, drawing, "version", ["design_data", "drawing_file"])
    new = uploads.withColumnsRenamed({"design_data": "__design", "drawing_file": "__file"})
    return new.join(last, drawing, "left").select(
        drawing,
        (F.coalesce("version", F.lit(0)) + 1).alias("version"),
        F.when(F.col("design_uploaded"), F.col("__design"))
        .otherwise(F.col("design_data"))
        .alias("design_data"),
        F.coalesce("__file", "drawing_file").alias("drawing_file"),
        F.lit("processing").alias("status"),
    )


def batch_insert(rows: DataFrame, upload: str, order: list[str]) -> DataFrame:
    """Number the rows of each upload; only uploads of several rows get a batch id."""
    sizes = rows.groupBy(upload).agg(F.count(F.lit(1)).alias("batch_size"))
    indexed = numbered(rows, [upload], order, "batch_index")
    return (
        indexed.join(sizes, upload)
        .withColumn(
            "batch_id",
            F.when(F.col("batch_size") > 1, F.concat(F.lit("batch-"), F.col(upload).cast("string"))),
        )
        .withColumn("version", F.lit(1))
        .withColumn("status", F.lit("processing"))
    )


def batch_neighbours(reviews: DataFrame, batch: str, order: list[str], review: str) -> DataFrame:
    """Position in the batch, batch size, previous and next review."""
    sizes = reviews.groupBy(batch).agg(F.count(F.lit(1)).alias("total"))
    placed = ordered_scan(
        reviews,
        [batch],
        order,
        {
            "index": Running("count"),
            "prev_id": Neighbour(review, -1),
            "next_id": Neighbour(review, 1),
        },
    )
    return placed.join(sizes.filter("total > 1"), batch)


def dedup_issues(issues: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first issue of each key in check order."""
    return first_per(issues, keys, order)


def visible_issues(issues: DataFrame, tab: str, status: str) -> DataFrame:
    """The rows one review tab shows: reasoning findings or all the others."""
    reasoning = F.col("category") == "AI Reasoning"
    shown = issues.filter(reasoning if tab == "reasoning" else ~reasoning)
    if status == "open":
        return shown.filter(F.col("status") != "resolved")
    if status == "resolved":
        return shown.filter(F.col("status") == "resolved")
    return shown


def issue_order() -> list[Column]:
    """Severity as text, descending, so that warnings precede errors; then category."""
    return [F.col("severity").desc(), F.col("category"), F.col("id")]


def category_groups(issues: DataFrame, review: list[str], category: str, order: str, is_open: Column) -> DataFrame:
    """Groups in order of first appearance with their open count and running number."""
    groups = issues.groupBy(*review, category).agg(
        F.min(order).alias("first_ord"),
        F.count_if(is_open).alias("open_count"),
        F.count(F.lit(1)).alias("issue_count"),
    )
    return numbered(groups, review, ["first_ord", category], "group_no")
