"""Exact deduplication, scoring and the keep/drop decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.functions import scoring
from chatsieve.operators.features import FEATURES, MEANS
from chatsieve.operators.validate import aggregates

# The defaults of the curation thresholds.
MIN_QUALITY = 0.3
MIN_ASSISTANT_LENGTH = 10


def dedup_first(features: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """One row per distinct valid content: the first sample in ``order_col``.

    Adds ``copies``, the number of samples that share the content. The measures
    are the same for all copies, so they are picked freely and the aggregate
    combines map-side: a content with any number of copies reaches the reducer
    as one row per map task. Invalid samples have no content to compare; they
    come out as a single row (``valid`` false, NULL key) that only counts them.
    """
    measures = [c for c in FEATURES if c not in ("key", "valid")]
    first = (
        f"min({id_col})" if id_col == order_col else f"min_by({id_col}, {order_col})"
    )
    return features.groupBy("valid", F.expr("CASE WHEN valid THEN key END AS key")).agg(
        *aggregates(
            {
                id_col: first,
                **{c: f"any_value({c})" for c in measures},
                "copies": "count(*)",
            }
        )
    )


# Each of these may use the ones before it: they are lateral aliases of a select.
_PARTS = [*MEANS, *[f"{sql} AS {name}" for name, sql in scoring.quality_parts().items()]]
_SCORE = [
    *_PARTS,
    f"{scoring.quality()} AS quality",
    f"{scoring.quality_bucket('quality')} AS bucket",
]


def with_parts(features: DataFrame) -> DataFrame:
    """Add the score parts ``s1``..``s5`` (and their inputs)."""
    return features.selectExpr("*", *_PARTS)


def with_quality(features: DataFrame) -> DataFrame:
    """Add ``quality`` and ``bucket`` (and the parts)."""
    return features.selectExpr("*", *_SCORE)


def with_drop_reason(
    scored: DataFrame,
    min_quality: float = MIN_QUALITY,
    min_assistant_length: float = MIN_ASSISTANT_LENGTH,
) -> DataFrame:
    """Add ``drop_reason``: NULL for kept rows; quality is tested first."""
    return scored.selectExpr(
        "*",
        f"CASE WHEN quality < {float(min_quality)!r}D THEN 'low_quality' "
        f"WHEN mean_assistant < {float(min_assistant_length)!r}D "
        "THEN 'short_assistant' END AS drop_reason",
    )


def curate(
    features: DataFrame,
    id_col: str,
    order_col: str,
    min_quality: float = MIN_QUALITY,
    min_assistant_length: float = MIN_ASSISTANT_LENGTH,
) -> DataFrame:
    """Deduplicate, score and decide; the statistics read this frame."""
    groups = dedup_first(features, id_col, order_col)
    return with_drop_reason(with_quality(groups), min_quality, min_assistant_length)


def kept(curated: DataFrame) -> DataFrame:
    """Rows that pass validation, deduplication and both thresholds."""
    return curated.where("valid AND drop_reason IS NULL")
