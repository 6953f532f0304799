"""The declared experiments as compositions of the operators.

Each takes token rows with batch_id, pos, student, teacher, mask, and where it needs
them text_weight, score and chunk_id, and returns one row with the loss.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators.chunks import expand_chunk_weights_to_tokens, pool_token_scores_to_chunks
from ..operators.losses import dual_track_loss, masked_weighted_kl
from ..operators.weights import build_visual_anchor_weights


def smoke(tokens: DataFrame, *, text_weights: str | None = "text_weight", vision_weights: str | None = "vision_weight", mask: str = "mask") -> DataFrame:
    """000: both tracks, the vision track at half strength."""
    return dual_track_loss(tokens, text_weights=text_weights, vision_weights=vision_weights, mask=mask, alpha_text=1.0, alpha_vision=0.5, temperature=1.0)


def text_track(tokens: DataFrame, *, mask: str = "mask") -> DataFrame:
    """010: the masked KL with uniform weights."""
    return masked_weighted_kl(tokens, mask=mask)


def token_anchor(tokens: DataFrame, *, topk_ratio: float = 0.1, mask: str = "mask", score: str = "score") -> DataFrame:
    """020: a tenth of the tokens anchored by score, as the vision track."""
    anchored = build_visual_anchor_weights(tokens, score, mask=mask, topk_ratio=topk_ratio, out="vision_anchor")
    return dual_track_loss(anchored, vision_weights="vision_anchor", mask=mask)


def dual_track(tokens: DataFrame, *, text_weights: str = "text_weight", vision_weights: str = "vision_weight", mask: str = "mask") -> DataFrame:
    """030: both tracks at full strength."""
    return dual_track_loss(tokens, text_weights=text_weights, vision_weights=vision_weights, mask=mask)


def chunk_anchor(tokens: DataFrame, *, reduce: str = "mean", topk_ratio: float = 0.1, mask: str = "mask", score: str = "score") -> DataFrame:
    """040: scores pooled into chunks, chunks anchored by score, their weights given to tokens.

    How chunk scores become chunk weights is our choice: the token rule, applied to
    the chunks that have tokens.
    """
    # Rows of no batch meet no chunk weight; the join would rule them out on one of pooling's two uses only, which then could share nothing.
    named = tokens.where(F.col("batch_id").isNotNull())
    pooled = pool_token_scores_to_chunks(named, score, "chunk_id", reduce=reduce, count="n_tokens")
    pooled = pooled.withColumn("has_tokens", (F.col("n_tokens") > 0).cast("double"))
    weighted = build_visual_anchor_weights(pooled, "chunk_score", mask="has_tokens", topk_ratio=topk_ratio, pos="chunk_id", out="weight")
    expanded = expand_chunk_weights_to_tokens(tokens, weighted.select("batch_id", "chunk_id", "weight"), out="vision_anchor")
    return dual_track_loss(expanded, vision_weights="vision_anchor", mask=mask)


EXPERIMENTS: dict[str, Callable[[DataFrame], DataFrame]] = {"000": smoke, "010": text_track, "020": token_anchor, "030": dual_track, "040": chunk_anchor}
