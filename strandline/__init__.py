"""Spark operators for ordered sensor and frame-feature sequences."""

from strandline.sequence import Sequence, carry, framed, join_stats, measured, ordered_fold, running_sum, with_position

__all__ = ["Sequence", "carry", "framed", "join_stats", "measured", "ordered_fold", "running_sum", "with_position"]
