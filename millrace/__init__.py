"""millrace: token-level distillation losses, weighting and evaluation analytics on Spark.

Everything is an expression or a DataFrame transformation; nothing runs until the
caller acts on the result.
"""

from .operators.losses import dual_track_loss, kl_divergence_from_logits, masked_weighted_kl

__version__ = "0.1.0"
__all__ = ["__version__", "dual_track_loss", "kl_divergence_from_logits", "masked_weighted_kl"]
