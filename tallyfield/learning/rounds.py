"""What all boosters share: the seed, and which round to keep."""

from __future__ import annotations

SEED = 42


def best_round(losses: list[float], patience: int) -> int:
    """Rounds to keep: the best one before ``patience`` rounds brought nothing better."""
    best = 0
    for k, loss in enumerate(losses):
        if loss < losses[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1
