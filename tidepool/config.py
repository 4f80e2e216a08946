"""Default parameters."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

# Event weights, leg weights and model sizes that results depend on.
EVENT_WEIGHTS = {"view": 1.0, "addtocart": 4.0, "transaction": 10.0}
USER_LEG_WEIGHTS = {"cf": 0.6, "content": 0.3, "sequential": 0.1}
ITEM_LEG_WEIGHTS = {"cf": 0.6, "content": 0.4}
CATEGORY_PROPERTY = "categoryid"
RECENT_ITEMS = 5
NEIGHBORS_PER_RECENT = 3
MAX_TERMS = 5000
MAX_DIMENSIONS = 100


@dataclass(frozen=True)
class Params:
    """Everything that changes what a trained model contains."""

    factors: int = 100
    iterations: int = 15
    regularization: float = 0.01
    alpha: float = 1.0
    confidence: str = "scaled"
    seed: int = 42
    blocks: int = 10
    evaluation_seed: int = 42
    event_weights: dict = field(default_factory=lambda: dict(EVENT_WEIGHTS))
    min_df: int = 2
    max_df: float = 0.8
    dimensions: int = MAX_DIMENSIONS
    category_mode: str = "lineage"
    neighbor_search: str = "exact"

    @classmethod
    def simple(cls, **changes) -> "Params":
        """The small model: 50 factors and 5 iterations."""
        return cls(**{"factors": 50, "iterations": 5, **changes})

    def __post_init__(self):
        if self.category_mode != "lineage":
            raise ValueError("training saves lineage similarity only; ask category_similarity_lca for pairs with a common ancestor")

    def as_dict(self) -> dict:
        return asdict(self)
