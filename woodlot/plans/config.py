"""Training options with their defaults and checks."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Heap numbers of nodes fit 63 bits to this depth.
MAX_LEVEL = 62


@dataclass(kw_only=True)
class Options:
    n_tree: int = 500
    n_samp: int = 0
    with_repl: bool = True
    sampling_weight: str | None = None
    n_holdout: int = 0
    n_level: int = 0
    min_node: int | None = None
    min_info: float = 0.01
    max_leaf: int = 0
    pred_fixed: int = 0
    pred_prob: float = 0.0
    pred_weight: list[float] | None = None
    reg_mono: dict[int, float] = field(default_factory=dict)
    split_quant: float | dict[int, float] = 0.5
    class_weight: list[float] | str | None = None
    ctg_census: str = "votes"
    tree_block: int = 20
    thin_leaves: bool = False
    trap_unobserved: bool = False
    quant_vec: list[float] | None = None
    quantiles: bool = False
    imp_permute: int = 0
    na_policy: str = "coin"
    nu: float = 0.0
    seed: int = 0

    def checked(self, p: int, classification: bool) -> Options:
        if self.n_tree < 1 or self.tree_block < 1:
            raise ValueError("n_tree and tree_block are at least 1")
        if not 0 <= self.n_level <= MAX_LEVEL:
            raise ValueError(f"n_level is 0 (no bound, {MAX_LEVEL} levels at most) to {MAX_LEVEL}")
        if self.pred_fixed and self.pred_prob:
            raise ValueError("pred_fixed and pred_prob exclude each other")
        if not 0 <= self.pred_fixed <= p or not 0 <= self.pred_prob <= 1:
            raise ValueError("pred_fixed is at most the number of predictors; pred_prob lies in [0, 1]")
        if self.pred_weight is not None and (len(self.pred_weight) != p or min(self.pred_weight) < 0 or not sum(self.pred_weight)):
            raise ValueError("one weight for each predictor, none below zero, not all zero")
        if any(not -1 <= v <= 1 for v in self.reg_mono.values()):
            raise ValueError("reg_mono lies in [-1, 1]")
        for q in self.split_quant.values() if isinstance(self.split_quant, dict) else [self.split_quant]:
            if not 0 <= q <= 1:
                raise ValueError("split_quant lies in [0, 1]")
        if self.ctg_census not in ("votes", "prob"):
            raise ValueError("ctg_census is 'votes' or 'prob'")
        if self.na_policy not in ("coin", "right"):
            raise ValueError("na_policy is 'coin' or 'right'")
        if self.min_node is None:
            self.min_node = 2 if classification else 3
        if self.imp_permute not in (0, 1):
            raise ValueError("imp_permute is 0 or 1")
        if self.quantiles and self.quant_vec is None:
            self.quant_vec = [0.25, 0.5, 0.75, 1.0]
        return self
