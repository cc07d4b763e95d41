"""Configuration: a tree of known keys with defaults; anything else is an error."""

from __future__ import annotations

import copy
from collections.abc import Mapping
from pathlib import Path

import yaml

#: The keys and defaults that configuration files are written with.
DEFAULTS: dict = {
    "run": {"name": "run", "output_dir": "./artifacts", "random_state": 42, "n_jobs": 1, "verbose": 1, "save_fitted_model": True, "refit_on_full_data": True, "save_predictions": "holdout"},
    "data": {"path": None, "format": "csv", "target": "target", "id_column": None, "positive_label": 1, "sample_frac": None, "read_kwargs": {}},
    "columns": {"numeric": [], "categorical": [], "passthrough": [], "drop": [], "auto_infer": True, "auto_infer_max_cardinality": 25, "numeric_parse_threshold": 0.95, "drop_constant": True, "max_categorical_cardinality_ratio": 0.5},
    "preprocessing": {
        "numeric": {"imputer": "median", "imputer_fill_value": 0.0, "add_missing_indicator": True, "winsorize": {"enabled": True, "lower_quantile": 0.01, "upper_quantile": 0.99}, "scaler": "standard", "variance_threshold": None},
        "categorical": {"imputer": "constant", "imputer_fill_value": "__MISSING__", "rare_level": {"enabled": True, "min_frequency": 0.01, "other_label": "__RARE__"}, "encoder": "onehot", "onehot": {"handle_unknown": "infrequent_if_exist", "max_categories": None, "drop_first": False}, "woe": {"smoothing": 0.5, "clip": 4.0, "report_iv": True}, "target": {"cv": 5, "smooth": "auto"}},
        "inference_guard": {"enabled": True, "numeric_policy": "clip", "numeric_tolerance": 0.0, "coerce_numeric": True, "unseen_category_policy": "sentinel", "unseen_label": "__UNSEEN__", "missing_column_policy": "fill", "max_guarded_rate": 0.05, "warn": True},
    },
    "split": {"holdout_size": 0.2, "stratify": True, "strategy": "random", "group_column": None, "time_column": None, "cv": {"n_splits": 5, "n_repeats": 1, "shuffle": True}},
    "metrics": {"primary": "average_precision", "secondary": ["roc_auc", "ks", "recall_at_fpr", "lift_at_top_pct", "brier"], "recall_at_fpr": 0.01, "lift_top_pct": 0.05, "compute_train_scores": True, "decision_threshold_policy": "top_pct", "slice_columns": [], "min_slice_n": 50},
    "selection": {"ordering_strategy": "importance", "ordering_reference_model": "per_model", "importance": {"method": "auto", "permutation_repeats": 5, "scale_by_std": True, "aggregate": "sum"}, "rfe": {"step": 1, "aggregate": "min_rank"}, "k_min": 1, "k_max": None, "k_step": 1, "top_n": 3, "top_n_distinct_models": False, "one_se_rule": True, "marginal_gain_test": "paired_t"},
    "models": {},
    "tuning": {"enabled": False, "strategy": "random", "n_iter": 25, "top_n": 1, "inner_splits": 3, "param_spaces": {}},
}
MODEL = {"estimator": "", "params": {}, "enabled": True, "family": "other", "requires_scaling": False, "handles_categorical_natively": False, "imbalance": None, "tag": "", "preprocessing_overrides": {}}
CHOICES = {
    "data.format": ("csv", "parquet"), "run.save_predictions": ("none", "holdout", "cv", "all"), "split.strategy": ("random", "group", "time", "group_time"), "preprocessing.numeric.imputer": ("median", "mean", "constant"),
    "preprocessing.numeric.scaler": ("standard", "robust", "minmax", "none"), "preprocessing.categorical.imputer": ("constant", "most_frequent"), "preprocessing.categorical.encoder": ("onehot", "ordinal", "woe", "target"),
    "preprocessing.inference_guard.numeric_policy": ("clip", "nan", "passthrough", "error"), "preprocessing.inference_guard.unseen_category_policy": ("sentinel", "nan", "error"), "preprocessing.inference_guard.missing_column_policy": ("fill", "error"),
    "selection.ordering_strategy": ("importance", "rfe", "iv"), "selection.marginal_gain_test": ("paired_t", "wilcoxon", "none"), "tuning.strategy": ("random", "grid"),
}


def _merged(known: Mapping, given: Mapping, at: str = "") -> dict:
    out = copy.deepcopy(dict(known))
    for key, value in given.items():
        path = f"{at}.{key}".strip(".")
        if key not in known:
            raise ValueError(f"unknown configuration key {path!r}; known here: {sorted(known)}")
        if isinstance(known[key], Mapping) and known[key]:  # an empty section takes any keys
            if not isinstance(value, Mapping):
                raise ValueError(f"{path} must be a section of keys, not {value!r}")
            out[key] = _merged(known[key], value, path)
        else:
            out[key] = copy.deepcopy(value)
    return out


class Config:
    """Read by dotted paths; changed only into new ones."""

    def __init__(self, given: Mapping | None = None) -> None:
        self.tree = _merged(DEFAULTS, given or {})
        self.tree["models"] = {k: _merged(MODEL, v or {}, f"models.{k}") for k, v in self.tree["models"].items()}
        self.check()

    @classmethod
    def load(cls, path: str) -> Config:
        return cls(yaml.safe_load(Path(path).read_text()) or {})

    def __getitem__(self, path: str) -> object:
        at: object = self.tree
        for key in path.split("."):
            if not isinstance(at, Mapping) or key not in at:
                raise KeyError(path)
            at = at[key]
        return at

    def with_overrides(self, changes: Mapping[str, object]) -> Config:
        """A copy with values at dotted paths, checked like a file."""
        tree = copy.deepcopy(self.tree)
        for path, value in changes.items():
            *above, last = path.split(".")
            at = tree
            for key in above:
                if key not in at:
                    raise ValueError(f"unknown configuration key {path!r}")
                at = at[key]
            if last not in at:
                raise ValueError(f"unknown configuration key {path!r}; known here: {sorted(at)}")
            at[last] = value
        return Config(tree)

    def for_model(self, name: str) -> Config:
        """As the model wants it: its own preprocessing, no scaling unless it asks for it."""
        spec = self.tree["models"][name]
        changes = {} if spec["requires_scaling"] else {"preprocessing.numeric.scaler": "none"}
        return self.with_overrides(changes | {f"preprocessing.{k}": v for k, v in spec["preprocessing_overrides"].items()})

    def dump(self) -> str:
        return yaml.safe_dump(self.tree, sort_keys=False)

    def check(self) -> None:
        for path, allowed in CHOICES.items():
            if self[path] not in allowed:
                raise ValueError(f"{path} is {self[path]!r}, must be one of {list(allowed)}")
        for path in ("split.holdout_size",):
            if not 0 < self[path] < 1:
                raise ValueError(f"{path} must lie between 0 and 1")
        if self["split.cv.n_splits"] < 2:
            raise ValueError("split.cv.n_splits must be 2 at least")
        for strategy, column in (("group", "group_column"), ("time", "time_column")):
            if strategy in self["split.strategy"].split("_") and not self[f"split.{column}"]:
                raise ValueError(f"split.strategy {self['split.strategy']!r} needs split.{column}")
        if self["split.strategy"] in ("time", "group_time") and self["tuning.enabled"] and self["tuning.inner_splits"] == self["split.cv.n_splits"]:
            raise ValueError("tuning.inner_splits must differ from split.cv.n_splits when folds follow time")
        low, high = (self[f"preprocessing.numeric.winsorize.{k}_quantile"] for k in ("lower", "upper"))
        if not 0 <= low < high <= 1:
            raise ValueError("winsorize quantiles must be ascending within 0 and 1")
        if self["selection.k_max"] is not None and self["selection.k_max"] < self["selection.k_min"]:
            raise ValueError("selection.k_max must not be less than selection.k_min")
