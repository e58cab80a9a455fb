"""An estimator in the manner of fit / fit_predict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from denspark.plans.cluster import dbscan
from denspark.storage import checkpointed

_NAMES = ("eps", "min_samples", "metric", "metric_params", "algorithm", "leaf_size", "p", "n_jobs")


class SparkDBSCAN:
    """Density-based clustering of the feature columns of a DataFrame.

    Only the Euclidean metric is there; parameters that would ask for another search
    structure or number of jobs are refused.  ``fit`` sets ``labels_``,
    ``core_sample_indices_`` and ``components_`` as DataFrames, ``n_features_in_`` and
    ``feature_names_in_``.
    """

    def __init__(self, eps=0.5, *, min_samples=5, metric="euclidean", metric_params=None, algorithm="auto", leaf_size=30, p=None, n_jobs=None):
        refused = {"metric": metric != "euclidean", "algorithm": algorithm not in ("auto", "kd_tree"), "leaf_size": leaf_size != 30, "p": p not in (None, 2), "n_jobs": n_jobs is not None}
        if bad := [name for name, no in refused.items() if no]:
            raise NotImplementedError(f"not supported: {', '.join(bad)}")
        self.eps, self.min_samples, self.metric, self.metric_params = eps, min_samples, metric, metric_params
        self.algorithm, self.leaf_size, self.p, self.n_jobs = algorithm, leaf_size, p, n_jobs

    def get_params(self, deep: bool = True) -> dict:
        return {name: getattr(self, name) for name in _NAMES}

    def set_params(self, **params) -> SparkDBSCAN:
        if unknown := set(params) - set(_NAMES):
            raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
        self.__init__(**(self.get_params() | params))
        return self

    def fit_predict(self, df: DataFrame, y=None, sample_weight=None, *, features: Sequence[str] | str | None = None, id_col: str = "id", dim: int | None = None, max_dims: int = 20, neighbor_rule: str = "exact") -> DataFrame:
        """(id, label). Features are all columns but the id, unless named, or one array column of ``dim`` numbers; ``y`` is ignored."""
        if sample_weight is not None:
            raise NotImplementedError("not supported: sample_weight")
        features = features if isinstance(features, str) else list(features) if features is not None else [c for c in df.columns if c != id_col]
        names = [features] if isinstance(features, str) else features
        if len(names) == 1 and df.schema[names[0]].dataType.typeName() == "array":
            features = names[0]
            if dim is None:  # that of the first row
                first = df.select(F.size(features)).first()
                dim = first[0] if first else None
        labelled = checkpointed(dbscan(df, features, self.eps, self.min_samples, id_col, dim, max_dims, neighbor_rule))  # read by all three results
        self.labels_ = labelled.select(id_col, "label")
        core = labelled.where("is_core")
        self.core_sample_indices_, self.components_ = core.select(id_col), core.select(*names)
        self.n_features_in_, self.feature_names_in_ = (dim if isinstance(features, str) else len(names)), names
        return self.labels_

    def fit(self, df: DataFrame, y=None, sample_weight=None, **names) -> SparkDBSCAN:
        self.fit_predict(df, y, sample_weight, **names)
        return self


def counts(labelled: DataFrame) -> DataFrame:
    """Number of clusters and of noise rows."""
    return labelled.agg(F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n_clusters"), F.count_if(F.col("label") < 0).alias("n_noise"))
