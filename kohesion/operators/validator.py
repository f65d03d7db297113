"""The validator: fit, select, label, report, save and load."""

from __future__ import annotations

import logging
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from kohesion.functions import accuracy, agreement, consensus, features, products, sampling, selection
from kohesion.functions.indices import gamma_grid, knn
from kohesion.operators import clustering, labels
from kohesion.plans import planner
from kohesion.sources.state import load_state, save_state, settle

log = logging.getLogger(__name__)


@dataclass
class Fitted:
    """What a fit leaves: tables, each a DataFrame, and the settings."""

    results: DataFrame
    resample_scores: DataFrame
    runs: DataFrame
    sample_scores: DataFrame | None
    prediction_scores: DataFrame | None
    preprocessing: DataFrame
    features: DataFrame | None
    settings: dict[str, Any]


class Validator:
    """Stability and generalizability of clusterings over a grid of configurations.

    ``fit`` takes a table (sample_id, x).  ``n_jobs`` is accepted for
    familiarity; Spark's own parallelism decides.
    """

    def __init__(
        self,
        n_clusters: int | Sequence[int] = 10,
        n_resamples: int = 100,
        subsample_ratio: float = sampling.RATIO,
        estimator_param_grids: str | Sequence[planner.GridSpec] = "light",
        normalization_options: Sequence | None = None,
        dim_reduction_options: Sequence | None = None,
        classifier: str | Callable | None = None,
        n_trees: int = 100,
        reference_labels: Sequence | None = None,
        n_jobs: int = 1,
        random_state: int | None = 0,
        verbose: int = 0,
    ):
        if not 0 < subsample_ratio < 1:
            raise ValueError("subsample_ratio must be inside (0, 1)")
        self.n_clusters, self.n_resamples, self.subsample_ratio = n_clusters, n_resamples, subsample_ratio
        self.estimator_param_grids = estimator_param_grids
        self.normalization_options, self.dim_reduction_options = normalization_options, dim_reduction_options
        self.classifier, self.n_trees, self.reference_labels = classifier, n_trees, reference_labels
        self.n_jobs, self.random_state, self.verbose = n_jobs, random_state or 0, verbose
        self.fitted: Fitted | None = None

    # ------------------------------------------------------------ fit

    def _grids(self, x: DataFrame) -> list[planner.GridSpec]:
        if not isinstance(self.estimator_param_grids, str):
            return list(self.estimator_param_grids)
        gammas = [r["gamma"] for r in gamma_grid(knn(x)).orderBy("multiple").collect()] if self.estimator_param_grids == "full" else ()
        return planner.default_grids(planner.cluster_counts(self.n_clusters), self.estimator_param_grids, gammas)

    def fit(self, x: DataFrame, *, reference_labels: Sequence | None = None, randomize_preprocessing: bool = False, mode: str = "default", random_state: int | None = None) -> Validator:
        branches = planner.plan_branches(mode)
        if mode != "default":
            warnings.warn("modes other than default are experimental", RuntimeWarning, stacklevel=2)
        if self.classifier is not None and self.n_trees != 100:
            warnings.warn("n_trees is ignored with a custom classifier", RuntimeWarning, stacklevel=2)
        if reference_labels is not None:
            self.reference_labels = reference_labels
        seed = self.random_state if random_state is None else random_state
        spark = x.sparkSession
        configs = planner.plan_configs(self._grids(x))
        shape = x.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("p")).first()
        log.info("fitting %d configurations on %d rows of %d features, %d resamples at %.3f", len(configs), shape["n"], shape["p"], self.n_resamples, self.subsample_ratio)
        norms = planner.NORMALIZATIONS if self.normalization_options is None else self.normalization_options
        reductions = planner.default_reductions(shape["n"], shape["p"], self.subsample_ratio) if self.dim_reduction_options is None else self.dim_reduction_options
        # Resamples that drew the same steps share their preprocessed table.
        drawn: dict[tuple, list[int]] = {}
        for b in range(self.n_resamples):
            drawn.setdefault(planner.draw_pipeline(norms, reductions, seed + b, randomize_preprocessing), []).append(b)
        members = settle(sampling.membership(x, self.n_resamples, self.subsample_ratio, seed, second=planner.STABILITY in branches))
        runs, steps = None, []
        for (norm, reduce), resamples in drawn.items():
            table = x
            for step in (norm, reduce):
                if step.kind != "identity":
                    table = features.apply_step(table, step.kind, dict(step.params))
            own = members if len(drawn) == 1 else members.filter(F.col("resample").isin(resamples))
            part = clustering.cluster_runs(table, own, configs, branches, self.classifier or "forest", {} if self.classifier else {"n_trees": self.n_trees}, seed, n_resamples=len(resamples))
            runs = part if runs is None else runs.union(part)
            steps += [(b, norm.name, str(dict(norm.params)), reduce.name, str(dict(reduce.params))) for b in resamples]
        runs = settle(runs)
        self._finish(spark, x, runs, configs, mode, steps, shape["n"], seed)
        return self

    def _finish(self, spark, x, runs, configs, mode, steps, n, seed) -> None:
        branches = planner.plan_branches(mode)
        predicted = runs.filter("split = 'test'").select("config_id", "resample", "sample_id", F.col("label").alias("label_true"), "label_pred")
        stability = agreement.stability_ari(runs) if planner.STABILITY in branches else None
        general = agreement.generalizability_ari(predicted) if planner.GENERALIZABILITY in branches else None
        resample = settle(agreement.resample_scores(stability, general))
        table = clustering.config_table(spark, configs)
        metrics = resample.groupBy("config_id").agg(*[c for m in ("ari_stability", "ari_generalizability", "ari_average") for c in agreement.summary_columns(m, m)])
        results = table.join(metrics, "config_id", "left")
        samples, pac = consensus.consensus_scores_blocked(runs.filter("split = 'train'"))
        samples = settle(samples)
        results = results.join(pac.withColumnRenamed("pac", "consensus_pac_stability"), "config_id", "left").join(consensus.config_scores(samples, F.lit(n)), "config_id", "left")
        scored = settle(accuracy.sample_accuracy(predicted, x)) if planner.GENERALIZABILITY in branches else None
        if scored is None:
            results = results.withColumn("accuracy_generalizability", F.lit(None).cast("double"))
        else:
            results = results.join(accuracy.config_accuracy(scored), "config_id", "left")
        preprocessing = spark.createDataFrame(steps, "resample int, norm_name string, norm_params string, dr_name string, dr_params string")
        settings = {"n_resamples": self.n_resamples, "subsample_ratio": self.subsample_ratio, "random_state": seed, "mode": mode, "n_samples": n}
        self.fitted = Fitted(settle(results), resample, runs, samples, scored, preprocessing, x, settings)
        log.info("fitted %d configurations", len(configs))

    def _ready(self) -> Fitted:
        if self.fitted is None:
            raise RuntimeError("call fit first")
        return self.fitted

    # ------------------------------------------------------------ selection

    def get_row(self, measure: str = "stability", rule: str = "1se", not_two: bool = False, k: int | None = None) -> Row:
        return selection.chosen(self._ready().results, measure, rule, not_two, k)

    def get_k(self, measure: str = "stability", rule: str = "1se", not_two: bool = False) -> int:
        return int(self.get_row(measure, rule, not_two)["n_clusters"])

    def get_estimator(self, measure: str = "stability", rule: str = "1se", not_two: bool = False, k: int | None = None) -> tuple[str, dict]:
        """(estimator, hyper-parameters) of the selected configuration."""
        row = self.get_row(measure, rule, not_two, k)
        return row["estimator"], selection.hyper_params(row)

    def consensus(self, config_id: int, mode: str = "default") -> DataFrame:
        """Consensus pairs of one configuration, from the subsamples' clusterings or the held-out predictions."""
        return consensus.consensus_pairs(self._runs(config_id, mode))

    def _runs(self, config_id: int, mode: str) -> DataFrame:
        planner.plan_branches(mode)
        fitted = self._ready()
        runs = fitted.runs.filter(F.col("config_id") == config_id)
        if mode == planner.GENERALIZABILITY:
            if fitted.prediction_scores is None:
                raise RuntimeError("this fit has no held-out predictions")
            return runs.filter("split = 'test'").withColumn("label", F.col("label_pred"))
        return runs.filter("split = 'train'")

    def _ids(self) -> np.ndarray:
        fitted = self._ready()
        source = fitted.features if fitted.features is not None else fitted.runs
        return np.sort(source.select("sample_id").distinct().toArrow().column(0).to_numpy())

    def get_labels(self, measure: str = "stability", rule: str = "1se", k: int | None = None, not_two: bool = False, mode: str = "default", estimator: Callable | None = None, reference: Sequence | None = None) -> np.ndarray:
        """Consensus labels by ascending sample id.  Nothing is remembered: the same call gives the same labels."""
        row = self.get_row(measure, rule, not_two, k)
        wanted = reference if reference is not None else self.reference_labels
        if wanted is not None:
            _, first, wanted = np.unique(np.asarray(wanted), return_index=True, return_inverse=True)
        return labels.consensus_labels(self._runs(row["config_id"], mode), self._ids(), int(k or row["n_clusters"]), wanted, estimator)

    def label_table(self, **options) -> DataFrame:
        found = self.get_labels(**options)
        spark = self._ready().results.sparkSession
        return spark.createDataFrame(pa.table({"sample_id": self._ids(), "label": found.astype(np.int32)}))

    # ------------------------------------------------------------ reports

    def preprocessing_summary(self) -> DataFrame:
        """Mean indices by drawn preprocessing and number of clusters."""
        fitted = self._ready()
        ks = fitted.results.select("config_id", "n_clusters")
        joined = fitted.resample_scores.join(fitted.preprocessing, "resample").join(ks, "config_id")
        return joined.groupBy("norm_name", "dr_name", "n_clusters").agg(*[F.avg(m).alias(m) for m in ("ari_stability", "ari_generalizability", "ari_average")])

    def warnings_table(self) -> DataFrame:
        """Runs that found another number of clusters than asked for."""
        fitted = self._ready()
        return agreement.label_count_warnings(fitted.runs, fitted.results)

    def metric_over_n_clusters(self, measure: str = "stability") -> DataFrame:
        return products.metric_over_k(self._ready().results, measure)

    def scores(self, config_id: int, kind: str = "gini") -> DataFrame:
        """(sample_id, score) of one configuration: gini, ce or accuracy."""
        fitted = self._ready()
        table = fitted.prediction_scores if kind == "accuracy" else fitted.sample_scores
        if table is None:
            raise RuntimeError(f"this fit has no {kind} scores")
        return table.filter(F.col("config_id") == config_id).select("sample_id", F.col(kind).alias("score"))

    def consensus_heatmap(self, mode: str = "default", **select) -> DataFrame:
        row = self.get_row(**select)
        return products.heatmap(self.consensus(row["config_id"], mode), products.block_order(self.label_table(mode=mode, **select)))

    def cluster_quartiles(self, kind: str = "gini", **select) -> DataFrame:
        row = self.get_row(**select)
        return products.cluster_quartiles(self.scores(row["config_id"], kind).join(self.label_table(**select), "sample_id"), "score")

    def scatter(self, kind: str = "gini", **select) -> DataFrame:
        """(sample_id, px, py, label, score, size, alpha, draw order)."""
        fitted = self._ready()
        if fitted.features is None:
            raise RuntimeError("this state was saved without its features")
        row = self.get_row(**select)
        points = products.projection(fitted.features).join(self.label_table(**select), "sample_id").join(self.scores(row["config_id"], kind), "sample_id", "left")
        return products.scatter_encoding(points, "score")

    # ------------------------------------------------------------ state

    def save(self, path: str, include_data: bool = False) -> None:
        f = self._ready()
        tables = {"results": f.results, "resample_scores": f.resample_scores, "runs": f.runs, "sample_scores": f.sample_scores, "prediction_scores": f.prediction_scores, "preprocessing": f.preprocessing, "features": f.features if include_data else None}
        save_state(f.results.sparkSession, path, tables, f.settings)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Validator:
        tables, settings = load_state(spark, path)
        out = cls(n_resamples=settings["n_resamples"], subsample_ratio=settings["subsample_ratio"], random_state=settings["random_state"])
        out.fitted = Fitted(tables["results"], tables["resample_scores"], tables["runs"], tables.get("sample_scores"), tables.get("prediction_scores"), tables["preprocessing"], tables.get("features"), settings)
        return out
