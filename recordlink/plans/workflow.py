"""The whole deduplication as a sequence of steps over one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from recordlink.config import RecordSpec
from recordlink.operators import matching, scoring
from recordlink.operators.classify import LinearRule, cut_for_share
from recordlink.operators.cleaning import preprocess
from recordlink.operators.clustering import ClusterModel, elbow, fit_clusters
from recordlink.operators.embedding import (
    check_measurable,
    choose_basis,
    collect_basis,
    embed,
    tiled_weights,
)
from recordlink.operators.groups import duplicate_groups
from recordlink.operators.pairs import limit_pairs, records_with_gold, strict_pairs, working_set
from recordlink.operators.training import PARTNERS, Trained, block_distances, gold_distances, train
from recordlink.session import checkpoint, spread, stored
from recordlink.sources.files import load_records, save_records

EMBEDDING = "embedding"


class Deduplication:
    """Learn weights, embed, cluster, match inside clusters, score, save.

    Every step stores its result as an attribute and needs those before it. ``gold``
    is a table to learn the weights from, where it is not the table itself.
    """

    def __init__(self, records: DataFrame, spec: RecordSpec, gold: DataFrame | None = None):
        self.spec = spec.validate(records)
        self.records = records
        self.gold = records if gold is None else gold
        spec.validate(self.gold)

    @staticmethod
    def load(
        spark: SparkSession,
        path: str,
        spec: RecordSpec,
        geo: DataFrame | None = None,
        nrows: int | None = None,
        schema=None,
        clean: bool = True,
        gold: str | None = None,
    ) -> "Deduplication":
        """Read a table from files and, unless told otherwise, clean it.

        ``gold`` is the path of a table to learn the weights from; it is cleaned as well.
        """

        def read(source: str, rows: int | None) -> DataFrame:
            df = load_records(spark, source, schema, rows, spec.id_col)
            return preprocess(df, spec, geo) if clean else df

        return Deduplication(read(path, nrows), spec, None if gold is None else read(gold, None))

    @staticmethod
    def of_blocks(records: DataFrame, spec: RecordSpec) -> "Deduplication":
        """Start at ``match`` with a table whose ``spec.cluster_col`` holds blocks already.

        Any column will do; a constant one compares the whole table.
        """
        run = Deduplication(records, spec)
        run.clustered = records
        return run

    def _step(self, attribute: str, step: str):
        if not hasattr(self, attribute):
            raise ValueError(f"call {step} first")
        return getattr(self, attribute)

    def learn_weights(
        self,
        n: int | None = None,
        train_ratio: float = 0.5,
        estimator: Estimator | None = None,
        standardize: bool = True,
        training: bool = False,
        test_size: float = 0.4,
        spec: RecordSpec | None = None,
    ) -> Trained:
        """Fit a linear classifier on gold pairs; its coefficients weight the columns.

        Here and in the other steps ``spec`` compares other columns, or by other
        distances, than the run does by default.
        """
        spec = (spec or self.spec).validate(self.gold)
        labelled = gold_distances(self.gold, spec, n, train_ratio)
        self.weights_model = train(labelled, spec, estimator, standardize, training, test_size)
        return self.weights_model

    def embed(
        self,
        n: int | None = None,
        ratio: float = 0.1,
        k: int = 10,
        splits: int = 10,
        skew: bool = True,
        basis: DataFrame | Sequence[Row] | None = None,
        spec: RecordSpec | None = None,
        labels: DataFrame | None = None,
    ) -> DataFrame:
        """Embed all records, or with ``n`` the gold pairs and others up to ``ratio``.

        ``labels`` (id and ``true_label``) replaces the labels of the strict pairs, for
        instance to count groups of three or more in ``cluster_score``.
        """
        spec = (spec or self.spec).validate(self.records)
        check_measurable(self.records, spec)
        self.weights = None
        if skew:
            learnt = self._step("weights_model", "learn_weights").classifier.coefficients
            unknown = [c for c in spec.columns if c not in learnt]
            if unknown:
                raise ValueError(f"no weights were learnt for columns {unknown}")
            weights = [learnt[c] for c in spec.columns]
            self.weights = tiled_weights(weights, len(weights), splits)
        pairs = strict_pairs(self.records, self.spec)
        if n is not None:
            pairs = limit_pairs(pairs, n, self.spec.seed)
        records = records_with_gold(self.records, checkpoint(pairs), self.spec)
        if labels is not None:
            own = labels.select(self.spec.id_col, "true_label")
            records = records.drop("true_label").join(own, self.spec.id_col, "left")
        if n is not None:
            records = working_set(checkpoint(records), self.spec.id_col, n, ratio)
        records = spread(checkpoint(records))
        if basis is None:
            basis = choose_basis(records, spec, k, spec.seed)
        rows = collect_basis(basis, spec, k) if isinstance(basis, DataFrame) else list(basis)
        if len(rows) != k:
            raise ValueError(f"the basis must have {k} records, but has {len(rows)}")
        self.basis = rows
        self.embedded = checkpoint(embed(records, spec, rows, splits, True, EMBEDDING))
        return self.embedded

    def cluster(
        self,
        n_clusters: int | str = 400,
        weight_exp: float = 8,
        n_features: int | None = 16,
        standardize: bool = True,
        estimator: Estimator | None = None,
    ) -> DataFrame:
        """Cluster the weighted embeddings; clusters are the blocks of the next step.

        ``n_clusters`` may be ``"suggested"``: the table's size over its logarithm, for
        tables of up to about a million records, as the centres are held on the driver.
        """
        embedded = self._step("embedded", "embed")
        if n_clusters == "suggested":
            n_clusters = max(2, round(scoring.suggested_clusters(max(embedded.count(), 3))))
        self.cluster_model: ClusterModel = fit_clusters(
            embedded, EMBEDDING, n_clusters, self.weights, weight_exp, n_features, standardize,
            estimator, self.spec.seed,
        )
        assigned = self.cluster_model.assign(embedded.drop(self.spec.cluster_col), self.spec.cluster_col)
        self.clustered = checkpoint(assigned.drop(EMBEDDING))
        return self.clustered

    def elbow(self, cluster_counts: Sequence[int] = range(2, 51), **options) -> DataFrame:
        """Clustering score against the number of clusters."""
        embedded = self._step("embedded", "embed")
        return elbow(embedded, EMBEDDING, cluster_counts, self.weights, seed=self.spec.seed, **options)

    def cluster_score(self) -> DataFrame:
        return scoring.cluster_score(self._step("clustered", "cluster"), self.spec.cluster_col)

    def false_negatives(self) -> DataFrame:
        return scoring.cluster_false_negatives(
            self._step("clustered", "cluster"), self.spec.cluster_col
        )

    def find_cluster(self, record_id: object) -> DataFrame:
        clustered = self._step("clustered", "cluster")
        return scoring.find_cluster(clustered, self.spec.id_col, record_id, self.spec.cluster_col)

    def match(
        self,
        n: int | None = None,
        ratio: float = 0.1,
        estimator: Estimator | None = None,
        standardize: bool = True,
        training: bool = False,
        test_size: float = 0.4,
        rule: LinearRule | None = None,
        spec: RecordSpec | None = None,
        partners: int = PARTNERS,
        keys: Sequence[Sequence[str]] | None = None,
    ) -> DataFrame:
        """Find the duplicates inside clusters and label the records with them.

        The rule is learnt on pairs inside clusters, unless one is given. It is learnt
        where ``ratio`` of the pairs are duplicates; in the blocks far fewer are, so its cut
        is moved to where F1 is best with the shares that the blocks' counts tell. An
        estimator that learns no linear rule needs ``keys``, sets of columns: it predicts
        the pairs that agree on all columns of one of them.
        """
        clustered = self._step("clustered", "cluster")
        self.match_spec = spec = (spec or self.spec).validate(clustered)
        block = self.spec.cluster_col
        self.comparisons = scoring.count_comparisons(clustered, block)
        self.match_model: Trained | None = None
        if rule is None:
            labelled = block_distances(clustered, spec, block, n, ratio, partners)
            self.match_model = train(labelled, spec, estimator, standardize, training, test_size)
            classifier = self.match_model.classifier
            rule = classifier.rule if hasattr(classifier.model, "coefficients") else classifier
            if isinstance(rule, LinearRule):
                sums = scoring.block_pair_labels(clustered, spec, block).agg(
                    F.sum("duplicate_pairs").cast("double"), F.sum("nonduplicate_pairs").cast("double")
                ).first()
                n_true, n_false = self.match_model.n_true, self.match_model.n_false
                if sums[0] and n_true and n_false:
                    false_weight = (sums[1] / n_false) / (sums[0] / n_true)
                    rule = cut_for_share(rule, self.match_model.train, false_weight)
        self.rule = rule
        self.profiles, _ = stored(matching.profiles(clustered, spec, block), "profiles")
        self.pairs = matching.duplicate_pairs(self.profiles, spec, rule, block, keys)
        self.labelled = matching.duplicate_labels(clustered, self.profiles, self.pairs, spec, block)
        return self.labelled

    def scores(self, decimals: int = 5, held_out: bool = False) -> DataFrame:
        """Precision, recall, specificity and accuracy over all pairs with known label.

        With ``held_out`` the pairs that ``match`` learnt its rule on are not counted.
        """
        pairs = self._step("pairs", "match")
        common = (self.match_spec, self.spec.cluster_col, decimals)
        if not held_out:
            return scoring.confusion_scores(self.clustered, self.profiles, pairs, *common)
        if self.match_model is None:
            raise ValueError("the rule was given, so no pairs were trained on")
        trained = self.match_model.train
        return scoring.confusion_scores_held_out(self.clustered, self.profiles, pairs, trained, *common)

    def groups(self) -> DataFrame:
        """Records with the group of duplicates they are in, and how many are in it."""
        pairs = self._step("pairs", "match")
        return duplicate_groups(
            self.clustered, self.profiles, pairs, self.match_spec, self.spec.cluster_col
        )

    def save(self, path: str, encoding: str = "parquet", mode: str = "error") -> str:
        return save_records(self._step("labelled", "match"), path, encoding, mode)
