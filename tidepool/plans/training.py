"""Training as a chain of saved stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.config import MAX_DIMENSIONS, RECENT_ITEMS, Params
from tidepool.operators import categories as cat
from tidepool.operators import factors as fac
from tidepool.operators import interactions as inter
from tidepool.operators import properties as prop
from tidepool.operators import sequences as seq
from tidepool.operators import textvec
from tidepool.operators import vector_index
from tidepool.plans.model import COMPONENTS, Model
from tidepool.sources.artifacts import ArtifactStore, combined, fingerprint


class Trainer:
    """Computes each component once, saves it, and reuses it only if its inputs and parameters match."""

    def __init__(self, spark: SparkSession, folder: str, params: Params | None = None, reuse: bool = True):
        self.spark = spark
        self.params = params or Params()
        self.store = ArtifactStore(spark, folder)
        self.reuse = reuse
        self.tables: dict[str, DataFrame] = {}
        self.index_record: dict | None = None

    def _stage(self, name: str, print_: str, compute) -> DataFrame:
        self.tables[name] = self.store.stage(name, print_, compute, self.reuse)
        return self.tables[name]

    # --- preprocessing -----------------------------------------------------------------------

    def preprocess(self, events: DataFrame, properties: DataFrame | None = None, tree: DataFrame | None = None, simple: bool = False) -> None:
        self._events_print = fingerprint(events)
        p = self.params
        self._stage("user_index", combined("users", self._events_print), lambda: inter.user_index(events))
        self._stage("item_index", combined("items", self._events_print), lambda: inter.item_index(events))
        self._matrix_print = combined("matrix", self._events_print, p.event_weights)
        self._stage("matrix", self._matrix_print, lambda: inter.interaction_matrix(events, p.event_weights))
        if simple:
            return
        self._stage("sequences", combined("sequences", self._events_print), lambda: seq.user_sequences(events))
        self._stage("recent_items", combined("recent", self._events_print), lambda: seq.recent_items(events, RECENT_ITEMS))
        if properties is not None:
            self._item_features(properties)
        if tree is not None:
            self._category_tree(tree)

    def _item_features(self, properties: DataFrame) -> None:
        p, source = self.params, fingerprint(properties)
        known = combined(source, self._events_print)
        latest = self._stage("latest_properties", source, lambda: prop.latest_properties(properties))
        self._stage("item_categories", combined("categories", source), lambda: prop.item_categories(latest))
        items = self.tables["item_index"]
        texts = self._stage("item_texts", combined("texts", known), lambda: prop.item_texts(latest, items))
        n_docs = texts.count()
        terms = textvec.item_tokens(prop.known_properties(latest, items))
        vocab_print = combined("vocabulary", known, p.min_df, p.max_df)
        vocab = self._stage(
            "vocabulary", vocab_print,
            lambda: textvec.vocabulary(textvec.term_counts(terms), n_docs, p.min_df, p.max_df),
        )
        vectors_print = combined("vectors", vocab_print, p.dimensions)
        vectors = self._stage("item_vectors", vectors_print, lambda: textvec.svd_item_vectors(terms, vocab, p.dimensions)[0])
        if p.neighbor_search == "index":
            self._neighbor_index(vectors, combined("index", vectors_print))

    def _neighbor_index(self, vectors: DataFrame, print_: str) -> None:
        """Tree, entries and homes of the neighbour index; its record is written last, so a run that breaks off leaves none."""
        names = {table: f"index_{table}" for table in vector_index.VectorIndex.TABLES}
        record = self.store.read_record("index") if self.reuse else None
        if record is not None and record["fingerprint"] == print_:
            for name in names.values():
                self._stage(name, print_, lambda: self.tables[name])
        else:
            self.store.write_record("index", {"fingerprint": None})
            built = vector_index.build(vectors)
            for table, name in names.items():
                partitions = vector_index.VectorIndex.PARTITIONS.get(table, ())
                self.tables[name] = self.store.save(name, getattr(built, table), print_, partitions)
            record = {"fingerprint": print_, "index": built.record}
            self.store.write_record("index", record)
        self.index_record = record["index"]

    def _category_tree(self, tree: DataFrame) -> None:
        source = fingerprint(tree)
        self._stage("category_nodes", combined("nodes", source), lambda: cat.category_nodes(tree))
        self._stage("category_similarity", combined("similarity", source), lambda: cat.category_similarity(tree))

    # --- models ------------------------------------------------------------------------------

    def train_factors(self) -> None:
        p, t = self.params, self.tables
        print_ = combined("als", self._matrix_print, p.factors, p.iterations, p.regularization, p.alpha, p.confidence, p.seed, p.blocks)
        trained: list[tuple[DataFrame, DataFrame]] = []

        def train(which: int) -> DataFrame:
            if not trained:
                trained.append(
                    fac.als_factors(
                        t["matrix"], t["user_index"], t["item_index"], p.factors, p.iterations, p.regularization,
                        p.alpha, p.confidence, p.seed, p.blocks,
                    )
                )
            return trained[0][which]

        # A factor table only fits the other one from the same run: the record of the pair is withdrawn before
        # either is written and set after both are, so a run that breaks off between them leaves no pair.
        pair = self.store.read_record("factors") if self.reuse else None
        keep = self.reuse
        self.reuse = pair is not None and pair["fingerprint"] == print_
        if not self.reuse:
            self.store.write_record("factors", {"fingerprint": None})
        try:
            self._stage("user_factors", print_, lambda: train(0))
            self._stage("item_factors", print_, lambda: train(1))
            self.store.write_record("factors", {"fingerprint": print_})
        finally:
            self.reuse = keep

    def train_transitions(self, events: DataFrame) -> None:
        self._stage(
            "transitions", combined("transitions", self._events_print),
            lambda: seq.transition_probs(seq.transition_counts(events)),
        )

    # --- whole runs --------------------------------------------------------------------------

    def fit(self, events: DataFrame, properties: DataFrame | None = None, tree: DataFrame | None = None) -> Model:
        self.preprocess(events, properties, tree)
        self.train_factors()
        self.train_transitions(events)
        return self._finish()

    def fit_simple(self, events: DataFrame) -> Model:
        """Ids, interaction matrix and factors only."""
        self.preprocess(events, simple=True)
        self.train_factors()
        return self._finish()

    def _finish(self) -> Model:
        summary = model_summary(self.params, self.tables) | ({"index": self.index_record} if self.index_record else {})
        self.store.write_record("model", {"params": self.params.as_dict(), "summary": summary, "components": sorted(self.tables)})
        return Model(self.params, self.tables, summary)


def model_summary(params: Params, tables: dict[str, DataFrame]) -> dict:
    vectors = tables.get("item_vectors")
    first = vectors.select(F.size("vec").alias("d")).first() if vectors is not None else None
    return {
        "has_cf": "user_factors" in tables,
        "has_content": first is not None,
        "has_sequential": "transitions" in tables,
        "factors": params.factors,
        "iterations": params.iterations,
        "regularization": params.regularization,
        "n_users": tables["user_index"].count(),
        "n_items": tables["item_index"].count(),
        "dimensions": first.d if first else min(MAX_DIMENSIONS, params.dimensions),
    }


def load_model(spark: SparkSession, folder: str) -> Model:
    """Everything that training saved. A missing component leaves its leg empty."""
    store = ArtifactStore(spark, folder)
    record = store.read_record("model")
    if record is None:
        raise FileNotFoundError(f"no completed model in {folder}")
    pair = store.read_record("factors")
    if pair is not None and pair["fingerprint"] is None:
        raise FileNotFoundError(f"the factors in {folder} come from a run that did not finish")
    tables = {name: store.read(name) for name in COMPONENTS if name in record["components"]}
    tables = {name: table for name, table in tables.items() if table is not None}
    return Model(Params(**record["params"]), tables, record["summary"])
