"""The trained model: a set of tables, and batch questions to them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.config import NEIGHBORS_PER_RECENT, Params
from tidepool.functions.scalars import unit_vector
from tidepool.operators.interactions import known_only
from tidepool.operators.neighbors import best_matches, knn_exact, knn_forest
from tidepool.operators.vector_index import HEADS, VectorIndex
from tidepool.plans import recommend as rec
from tidepool.plans.evaluate import evaluate_lists
from tidepool.plans.reports import category_performance, explain_lists, plain_lists, user_reports
from tidepool.session import stage_table

COMPONENTS = (
    "user_index", "item_index", "matrix", "sequences", "recent_items", "latest_properties", "item_texts", "item_categories",
    "vocabulary", "item_vectors", "category_nodes", "category_similarity", "user_factors", "item_factors", "transitions",
    "index_nodes", "index_entries", "index_homes",
)


@dataclass
class Model:
    """``tables`` holds the components that were trained; a missing one means that leg is empty."""

    params: Params
    tables: dict[str, DataFrame]
    summary: dict

    def has(self, *names: str) -> bool:
        return all(name in self.tables for name in names)

    # --- single ids: one-row requests ----------------------------------------------------------

    def _one(self, key: str, value) -> DataFrame:
        return self.tables[key.replace("_id", "_index")].where(F.col(key) == F.lit(value)).select(key)

    def recommend_for_user(self, user_id, n: int = 10, method: str = "hybrid") -> DataFrame:
        return self.recommend(self._one("user_id", user_id), n, method)

    def get_similar_items(self, item_id, n: int = 10, method: str = "hybrid") -> DataFrame:
        return self.similar_items(self._one("item_id", item_id), n, method)

    def get_item_neighbors(self, item_id, n: int = 10) -> DataFrame:
        index = self.index()
        if index is not None and n < HEADS:
            return index.neighbors_of(item_id, n)
        return self.item_neighbors(self._one("item_id", item_id), n)

    # --- users -------------------------------------------------------------------------------

    def recommend(self, requests: DataFrame, n: int = 10, method: str = "hybrid") -> DataFrame:
        """``<user_id, item_id, score, rank>`` for every known user of ``requests<user_id>``."""
        rec.check_method(method, rec.USER_METHODS)
        users = stage_table(known_only(requests, self.tables["user_index"], "user_id"), "requests")
        legs = {"cf": self._cf, "content": self._content, "sequential": self._sequential}
        if method != "hybrid":
            return legs[method](users, n)
        return rec.blend_user_legs({name: leg(users, n) for name, leg in legs.items()}, n)

    def _nothing(self) -> DataFrame:
        users, items = self.tables["user_index"], self.tables["item_index"]
        return users.select("user_id").limit(0).select(
            "user_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"),
            F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank"),
        )

    def _cf(self, users: DataFrame, n: int) -> DataFrame:
        if not self.has("user_factors", "item_factors"):
            return self._nothing()
        t = self.tables
        return rec.cf_lists(t["user_factors"], t["item_factors"], t["matrix"], users, n, self.params.factors)

    def _recent(self, users: DataFrame) -> DataFrame:
        """Newest items of the asked users: at most a handful of rows per user, however busy."""
        return self.tables["recent_items"].join(users, "user_id", "left_semi")

    def _content(self, users: DataFrame, n: int) -> DataFrame:
        if not self.has("item_vectors", "recent_items"):
            return self._nothing()
        recent = stage_table(self._recent(users), "recent-items")
        neighbors = stage_table(self.item_neighbors(recent.select("item_id"), NEIGHBORS_PER_RECENT), "recent-neighbors")
        return rec.content_lists(recent, neighbors, n)

    def _sequential(self, users: DataFrame, n: int) -> DataFrame:
        if not self.has("transitions", "recent_items"):
            return self._nothing()
        last = self._recent(users).where("recency = 1").select("user_id", "item_id")
        return rec.sequential_lists(last, self.tables["transitions"], n)

    # --- items -------------------------------------------------------------------------------

    def index(self) -> VectorIndex | None:
        """The index saved by the training, if the model was trained with one."""
        names = [f"index_{table}" for table in VectorIndex.TABLES]
        return VectorIndex(*[self.tables[name] for name in names], self.summary["index"]) if self.has(*names) else None

    def item_neighbors(self, requests: DataFrame, n: int = 10) -> DataFrame:
        """``<item_id, neighbor_id, score, rank>`` by content; unknown items get no rows."""
        if not self.has("item_vectors"):
            return self._nothing().select("item_id", F.col("item_id").alias("neighbor_id"), "score", "rank")
        vectors = self.tables["item_vectors"]
        index = self.index()
        if index is not None and n < HEADS:
            return index.neighbors(requests, n)
        if self.params.neighbor_search == "forest":
            return knn_forest(vectors, n).join(requests.select("item_id").distinct(), "item_id", "left_semi")
        return knn_exact(vectors, n, self.summary["dimensions"], requests)

    def _similar_cf(self, items: DataFrame, n: int) -> DataFrame:
        unit = self._unit_factors()
        found = best_matches(
            unit.join(items, "item_id", "left_semi").select(F.col("item_id").alias("key"), "vec"),
            unit.select(F.col("item_id").alias("item"), "vec"), n, self.params.factors, drop_self=True,
        )
        return found.select(F.col("key").alias("item_id"), F.col("item").alias("similar_id"), "score", "rank")

    def _unit_factors(self) -> DataFrame:
        return self.tables["item_factors"].select("item_id", unit_vector(F.col("vec")).alias("vec"))

    def similar_items(self, requests: DataFrame, n: int = 10, method: str = "hybrid") -> DataFrame:
        """``<item_id, similar_id, score, rank>`` for every known item of ``requests<item_id>``."""
        rec.check_method(method, rec.ITEM_METHODS)
        items = stage_table(known_only(requests, self.tables["item_index"], "item_id"), "requests")
        nothing = self._nothing().select("item_id", F.col("item_id").alias("similar_id"), "score", "rank")
        cf = self._similar_cf(items, n) if method != "content" and self.has("item_factors") else nothing
        content = rec.similar_lists(self.item_neighbors(items, n)) if method != "cf" and self.has("item_vectors") else nothing
        if method == "hybrid":
            return rec.blend_similar(cf, content, n)
        return cf if method == "cf" else content

    # --- reports -----------------------------------------------------------------------------

    def explain(self, requests: DataFrame, n: int = 10, reasons: bool = True) -> DataFrame:
        """Hybrid recommendations with category and reasons.

        An item has content-similar items if it has a vector and some other item has one, and the same
        holds for factors, so no search is needed to tell.
        """
        lists = stage_table(self.recommend(requests, n), "lists")
        categories = self.tables.get("item_categories")
        if not reasons:
            return plain_lists(lists, categories)

        def items_of(component: str) -> DataFrame | None:
            table = self.tables.get(component)
            return table.select("item_id") if table is not None and len(table.take(2)) == 2 else None

        return explain_lists(lists, categories, items_of("item_factors"), items_of("item_vectors"))

    def user_reports(self, requests: DataFrame, n: int = 10, reasons: bool = True) -> DataFrame:
        return user_reports(requests, self.explain(requests, n, reasons), n)

    def category_performance(self, events: DataFrame, top: int | None = 10) -> DataFrame:
        """Funnel of the top categories; no rows if the model has no item categories."""
        none = self.tables["item_index"].select("item_id", F.lit("").alias("category")).limit(0)
        return category_performance(events, self.tables.get("item_categories", none), top)

    def evaluate(
        self, events: DataFrame, k: int = 10, n_users: int = 1000, method: str = "hybrid", count_empty: bool = False
    ) -> DataFrame:
        """Hit rate and MRR on the newest event of sampled users.

        Judge a model trained on ``leave_one_out(events)`` to keep that event out of the training data.
        """
        def lists(requests: DataFrame, size: int) -> DataFrame:
            return stage_table(self.recommend(requests, size, method), "judged-lists")

        t = self.tables
        return evaluate_lists(lists, events, t["user_index"], t["item_index"], k, n_users, self.params.evaluation_seed, count_empty)
