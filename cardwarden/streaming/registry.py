"""Saved models by id, so that a restarted engine scores with the models it had."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel

from cardwarden.operators.models import TreeBag
from cardwarden.sources.tables import Tables


class ModelRegistry:
    def __init__(self, tables: Tables):
        self._tables = tables
        self._loaded: dict[str, object] = {}

    def folder(self, model_id: str) -> str:
        return self._tables.path("models", model_id)

    def hold(self, model_id: str, model: object) -> None:
        """Have a model at hand that is being saved."""
        self._loaded[model_id] = model

    def save_bag(self, bag: TreeBag) -> None:
        bag.forest.write().overwrite().save(self.folder(bag.model_id))
        self._loaded[bag.model_id] = bag

    def bag(self, model_id: str) -> TreeBag:
        if model_id not in self._loaded:
            forest = RandomForestClassificationModel.load(self.folder(model_id))
            self._loaded[model_id] = TreeBag(model_id, int(model_id.split("-")[1]), forest)
        return self._loaded[model_id]

    def save_forest(self, model_id: str, forest: RandomForestClassificationModel) -> None:
        forest.write().overwrite().save(self.folder(model_id))
        self._loaded[model_id] = forest

    def forest(self, model_id: str | None) -> RandomForestClassificationModel | None:
        if model_id is None:
            return None
        if model_id not in self._loaded:
            self._loaded[model_id] = RandomForestClassificationModel.load(self.folder(model_id))
        return self._loaded[model_id]

    def drop(self, live: set[str | None]) -> None:
        """Delete the folders of all models but those of ``live``."""
        for model_id in self._tables.folders("models"):
            if model_id not in live:
                self._tables._drop(self.folder(model_id))

    def forget(self, live: set[str | None]) -> None:
        """Release the models that no longer score."""
        for model_id in [m for m in self._loaded if m not in live]:
            del self._loaded[model_id]
