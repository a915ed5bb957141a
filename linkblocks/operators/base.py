"""What all blockers share."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame

from ..model import EntityFrame


class Blocker(ABC):
    @abstractmethod
    def assign(self, left: EntityFrame, right: EntityFrame, left_rel: DataFrame | None = None, right_rel: DataFrame | None = None):
        """Blocks of the two tables."""


class TextBlocker(Blocker):
    """Blocks by the text of all attributes, whatever the schemas."""

    def assign(self, left, right, left_rel=None, right_rel=None):
        return self.assign_texts(left.texts(), right.texts(), left.name, right.name)

    @abstractmethod
    def assign_texts(self, left: DataFrame, right: DataFrame, left_name: str = "left", right_name: str = "right"):
        """Blocks of two (id, text) frames."""
