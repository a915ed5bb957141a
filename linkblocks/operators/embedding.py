"""Blocks by vectors of texts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from ..sources.storage import load_vectors, save_vectors
from ..vectors.encoders import TRAINED, Encoder, encoder
from ..vectors.knn import builder
from .base import Blocker


class EmbeddingBlocker(Blocker):
    """Texts to vectors to blocks. With ``save_dir`` the vectors are kept there and used again unless ``force``."""

    def __init__(self, text_encoder: Encoder | str | None = None, block_builder=None, save_dir: str | None = None, force: bool = False):
        self.encoder, self.builder = encoder(text_encoder), builder(block_builder)
        self.save_dir, self.force = save_dir, force

    def vectors(self, left: DataFrame, right: DataFrame, left_rel=None, right_rel=None) -> tuple[DataFrame, DataFrame]:
        """(name, vec) of both sides of (id, text)."""
        if self.save_dir and not self.force:
            try:
                return load_vectors(left.sparkSession, self.save_dir)
            except (FileNotFoundError, AnalysisException):
                pass
        found = self.encoder.encode(left, right, left_rel, right_rel)
        if self.save_dir:
            save_vectors(*found, self.save_dir)
            return load_vectors(left.sparkSession, self.save_dir)
        return found

    def assign(self, left, right, left_rel=None, right_rel=None):
        return self.assign_texts(left.texts(), right.texts(), left.name, right.name, left_rel, right_rel)

    def assign_texts(self, left, right, left_name="left", right_name="right", left_rel=None, right_rel=None):
        return self.builder.build(*self.vectors(left, right, left_rel, right_rel), left_name, right_name)

    @classmethod
    def from_encoded(cls, spark, save_dir: str, block_builder=None, left_name: str = "left", right_name: str = "right"):
        """Blocks of saved vectors."""
        return builder(block_builder).build(*load_vectors(spark, save_dir), left_name, right_name)


class DeepBlocker(EmbeddingBlocker):
    """An embedding blocker whose encoder is trained on the texts."""

    def __init__(self, text_encoder: Encoder | str | None = None, block_builder=None, save_dir: str | None = None, force: bool = False):
        found = encoder(text_encoder or "autoencoder")
        if not isinstance(found, TRAINED):
            raise ValueError("the encoder is not one that is trained")
        super().__init__(found, block_builder, save_dir, force)
