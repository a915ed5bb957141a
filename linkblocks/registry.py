"""Blockers by name, as the command line and configuration files call them."""

from __future__ import annotations

from . import operators as O
from .functions.text import Tokenizer
from .vectors.encoders import GcnEncoder, LightEAEncoder, encoder
from .vectors.knn import builder


def _off(n):
    """A negative number of top attributes or relations means all."""
    return None if n is None or n < 0 else n


def _lsh(o: dict) -> dict:
    fn = o.get("fn_weight", 0.5)
    return {"threshold": o.get("threshold", 0.5), "num_perm": o.get("num_perm", 128), "weights": (1 - fn, fn)}


def _tops(o: dict) -> dict:
    return {"top_n_a": _off(o.get("top_n_a")), "top_n_r": _off(o.get("top_n_r"))}


def _tokens(o: dict) -> Tokenizer:
    return Tokenizer(o.get("min_token_length", 3))


def _vectors(o: dict) -> dict:
    return {"text_encoder": encoder(o.get("encoder")), "block_builder": builder(o.get("builder"), **o.get("builder_options", {}))}


def _deep(o: dict) -> dict:
    return {"text_encoder": encoder(o.get("encoder", "autoencoder"), **o.get("encoder_options", {})), "block_builder": builder(o.get("builder"), **o.get("builder_options", {}))}


def _clusters(o: dict) -> dict:
    return {"text_encoder": encoder(o.get("encoder")), "noise": o.get("noise", "keep"), "min_cluster_size": o.get("min_cluster_size", 5)}


def _graph(kind, o: dict):
    inner = encoder(o["encoder"], **o.get("encoder_options", {})) if o.get("encoder") else None
    return O.EmbeddingBlocker(kind(inner, depth=o.get("depth", 2)), builder(o.get("builder"), **o.get("builder_options", {})))


BLOCKERS = {
    "token": lambda o: O.TokenBlocker(_tokens(o)),
    "partitioning-token": lambda o: O.PartitioningTokenBlocker(_tokens(o)),
    "tfidf-token": lambda o: O.TfIdfTokenBlocker(o.get("threshold", 0.1), _tokens(o)),
    "standard": lambda o: O.StandardBlocker(o["key"]),
    "qgrams": lambda o: O.QgramsBlocker(o["key"], o.get("q", 3)),
    "sorted-neighborhood": lambda o: O.SortedNeighborhoodBlocker(o["key"], o.get("window", 3)),
    "unique-name": lambda o: O.UniqueNameBlocker(),
    "lsh": lambda o: O.MinHashLSHBlocker(_tokens(o), **_lsh(o)),
    "relational-lsh": lambda o: O.RelationalLSHBlocker(o.get("threshold", 0.5), o.get("rel_threshold", 0.7), **_tops(o), num_perm=o.get("num_perm", 128)),
    "simple-relational-lsh": lambda o: O.SimpleRelationalLSHBlocker(**_tops(o), **_lsh(o)),
    "relational-token": lambda o: O.SimpleRelationalTokenBlocker(_tokens(o), **_tops(o)),
    "two-view-relational-token": lambda o: O.RelationalTokenBlocker(_tokens(o), **_tops(o)),
    "relational-token-attribute": lambda o: O.RelationalTokenAttributeBlocker(_tokens(o), **_tops(o)),
    "deepblocker": lambda o: O.DeepBlocker(**_deep(o)),
    "relational-deepblocker": lambda o: O.RelationalDeepBlocker(_deep(o)["text_encoder"], _deep(o)["text_encoder"], _deep(o)["block_builder"], _deep(o)["block_builder"], **_tops(o)),
    "light-ea": lambda o: _graph(LightEAEncoder, o),
    "gcn": lambda o: _graph(GcnEncoder, o),
    "gcn-deepblocker": lambda o: _graph(GcnEncoder, {"encoder": "autoencoder"} | o),
    "light-ea-deepblocker": lambda o: _graph(LightEAEncoder, {"encoder": "autoencoder"} | o),
    "only-embeddings": lambda o: O.EmbeddingBlocker(**_vectors(o)),
    "composite-relational-token": lambda o: O.CompositeRelationalTokenBlocker(_tokens(o), **_tops(o)),
    "composite-relational-deepblocker": lambda o: O.CompositeDeepBlocker(**_deep(o), **_tops(o)),
    "composite-light-ea": lambda o: O.CompositeLightEABlocker(None, builder(o.get("builder"), **o.get("builder_options", {}))),
    "composite-only-embeddings": lambda o: O.CompositeEmbeddingBlocker(**_vectors(o)),
    "composite-attribute-clustering": lambda o: O.CompositeAttributeClusteringBlocker(_tokens(o), **_tops(o), **_clusters(o)),
    "composite-token-clustering": lambda o: O.CompositeTokenClusteringBlocker(_tokens(o), **_tops(o), **_clusters(o)),
    "composite-attribute-clustering-lsh": lambda o: O.CompositeAttributeClusteringLSHBlocker(_tokens(o), **_tops(o), **_clusters(o), lsh=_lsh({"threshold": 0.2, "fn_weight": 0.8} | o)),
    "composite-token-clustering-lsh": lambda o: O.CompositeTokenClusteringLSHBlocker(_tokens(o), **_tops(o), **_clusters(o), lsh=_lsh({"threshold": 0.2, "fn_weight": 0.8} | o)),
}


def blocker(name: str, **options) -> O.Blocker:
    if name not in BLOCKERS:
        raise ValueError(f"blocker is one of {sorted(BLOCKERS)}")
    return BLOCKERS[name](options)
