import pytest

from linkblocks.blocks import BlockSet, CompositeBlockSet, NNBlockSet
from linkblocks.functions.text import Tokenizer
from linkblocks.operators import (
    AttributeClusteringLSHBlocker,
    AttributeClusteringTokenBlocker,
    CompositeAttributeClusteringBlocker,
    CompositeDeepBlocker,
    CompositeEmbeddingBlocker,
    CompositeLightEABlocker,
    CompositeRelationalTokenBlocker,
    CompositeTokenClusteringLSHBlocker,
    DeepBlocker,
    EmbeddingBlocker,
    MinHashLSHBlocker,
    PartitioningTokenBlocker,
    QgramsBlocker,
    RelationalDeepBlocker,
    RelationalLSHBlocker,
    RelationalTokenAttributeBlocker,
    RelationalTokenBlocker,
    SimpleRelationalLSHBlocker,
    SimpleRelationalTokenBlocker,
    SortedNeighborhoodBlocker,
    StandardBlocker,
    TfIdfTokenBlocker,
    TokenBlocker,
    TokenClusteringTokenBlocker,
    UniqueNameBlocker,
)
from linkblocks.operators.lsh import band_shape
from linkblocks.vectors.encoders import AutoencoderEncoder, AverageEncoder, CrossTupleEncoder, GcnEncoder, HybridEncoder, LightEAEncoder, SifEncoder
from linkblocks.vectors.knn import HdbscanBuilder, SinkhornBuilder

from .fixtures import TOKENS, as_sets, blocks_by, grams, relations, triples, unique_names, wide


def test_standard(spark):
    want = blocks_by(lambda r, c: {r[c.index("Country")]} - {None})
    assert want["Norway"] == ({"a1", "a2"}, {"b2"}) and as_sets(StandardBlocker("Country").assign(*wide(spark))) == want


def test_qgrams(spark):
    want = blocks_by(grams("Country", 3))
    assert len(want) > 5 and as_sets(QgramsBlocker("Country", 3).assign(*wide(spark))) == want


@pytest.mark.parametrize("kind", ["wide", "triples", "mixed"])
def test_token(spark, kind):
    left, right = {"wide": wide, "triples": triples, "mixed": lambda s: (wide(s)[0], triples(s)[1])}[kind](spark)
    assert as_sets(TokenBlocker().assign(left, right)) == TOKENS
    part = PartitioningTokenBlocker().assign(left, right)
    plain = {(r.left_id, r.right_id) for r in TokenBlocker().assign(left, right).all_pairs().collect()}
    assert sorted((r.left_id, r.right_id) for r in part.all_pairs().collect()) == sorted(plain)
    assert as_sets(part)["a5"] == ({"a5"}, set())


def test_lsh(spark):
    assert as_sets(MinHashLSHBlocker().assign(*wide(spark))) == {f"b{k}": ({f"a{k}"}, {f"b{k}"}) for k in (1, 2, 3)}
    assert band_shape(0.5, 128) == (25, 5) and band_shape(0.2, 128, (0.2, 0.8)) == (56, 2)
    with pytest.raises(ValueError):
        band_shape(0.5, 128, (0.5, 0.6))


def test_unique_names(spark):
    assert len(unique_names()) == 3 and as_sets(UniqueNameBlocker().assign(*triples(spark))) == unique_names()
    with pytest.raises(ValueError):
        UniqueNameBlocker().assign(*wide(spark))


def test_tfidf(spark):
    left, right = wide(spark)
    assert as_sets(TfIdfTokenBlocker(0).assign(left, right)) == TOKENS
    some = as_sets(TfIdfTokenBlocker(0.45).assign(left, right))
    assert some and set(some) < set(TOKENS)
    for k in ({"norm": "l1"}, {"sublinear_tf": True}, {"smooth_idf": False}, {"use_idf": False}, {"norm": None}):
        assert set(as_sets(TfIdfTokenBlocker(0.01, **k).assign(left, right))) == set(TOKENS)


def test_sorted_neighborhood(spark):
    b = SortedNeighborhoodBlocker("Released", 3).assign(*wide(spark))
    pairs = {(r.left_id, r.right_id) for r in b.all_pairs().collect()}
    assert {("a1", "b1"), ("a2", "b2"), ("a3", "b3")} <= pairs and ("a1", "b5") not in pairs


def test_python_tokenizer(spark):
    from linkblocks.functions.text import python_tokens

    left, right = wide(spark)
    assert as_sets(TokenBlocker(Tokenizer(split=python_tokens(str.split))).assign(left, right)) == TOKENS


@pytest.mark.parametrize("blocker", [SimpleRelationalTokenBlocker(), SimpleRelationalTokenBlocker(top_n_a=2, top_n_r=1), RelationalTokenBlocker(), RelationalTokenAttributeBlocker(), CompositeRelationalTokenBlocker(), SimpleRelationalLSHBlocker(threshold=0.3), RelationalLSHBlocker(num_perm=32)], ids=lambda b: type(b).__name__)
def test_relational(spark, blocker):
    blocks = blocker.assign(*triples(spark), *relations(spark))
    assert isinstance(blocks, BlockSet)
    for a, b in blocks.to_dict().values():
        assert a and b and all(x[0] == "a" for x in a) and all(x[0] == "b" for x in b)
    with pytest.raises(ValueError):
        blocker.assign(*triples(spark))


def test_composite_leaves_matched_entities_out(spark):
    got = as_sets(CompositeRelationalTokenBlocker().assign(*triples(spark), *relations(spark)))
    rest = {k: v for k, v in got.items() if not k.startswith("unique_")}
    assert len(got) - len(rest) == 3 and not any(v[0] & {"a1", "a2", "a3"} or v[1] & {"b1", "b2", "b3"} for v in rest.values())


SMALL = {"hidden": (6, 4), "epochs": 3}


@pytest.mark.parametrize("encoder", [AverageEncoder(size=6), SifEncoder(size=6), SifEncoder(size=6, reduce_to=3), AutoencoderEncoder(SifEncoder(size=6), **SMALL), CrossTupleEncoder(SifEncoder(size=6), **SMALL), HybridEncoder(SifEncoder(size=6), **SMALL)], ids=lambda e: type(e).__name__)
def test_embedding(spark, encoder, tmp_path):
    b = EmbeddingBlocker(encoder, save_dir=str(tmp_path / "v")).assign(*wide(spark))
    assert isinstance(b, NNBlockSet) and len(b) == 5 and b.all_pairs().count() == 25
    again = EmbeddingBlocker.from_encoded(spark, str(tmp_path / "v"))
    assert sorted(again.df.collect()) == sorted(b.df.collect())


def test_builders_and_trained_only(spark):
    left, right = wide(spark)
    assert EmbeddingBlocker(AverageEncoder(size=6), SinkhornBuilder(2)).assign(left, right).all_pairs().count() == 10
    assert isinstance(EmbeddingBlocker(AverageEncoder(size=6), HdbscanBuilder(2)).assign(left, right), BlockSet)
    with pytest.raises(ValueError):
        DeepBlocker(AverageEncoder())


@pytest.mark.parametrize("encoder", [LightEAEncoder(AverageEncoder(size=4)), LightEAEncoder(AverageEncoder(size=4), only_neighbors=True), GcnEncoder(AverageEncoder(size=4), layer_dims=5), GcnEncoder(AverageEncoder(size=4), layers=False, aggr="mean")], ids=lambda e: type(e).__name__)
def test_graph_encoders(spark, encoder):
    left, right = triples(spark)
    a, b = encoder.encode(left.texts(), right.texts(), *relations(spark))
    assert {r.name for r in a.collect()} == {f"a{k}" for k in range(1, 6)} and b.count() == 5
    assert {len(r.vec) for r in a.collect()} == {len(b.first().vec)}


@pytest.mark.parametrize("blocker", [AttributeClusteringTokenBlocker(text_encoder=AverageEncoder(size=4), min_cluster_size=2, noise="token"), AttributeClusteringLSHBlocker(text_encoder=AverageEncoder(size=4), min_cluster_size=2, noise="remove"), TokenClusteringTokenBlocker(text_encoder=AverageEncoder(size=4), min_cluster_size=2)], ids=lambda b: type(b).__name__)
def test_clustering(spark, blocker):
    assert isinstance(blocker.assign(*triples(spark)), BlockSet)


def test_composites(spark):
    args = (*triples(spark), *relations(spark))
    e = AverageEncoder(size=4)
    assert isinstance(CompositeAttributeClusteringBlocker(text_encoder=e, min_cluster_size=2).assign(*args), BlockSet)
    assert isinstance(CompositeTokenClusteringLSHBlocker(text_encoder=e, min_cluster_size=2, lsh={"num_perm": 32}).assign(*args), BlockSet)
    assert isinstance(CompositeEmbeddingBlocker(e).assign(*args), CompositeBlockSet)
    assert isinstance(CompositeDeepBlocker(AutoencoderEncoder(e, **SMALL)).assign(*args), CompositeBlockSet)
    light = CompositeLightEABlocker(LightEAEncoder(e, only_neighbors=True)).assign(*args)
    assert {r.left_id for r in light.neighbors.df.collect()} == {"a4", "a5"}
    deep = AutoencoderEncoder(e, **SMALL)
    assert isinstance(RelationalDeepBlocker(deep, deep).assign(*args), NNBlockSet)
