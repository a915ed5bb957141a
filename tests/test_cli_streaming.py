import json

from linkblocks import cli, streaming
from linkblocks.operators import MinHashLSHBlocker, TokenBlocker
from linkblocks.registry import BLOCKERS, blocker
from linkblocks.trackers import TableTracker, flattened, run_id

from .fixtures import relations, triples, wide


def test_run_and_evaluate(spark, tmp_path):
    left, right = triples(spark)
    at = lambda n: str(tmp_path / n)
    left.df.write.parquet(at("l"))
    right.df.write.parquet(at("r"))
    spark.createDataFrame([(f"a{i}", f"b{i}") for i in (1, 2, 3)], "l string, r string").write.parquet(at("g"))
    for n, r in zip(("lr", "rr"), relations(spark), strict=True):
        r.write.parquet(at(n))
    common = ["--left", at("l"), "--right", at("r"), "--gold", at("g"), "--left-rel", at("lr"), "--right-rel", at("rr"), "--track", at("t")]
    got = cli.main(["run", *common, "--blocker", "token", "--options", json.dumps({"min_token_length": 4}), "--out", at("b")], spark)
    assert got["recall"] == 1 and got["time_in_s"] > 0
    again = cli.main(["evaluate", *common, "--blocks", at("b")], spark)
    assert {k: v for k, v in got.items() if k != "time_in_s"} == again
    cli.main(["run", *common, "--blocker", "composite-relational-token", "--options", json.dumps({"top_n_a": -1}), "--out", at("b2")], spark)
    assert spark.read.parquet(at("t")).where("name = 'recall'").count() == 3


def test_registry_and_trackers(spark, tmp_path):
    for name in BLOCKERS:
        blocker(name, key="x")
    assert flattened({"a": {"b": 1}, "c": 2}) == {"a.b": 1, "c": 2}
    assert run_id({"a": 1, "b": 2}) == run_id({"b": 2, "a": 1})
    t = TableTracker(spark, str(tmp_path / "t"), "r")
    t.metrics({"x": {"y": 1.5}})
    assert t.table().first().value == "1.5"


def test_stream_finds_what_a_batch_finds(spark, tmp_path):
    left, right = wide(spark)
    texts = left.texts()
    texts.write.parquet(str(tmp_path / "in"))
    index = streaming.token_index(right.texts())
    stream = spark.readStream.schema(texts.schema).parquet(str(tmp_path / "in"))
    q = streaming.token_candidates(stream, index).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.left_id, r.right_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.left_id, r.right_id) for r in TokenBlocker().assign(left, right).all_pairs().collect()}
    lsh = MinHashLSHBlocker(threshold=0.3, num_perm=32)
    pairs = {(r.left_id, r.right_id) for r in streaming.band_candidates(texts, streaming.band_index(right.texts(), lsh), lsh).collect()}
    assert pairs == {(r.left_id, r.right_id) for r in lsh.candidate_pairs(left.texts(), right.texts()).collect()}
