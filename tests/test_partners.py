import numpy as np
import pyarrow as pa
import pytest

from linkblocks.functions.text import Tokenizer
from linkblocks.metrics import n_pairs
from linkblocks.operators import partners
from linkblocks.operators.token import PartitioningTokenBlocker, TokenBlocker

WORDS = ["red", "green", "blue", "of", "apple pear", "plum tree red", "kiwi", ""]


@pytest.mark.parametrize("rare", [0, 2, 1000])
def test_partners_equal_listed_pairs(spark, monkeypatch, rare):
    monkeypatch.setattr(partners, "RARE", rare)
    monkeypatch.setattr(partners, "RIGHT", 2)
    monkeypatch.setattr(partners, "LEFT", 2)
    rows = lambda p, k: spark.createDataFrame([(f"{p}{i}", None if i == 5 else f"{WORDS[i % 8]} {WORDS[i * k % 7]}") for i in range(40)] + [(f"{p}0", "kiwi"), (f"{p}0", "lime")], "id string, text string")
    left, right = rows("a", 3), rows("b", 5)
    blocks = TokenBlocker(Tokenizer()).assign_texts(left, right)
    pairs = {tuple(r) for r in blocks.all_pairs().collect()}
    assert n_pairs(blocks, distinct=True).first()[0] == len(pairs)
    got = {r.block_id: r.n_right for r in PartitioningTokenBlocker().assign_texts(left, right).sizes().collect()}
    assert got == {r.id: sum(a == r.id for a, _ in pairs) for r in left.select("id").distinct().collect()}


def test_a_right_group_is_read_once_for_all_left_ones(spark, monkeypatch):
    """Groups of the right side that meet several left ones in turn, with weights."""
    r = np.random.RandomState(4)
    sets = [np.unique(r.randint(0, 60, r.randint(0, 12))) for _ in range(150)]
    sizes, toks, weight = np.array([len(x) for x in sets]), np.concatenate(sets).astype(np.int64), r.randint(1, 9, 150)
    for rare in (0, 3, 1000):
        monkeypatch.setattr(partners, "RARE", rare)
        held = partners.Held(toks, sizes, weight)
        want = [sum(int(w) for y, w in zip(sets, weight, strict=True) if len(np.intersect1d(x, y))) for x in sets]
        assert held.counts(toks, sizes).tolist() == want
    group = lambda k: {"value": weight[k].tolist(), "toks": [sets[i].tolist() for i in k]}
    made, kept = [], partners.Held
    monkeypatch.setattr(partners, "Held", lambda *a: made.append(1) or kept(*a))
    rows = [group(np.arange(i, i + 50)) for i in (0, 50, 100)]
    cell = lambda g: [{"value": v, "toks": t} for v, t in zip(g["value"], g["toks"], strict=True)]
    kind = pa.list_(pa.struct([("value", pa.int64()), ("toks", pa.list_(pa.int64()))]))
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0, 0, 1]), pa.array([cell(rows[0])] * 3 + [cell(rows[1])], kind), pa.array([cell(x) for x in (*rows, rows[0])], kind)], ["r_pack", "r", "l"])
    assert sum(b.num_rows for b in partners._meet([batch])) == 200 and len(made) == 2
