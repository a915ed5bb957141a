"""Registered queries of composed blockers, neighbour sets and joint evaluations, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..blocks import BlockSet, NNBlockSet, combine_blocks
from ..functions import text as X
from ..functions.lineage import settled
from ..metrics import Evaluation, compare, compare_many, minimal_evaluation
from ..model import EntityDataset, EntityFrame
from ..operators import composite as C
from ..operators import graph as G
from ..operators.clustering import AttributeClusteringLSHBlocker, AttributeClusteringTokenBlocker, TokenClusteringLSHBlocker, TokenClusteringTokenBlocker, as_triples
from ..operators.embedding import EmbeddingBlocker
from ..operators.lsh import permutations
from ..operators.relational import RelationalLSHBlocker, SimpleRelationalLSHBlocker, SimpleRelationalTokenBlocker
from ..operators.standard import SortedNeighborhoodBlocker
from ..operators.token import TokenBlocker
from ..sources.storage import read_blocks, write_blocks
from ..vectors import encoders as E
from ..vectors import knn as K
from . import inputs as I
from .catalog import _BOTH, _COUNT, _HASHVEC, _HM, _N, _N1, _OWN, _VEC, BIG, TOK, _blocks_sql, _dimp, _graph, _n, _nations, _near_sql, _top_sql, copy_hits, doc_blocks, query

# LSH of composed texts

SHAPE = (4, 2)


def _lsh_sql(texts: str, name: str) -> str:
    """{name} (block_id, side, id) of the LSH blocks of a relation (side, id, text), hashed as the blocker does."""
    bands, rows = SHAPE
    perm = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(permutations(bands * rows)))
    return f"""{name}t as (select side, id, text from {texts}), {name}k as (select distinct side, id, tok from ({I.tokens_sql(f'{name}t')})),
{name}h as (select side, id, cast(('0x' || substr(md5(tok), 1, 7)) as bigint) as h from {name}k), {name}p(i, a, b) as (values {perm}),
{name}g as (select side, id, i, min((a * h + b) % 2147483647) as v from {name}h cross join {name}p group by side, id, i),
{name}b as (select side, id, i // {rows} as band, string_agg(cast(v as varchar), ',' order by i) as k from {name}g group by side, id, i // {rows}
  union all select side, id, unnest(range({bands})), 'none' from {name}t where (side, id) not in (select side, id from {name}k)),
{name}q as (select distinct a.id as l, b.id as r from {name}b a join {name}b b on a.band = b.band and a.k = b.k where a.side = 0 and b.side = 1),
{name} as (select r as block_id, 0 as side, l as id from {name}q union select r, 1, r from {name}q)"""


@query(f"with {I.GRAPH}, {_near_sql(0, True)}, {_near_sql(1, True)}, {_lsh_sql(_BOTH, 'b')} {_COUNT.format('b')}")
def relational_lsh_simple(spark, sf) -> DataFrame:
    return SimpleRelationalLSHBlocker(shape=SHAPE).assign(*_graph(spark, sf)).sizes()


@query(f"with {I.GRAPH}, {_near_sql(0, False)}, {_near_sql(1, False)}, {_lsh_sql(_OWN, 'o')}, {_lsh_sql(_BOTH, 'p')}, b as (select * from o union select * from p) {_COUNT.format('b')}")
def relational_lsh_two_view(spark, sf) -> DataFrame:
    return RelationalLSHBlocker(shape=SHAPE).assign(*_graph(spark, sf)).sizes()


def _topn_sql(k: int, n: str) -> str:
    """x{k} as in _near_sql with own text, of each head's most important attribute and relation alone."""
    rel = f"r{k}"
    return f"""ia{k} as (select relation, {_HM} as importance from (select relation, count(head) / min(n) as s, count(tail) / count(*) as d from a{k} cross join {n} group by relation)),
ir{k} as (select relation, {_HM} as importance from (select relation, count(*) / (min(n) * min(n)) as s, count(tail) / count(*) as d from {rel} cross join {n} group by relation)),
ea{k} as (select head, relation, tail from {rel} union all select tail, relation, head from {rel}),
ka{k} as (select head, relation from (select head, relation, row_number() over (partition by head order by importance desc nulls last, relation) as rk from (select distinct head, relation from a{k}) left join ia{k} using (relation)) where rk <= 1),
kr{k} as (select head, relation from (select head, relation, row_number() over (partition by head order by importance desc nulls last, relation) as rk from (select distinct head, relation from ea{k}) left join ir{k} using (relation)) where rk <= 1),
t{k} as (select head as id, string_agg(distinct trim(coalesce(tail, '')), ' ') as text from a{k} join ka{k} using (head, relation) group by head),
x{k} as (select id, string_agg(distinct trim(text), ' ') as text from (select e.head as id, t.text from ea{k} e join kr{k} using (head, relation) join t{k} t on t.id = e.tail union all select id, text from t{k}) group by id)"""


@query(f"with {I.GRAPH}, {_N}, {_N1}, {_topn_sql(0, 'n')}, {_topn_sql(1, 'nb')}, {_blocks_sql(_BOTH)} {_COUNT.format('b')}")
def relational_token_top(spark, sf) -> DataFrame:
    return SimpleRelationalTokenBlocker(top_n_a=1, top_n_r=1).assign(*_graph(spark, sf)).sizes()


# composites


_ONE = """a as (select 0 as side, * from a0 union all select 1, * from a1), one as (select side, tail, min(head) as id from a where tail is not null group by side, tail having count(distinct head) = 1),
u as (select 'unique_' || tail as block_id, side, id from one where tail in (select tail from one group by tail having count(*) = 2))"""
_REST = "(select * from {} q where not exists (select 1 from u where u.side = q.side and u.id = q.id))"
_T = ", ".join(f"t{k} as (select head as id, string_agg(distinct trim(coalesce(tail, '')), ' ' order by trim(coalesce(tail, ''))) as text from a{k} group by head)" for k in (0, 1))


@query(f"with {I.GRAPH}, {_T}, {_ONE}, {_blocks_sql(_REST.format(_OWN), 'p')}, b as (select * from u union select * from p) {_COUNT.format('b')}")
def composite_attribute_token(spark, sf) -> DataFrame:
    return C.CompositeUniqueNameBlocker(TokenBlocker()).assign(*_graph(spark, sf)).sizes()


def _label(col) -> str:
    return f"cast(length({col}) % 5 - 1 as varchar)"


def _labels(values: DataFrame) -> DataFrame:
    """(value, label): labels that any engine can compute, -1 to 3."""
    return values.select(F.col("tail").alias("value")).where("value is not null").distinct().withColumn("label", (F.length("value") % 5 - 1).cast("int"))


def _values(spark, sf) -> DataFrame:
    left, right = (I.graph_attributes(spark, sf, k) for k in (0, 1))
    return as_triples(left).unionByName(as_triples(right))


_LABELLED = f"lt as (select side, head as id, string_agg(distinct trim('clustering_label_' || {_label('tail')}), ' ') as text from a where tail is not null group by side, head)"


@query(f"with {I.GRAPH}, {_ONE}, {_LABELLED}, {_blocks_sql('lt')} {_COUNT.format('b')}")
def clustered_attribute_tokens(spark, sf) -> DataFrame:
    left, right, *_ = _graph(spark, sf)
    return AttributeClusteringTokenBlocker(given=_labels(_values(spark, sf))).assign(left, right).sizes()


def _density_sql(values: str, size: int) -> str:
    """dl (side, tail, label) of the values of a relation (side, tail): density clusters of at least two of mean hashed token vectors, as the blocker finds them.

    With two, the core distance of a vector is that of its nearest one, and mutual reachability the distance itself.
    A tree of least distances grows from the first value (dp), joins values and groups in ascending order (dj), and is
    cut into clusters wherever two groups meet (dc); those that last longer than what is in them are chosen (dw).
    """
    places = f"(select unnest(range({size})) as p)"
    return f"""dv as materialized (select side, tail, row_number() over (order by side, tail) - 1 as i from (select distinct side, tail from {values})),
dt as (select i, unnest(regexp_extract_all(tail, '{I._PATTERN}')) as tok from dv), dm as (select i, p, avg({_HASHVEC.format('tok')}) as x from dt cross join {places} group by i, p),
de as (select i, list(coalesce(x, {_HASHVEC.format('tail')}) order by p) as v from dv cross join {places} left join dm using (i, p) group by i),
dd as materialized (select x.i, list(list_distance(x.v, y.v) order by y.i) as row from de x cross join de y group by x.i),
dp as materialized (select 0 as step, cast(0 as bigint) as i, cast(null as bigint) as par, cast(null as double) as w, list_transform(row, lambda d, j: case when j > 1 then d end) as best, list_transform(row, lambda d: cast(0 as bigint)) as src from dd where i = 0
  union all select step + 1, q.i, src[q.i + 1], best[q.i + 1], list_transform(list_zip(best, row), lambda z, j: case when j <> q.i + 1 then least(z[1], case when z[1] is not null then z[2] end) end),
  list_transform(list_zip(best, row, src), lambda z: case when z[2] < z[1] then q.i else z[3] end) from (select step, best, src, list_position(best, list_min(best)) - 1 as i from dp where list_min(best) is not null) q join dd on dd.i = q.i),
dg as materialized (select row_number() over (order by w, step) as k, par, i, w from dp where step > 0),
dj as materialized (select cast(0 as bigint) as k, cast(null as bigint) as l, cast(null as bigint) as r, cast(null as double) as w, list(i order by i) as home, count(*) - 1 as n from dv
  union all select q.k, q.l, q.r, q.w, list_transform(q.home, lambda x: case when x in (q.l, q.r) then n + q.k else x end), n from (select g.k, home[par + 1] as l, home[g.i + 1] as r, g.w, home, n from dj join dg g on g.k = dj.k + 1) q),
dn as materialized (select n + k as node, unnest([l, r]) as child, unnest([0, 1]) as turn, l > n and r > n as parts, case when w > 0 then 1 / w else 1e12 end as lam, n from dj where k > 0),
ds as materialized (select n + k as child, len(list_filter(home, lambda x: x = n + k)) as size from dj where k > 0 union all select i, 1 from dv),
dc as materialized (select max(node) as node, max(node) as c, '' as path from dn union all select child, case when parts then child else c end, case when parts then path || (1 - turn) else path end from dc join dn using (node)),
db as materialized (select child as c, c as above, lam as birth, path, turn from dn join dc using (node) where parts union all select max(node), null, 0, null, null from dn),
dy as (select c, sum(size * (lam - birth)) as stability from dn join dc using (node) join db using (c) join ds using (child) where parts or child <= n group by c),
dr as materialized (select c, stability, row_number() over (order by c) as r from dy), dk as materialized (select above as c, min(r) as one, max(r) as two from db join dr using (c) group by above),
dw as materialized (select cast(0 as bigint) as r, cast(null as bigint) as c, false as own, cast([] as double[]) as worth
  union all select q.r, q.c, not more, list_append(worth, case when more then below else stability end) from (select *, coalesce(below > stability, false) as more from (select y.r, y.c, stability, worth, worth[one] + worth[two] as below from dw join dr y on y.r = dw.r + 1 left join dk on dk.c = y.c)) q),
do_ as (select c, cast(null as bigint) as top from db where above is null union all select b.c, coalesce(top, case when own then b.c end) from do_ join db b on b.above = do_.c join dw on dw.c = b.c),
dx as (select c as top, row_number() over (order by path, turn) - 1 as label from db where c in (select top from do_)),
dl as (select side, tail, coalesce(label, -1) as label from dv left join dc on dc.node = dv.i left join do_ on do_.c = dc.c left join dx using (top))"""


_CLUSTERED = "lt as (select a.side, head as id, string_agg(distinct 'clustering_label_' || label, ' ') as text from a join dl on dl.side = a.side and dl.tail = a.tail group by a.side, head)"


@query(f"with recursive {I.GRAPH}, {_ONE}, {_density_sql('a where tail is not null', 8)}, {_CLUSTERED}, {_lsh_sql('lt', 'b')} {_COUNT.format('b')}")
def clustered_attribute_lsh(spark, sf) -> DataFrame:
    left, right, *_ = _graph(spark, sf)
    return AttributeClusteringLSHBlocker(lsh={"shape": SHAPE}, text_encoder=E.AverageEncoder(size=8), min_cluster_size=2).assign(left, right).sizes()


def _token_labels(spark, sf) -> DataFrame:
    return _labels(X.exploded_tokens(_values(spark, sf).select(F.col("head").alias("id"), F.col("tail").alias("text")), TOK).select(F.col("tok").alias("tail")))


# a label -1 is noise: its token stands for itself
_TOKEN_LABELLED = f"""v as (select distinct side, id, tok from ({I.tokens_sql('(select side, head as id, tail as text from a where tail is not null)')})),
lt as (select side, id, string_agg(distinct 'clustering_label_' || case when length(tok) % 5 = 0 then tok else {_label('tok')} end, ' ') as text from v group by side, id)"""


@query(f"with {I.GRAPH}, {_ONE}, {_TOKEN_LABELLED}, {_blocks_sql('lt')} {_COUNT.format('b')}")
def clustered_token_tokens(spark, sf) -> DataFrame:
    left, right, *_ = _graph(spark, sf)
    return TokenClusteringTokenBlocker(noise="token", given=_token_labels(spark, sf)).assign(left, right).sizes()


@query(f"with {I.GRAPH}, {_ONE}, {_TOKEN_LABELLED}, {_lsh_sql('lt', 'b')} {_COUNT.format('b')}")
def clustered_token_lsh(spark, sf) -> DataFrame:
    left, right, *_ = _graph(spark, sf)
    return TokenClusteringLSHBlocker(lsh={"shape": SHAPE}, noise="token", given=_token_labels(spark, sf)).assign(left, right).sizes()


_VALUES = """nv as (select distinct side, head, tail from (select 0 as side, e0.head, t0.text as tail from e0 join t0 on t0.id = e0.tail union all select 0, id, text from t0
  union all select 1, e1.head, t1.text from e1 join t1 on t1.id = e1.tail union all select 1, id, text from t1) q where not exists (select 1 from u where u.side = q.side and u.id = q.head))"""


@query(f"""with {I.GRAPH}, {_near_sql(0, False)}, {_near_sql(1, False)}, {_ONE}, {_VALUES}, {_blocks_sql(_REST.format(_OWN), 'p')},
lt as (select side, head as id, string_agg(distinct 'clustering_label_' || {_label('tail')}, ' ') as text from nv group by side, head), {_blocks_sql('lt', 'c')},
b as (select * from u union select * from p union select * from c) {_COUNT.format('b')}""")
def composite_clustering(spark, sf) -> DataFrame:
    left, right, lr, rr = _graph(spark, sf)
    near = [G.neighbor_values(f, r) for f, r in ((left, lr), (right, rr))]
    given = _labels(near[0].unionByName(near[1]))
    return C.CompositeAttributeClusteringBlocker(given=given).assign(left, right, lr, rr).sizes()


@query(f"""with {I.GRAPH}, {_N}, {_dimp('r0', 'count(distinct (head, tail)) / (min(n) * min(n))', 'i0')}, {_N1}, {_dimp('r1', 'count(distinct (head, tail)) / (min(n) * min(n))', 'i1').replace('cross join n ', 'cross join nb ')},
{_top_sql(0, 'r0', 'i0', 1, 'k0')}, {_top_sql(1, 'r1', 'i1', 1, 'k1')}, {_T},
y as (select side, id, string_agg(distinct trim(text), ' ') as text from (select 0 as side, k0.head as id, t0.text from k0 join t0 on t0.id = k0.tail union all select 0, id, text from t0
  union all select 1, k1.head, t1.text from k1 join t1 on t1.id = k1.tail union all select 1, id, text from t1) group by side, id), {_blocks_sql('y')} {_COUNT.format('b')}""")
def filtered_neighbor_blocks(spark, sf) -> DataFrame:
    return G.filtered_neighbor_blocks(*_graph(spark, sf), TokenBlocker(), 1).sizes()


@query("""with k as (select 0 as side, cast(c_custkey as varchar) as id, split_part(c_name, '#', 2) as key from customer union all select 1, cast(s_suppkey as varchar), split_part(s_name, '#', 2) from supplier),
r as (select side, id, row_number() over (order by key, side, id) as place from k where key is not null), m as (select side, id, unnest(range(greatest(place - 2, 1), place + 1)) as block_id from r),
b as (select cast(block_id as varchar) as block_id, sum(1 - side) as l, sum(side) as r from m group by 1)
select block_id, cast(l as bigint) as n_left, cast(r as bigint) as n_right from b where l > 0 and r > 0""")
def sorted_neighborhood(spark, sf) -> DataFrame:
    side = lambda t, k, c, n: EntityFrame(I.read(spark, sf, t).select(k, F.split_part(F.col(c), F.lit("#"), F.lit(2)).alias("number")), k, n)
    return SortedNeighborhoodBlocker("number", 3).assign(side("customer", "c_custkey", "c_name", "left"), side("supplier", "s_suppkey", "s_name", "right")).sizes()


# neighbour sets

_NN = """nn as (select cast(c_custkey as varchar) as left_id, cast(rk - 1 as integer) as rank, cast(s_suppkey as varchar) as right_id from customer join
(select s_nationkey, s_suppkey, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as rk from supplier) on c_nationkey = s_nationkey where rk <= {}), k as (select max(rank) + 1 as k from nn)"""


def _neighbours(spark, sf, n: int) -> NNBlockSet:
    """For each customer the n suppliers of its nation with the highest balances."""
    s = I.read(spark, sf, "supplier").select("s_nationkey", F.struct((-F.col("s_acctbal")).alias("b"), F.col("s_suppkey").alias("id")).alias("s"))
    s = s.groupBy("s_nationkey").agg(F.slice(F.sort_array(F.collect_list("s")), 1, n).alias("best"))
    rows = I.read(spark, sf, "customer").join(F.broadcast(s), F.col("c_nationkey") == F.col("s_nationkey")).select(F.col("c_custkey").alias("left_id"), F.posexplode("best").alias("rank", "s"))
    return NNBlockSet(rows.select("left_id", "rank", F.col("s.id").alias("right_id")))


@query(f"with {_NN.format(2)} select left_id, rank, right_id from nn union all select left_id, cast(rank + k as integer), right_id from nn cross join k")
def neighbours_combined(spark, sf) -> DataFrame:
    n = _neighbours(spark, sf, 2)
    return combine_blocks(n, n).df


@query(f"with {_NN.format(3)} select left_id as block_id, count(right_id) + 1 as assignments from nn group by left_id")
def neighbour_block_sizes(spark, sf) -> DataFrame:
    return _neighbours(spark, sf, 3).block_sizes()


@query(f"""with {_NN.format(3)}, l as (select (select count(*) from customer) as nl, (select count(*) from supplier) as nr)
select cast(1 + k as bigint) as assignments, cast(k as bigint) as comparisons, 1.0::double as left_cardinality, round(k / nr, 9) as right_cardinality, round((nl + k) / (nl + nr), 9) as overall_cardinality, round((1 + k) / k, 9) as comparisons_cardinality from k cross join l""")
def neighbour_statistics(spark, sf) -> DataFrame:
    s = _neighbours(spark, sf, 3).statistics(*(I.read(spark, sf, t).count() for t in ("customer", "supplier")))
    names = ("assignments", "comparisons", "left_cardinality", "right_cardinality", "overall_cardinality", "comparisons_cardinality")
    return spark.createDataFrame([tuple(s[k] if k in names[:2] else round(float(s[k]), 9) for k in names)], ", ".join(f"{k} {'long' if k in names[:2] else 'double'}" for k in names))


@query(f"with {_NN.format(2)} select left_id, right_id, count(*) as n from (select left_id, right_id from nn union all select cast(c_custkey as varchar), cast(s_suppkey as varchar) from customer join supplier on c_nationkey = s_nationkey) group by 1, 2")
def composite_pairs(spark, sf) -> DataFrame:
    both = combine_blocks(_neighbours(spark, sf, 2), _nations(spark, sf))
    return both.pair_counts()


# forms


def _folder(spark, sf) -> str:
    """A new folder beside the session's checkpoints."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/blocks-{uuid.uuid4().hex}"


@query("select cast(c_nationkey as varchar) as block_id, n_left, n_right from (select c_nationkey, count(*) as n_left from customer group by 1) join (select s_nationkey, count(*) as n_right from supplier group by 1) on c_nationkey = s_nationkey")
def blocks_written_and_read(spark, sf) -> DataFrame:
    path = _folder(spark, sf)
    write_blocks(_nations(spark, sf), path)
    return read_blocks(spark, path).sizes()


@query(f"with {_NN.format(2)} select left_id, right_id, count(*) as n from (select left_id, right_id from nn union all select cast(c_custkey as varchar), cast(s_suppkey as varchar) from customer join supplier on c_nationkey = s_nationkey) group by 1, 2")
def composite_written_and_read(spark, sf) -> DataFrame:
    path = _folder(spark, sf)
    write_blocks(combine_blocks(_neighbours(spark, sf, 2), _nations(spark, sf)), path)
    return read_blocks(spark, path).pair_counts()


@query(f"with {_NN.format(3)} select left_id, rank, right_id from nn")
def neighbours_written_and_read(spark, sf) -> DataFrame:
    path = _folder(spark, sf)
    write_blocks(_neighbours(spark, sf, 3), path)
    return read_blocks(spark, path).df


@query("select cast(n_regionkey as varchar) as block_id, count(*) filter (where n_nationkey % 2 = 0) as n_left, count(*) filter (where n_nationkey % 2 = 1) as n_right from nation group by n_regionkey having n_left > 0 and n_right > 0")
def blocks_from_dict(spark, sf) -> DataFrame:
    d = I.read(spark, sf, "nation").groupBy("n_regionkey")
    ids = lambda k: F.collect_list(F.when(F.col("n_nationkey") % 2 == k, F.col("n_nationkey")))
    made = BlockSet.from_pandas(spark, d.agg(ids(0).alias("left"), ids(1).alias("right")).toPandas().set_index("n_regionkey"))
    return BlockSet.from_dict(spark, made.to_dict()).sizes()


# joint evaluations

_KS = (3, 6, 9)
_EVAL = f"""{I.TOKENS}, t as (select unnest([{', '.join(map(str, _KS))}]) as k), mk as (select k, side, id, tok from m join t on length(tok) >= k),
gold as (select distinct a.id as l, b.id as r from docs a join docs b on a.text = b.text where a.side = 0 and b.side = 1), g as (select count(*) as g from gold),
len as (select count(*) filter (where side = 0) as nl, count(*) filter (where side = 1) as nr from docs),
cmp as (select k, sum(nl * nr) as c from (select k, tok, count(*) filter (where side = 0) as nl, count(*) filter (where side = 1) as nr from mk group by k, tok) group by k),
hit as (select a.k, l, r, count(*) as n from gold join mk a on a.id = l and a.side = 0 join mk b on b.id = r and b.side = 1 and b.tok = a.tok and b.k = a.k group by a.k, l, r),
s as (select t.k, coalesce(c, 0) as c, (select count(*) from hit where hit.k = t.k) as tp, coalesce((select sum(n) from hit where hit.k = t.k), 0) as hits from t left join cmp on cmp.k = t.k)"""


def _evaluations(spark, sf, ks=_KS) -> dict[str, Evaluation]:
    copies, d = I.copies(spark, sf), I.read(spark, sf, "documents")
    n = d.agg(F.count_if(F.col("doc_id") % 2 == 0).alias("l"), F.count_if(F.col("doc_id") % 2 == 1).alias("r")).first()
    blocks = doc_blocks(spark, sf, X.Tokenizer(min_length=min(ks)))
    # blocks of longer tokens are some of these, so the texts are cut and counted once
    blocks._sizes = settled(blocks.sizes())
    return {f"token{k}": Evaluation.from_blocks(blocks.where(F.length("block_id") >= k), copies[0], n.l, n.r, hits=copy_hits(copies, X.Tokenizer(min_length=k))) for k in ks}


_JOINT = """v as (select x.k as i, y.k as j, x.tp as ti, y.tp as tj, x.c as ci, y.c as cj, x.c - x.hits as fi, y.c - y.hits as fj, (select count(*) from (select distinct l, r from hit where hit.k in (x.k, y.k))) as tu from s x join s y on {}),
w as (select *, case when g = 0 then 0.0 else ti / g end as ri, case when ti + fi = 0 then 0.0 else ti / (ti + fi) end as pi, case when g = 0 then 0.0 else tj / g end as rj, case when g = 0 then 0.0 else tu / g end as ru, case when tu + fi + fj = 0 then 0.0 else tu / (tu + fi + fj) end as pu from v cross join g cross join len)"""


@query(f"""with {_EVAL}, {_JOINT.format('x.k <> y.k')} select 'token' || i as base, 'token' || j as other, round(case when ti + tj = 0 then 0.0 else 2 * (ti + tj - tu) / (ti + tj) end, 9) as dice_tp,
round(case when ri = 0 then cast('nan' as double) else (ru - ri) / ri end, 9) as improvement_recall, round(case when pi = 0 then cast('nan' as double) else (pu - pi) / pi end, 9) as improvement_precision from w""")
def multi_comparison(spark, sf) -> DataFrame:
    rows = compare_many(_evaluations(spark, sf), ["recall", "precision"])
    names = ("dice_tp", "improvement_recall", "improvement_precision")
    return spark.createDataFrame([(r["base"], r["other"], *(round(float(r[k]), 9) for k in names)) for r in rows], "base string, other string, dice_tp double, improvement_recall double, improvement_precision double")


@query(f"with {_EVAL}, {_JOINT.format('x.k = 3 and y.k = 9')} select tu as tp, g - tu as fn, cast(fi + fj as bigint) as fp, cast(ci + cj as bigint) as comparisons, round(ru, 9) as recall, round(pu, 9) as precision, round(1 - (ci + cj) / (nl * nr), 9) as reduction_ratio from w")
def joined_evaluation(spark, sf) -> DataFrame:
    e = Evaluation.joined(list(_evaluations(spark, sf, (3, 9)).values()))
    return spark.createDataFrame([(e.tp, e.fn, e.fp, e.comparisons, *(round(float(x), 9) for x in (e.recall, e.precision, e.reduction_ratio)))], "tp long, fn long, fp long, comparisons long, recall double, precision double, reduction_ratio double")


@query(f"""with {_EVAL}, {_JOINT.format('x.k = 6 and y.k = 9')} select round(case when ti + tj = 0 then 0.0 else 2 * (ti + tj - tu) / (ti + tj) end, 9) as dice_tp, round(ru, 9) as recall,
round(case when ri = 0 then cast('nan' as double) else (ru - ri) / ri end, 9) as improvement_recall_first, round(case when rj = 0 then cast('nan' as double) else (ru - rj) / rj end, 9) as improvement_recall_second from w""")
def blocks_compared(spark, sf) -> DataFrame:
    c = compare(*_evaluations(spark, sf, (6, 9)).values(), "recall")
    names = ("dice_tp", "recall", "improvement_recall_first", "improvement_recall_second")
    return spark.createDataFrame([tuple(round(float(c[k]), 9) for k in names)], ", ".join(f"{k} double" for k in names))


_SMALL = """select tp, g - tp as fn, cast(c as bigint) as comparisons, round(case when g = 0 then 0.0 else tp / g end, 9) as recall, round(case when c = 0 then 0.0 else tp / (tp + c - hits) end, 9) as precision, round(1 - c / (nl * nr), 9) as reduction_ratio from s cross join g cross join len where k = 6"""


@query(f"with {_EVAL} {_SMALL}")
def minimal_evaluation_row(spark, sf) -> DataFrame:
    d = I.read(spark, sf, "documents").agg(F.count_if(F.col("doc_id") % 2 == 0).alias("l"), F.count_if(F.col("doc_id") % 2 == 1).alias("r")).first()
    copies, tokens = I.copies(spark, sf), X.Tokenizer(min_length=6)
    e = minimal_evaluation(doc_blocks(spark, sf, tokens), copies[0], d.l, d.r, copy_hits(copies, tokens))
    return e.select("tp", "fn", "comparisons", *(F.round(c, 9).alias(c) for c in ("recall", "precision", "reduction_ratio")))


@query(f"with {_EVAL} {_SMALL}")
def evaluation_of_dataset(spark, sf) -> DataFrame:
    copies, tokens = I.copies(spark, sf), X.Tokenizer(min_length=6)
    d = EntityDataset.build(I.documents(spark, sf, 0), I.documents(spark, sf, 1), copies[0])
    e = Evaluation.from_dataset(doc_blocks(spark, sf, tokens), d, hits=copy_hits(copies, tokens))
    return spark.createDataFrame([(e.tp, e.fn, e.comparisons, *(round(float(x), 9) for x in (e.recall, e.precision, e.reduction_ratio)))], "tp long, fn long, comparisons long, recall double, precision double, reduction_ratio double")


# vectors


def _letters(texts: list[str]) -> list[list[float]]:
    """Some counts of a text: a stand-in for a pre-trained model that any engine can compute."""
    return [[float(len(t)), *(float(t.count(c)) for c in "aeiort")] for t in texts]


def _letters_sql(texts: str) -> str:
    return f"select side, id, [cast(length(text) as double), {', '.join(f"cast(length(text) - length(replace(text, '{c}', '')) as double)" for c in 'aeiort')}] as v from {texts}"


_PARTS = f"xt as (select side, head as id, string_agg(distinct trim(coalesce(tail, '')), ' ' order by trim(coalesce(tail, ''))) as text from ({I.PARTS}) group by side, head)"


def _nearest_sql(vectors: str, n: int) -> str:
    return f"""d as (select a.id as left_id, b.id as right_id, round(list_distance(a.v, b.v), 9) as d from {vectors} a join {vectors} b on a.side = 0 and b.side = 1),
nn as (select left_id, cast(rk - 1 as integer) as rank, right_id from (select *, row_number() over (partition by left_id order by d, right_id) as rk from d) where rk <= {n})"""


@query(f"with {_PARTS}, ev as ({_letters_sql('xt')}), {_nearest_sql('ev', 3)} select left_id, rank, right_id from nn")
def embedding_function(spark, sf) -> DataFrame:
    b = EmbeddingBlocker(E.FunctionEncoder(_letters), K.builder("nearest", n_neighbors=3))
    return b.assign(I.parts(spark, sf, 0), I.parts(spark, sf, 1)).df


@query(f"with {_PARTS}, ev as ({_letters_sql('xt')}), {_nearest_sql('ev', 2)} select left_id, rank, right_id from nn")
def embedding_saved(spark, sf) -> DataFrame:
    path = _folder(spark, sf)
    EmbeddingBlocker(E.FunctionEncoder(_letters), K.builder("nearest", n_neighbors=2), save_dir=path).assign(I.parts(spark, sf, 0), I.parts(spark, sf, 1))
    return EmbeddingBlocker.from_encoded(spark, path, K.builder("nearest", n_neighbors=2)).df


@query(f"""with {I.GRAPH}, {_near_sql(0, True)}, {_near_sql(1, True)}, {_ONE}, {_blocks_sql(_REST.format(_OWN), 'p')}, xr as {_REST.format(_BOTH)}, ev as ({_letters_sql('xr')}), {_nearest_sql('ev', 2)},
bs as (select * from u union select * from p), pr as (select a.id as l, b.id as r from bs a join bs b on a.block_id = b.block_id and a.side = 0 and b.side = 1 union all select left_id, right_id from nn)
select l as left_id, count(*) as n, count(distinct r) as n_distinct from pr group by l""")
def composite_embedding(spark, sf) -> DataFrame:
    b = C.CompositeEmbeddingBlocker(E.FunctionEncoder(_letters), K.builder("nearest", n_neighbors=2)).assign(*_graph(spark, sf))
    return b.all_pairs().groupBy("left_id").agg(F.count("*").alias("n"), F.count_distinct("right_id").alias("n_distinct"))


_ANYTOK = f"t as (select cast(doc_id as varchar) as id, unnest(regexp_extract_all(text, '{I._PATTERN}')) as tok from documents)"


@query(f"""with {_ANYTOK}, k as (select id, cast(p as integer) as pos, avg({_HASHVEC.format('tok')}) as x from t cross join (select unnest(range(4)) as p) group by id, p),
every as (select cast(doc_id as varchar) as id, cast(p as integer) as pos, {_HASHVEC.format('cast(doc_id as varchar)')} as own from documents cross join (select unnest(range(4)) as p))
select id, pos, round(coalesce(x, own), 6) as x from every left join k using (id, pos)""")
def frame_embedding(spark, sf) -> DataFrame:
    """All texts; those without a token have the vector of their id."""
    d = I.read(spark, sf, "documents").select(F.lit(0).alias("side"), F.col("doc_id").cast("string").alias("id"), "text")
    return E.AverageEncoder(size=4).vectors(d).select("id", F.posexplode("vec").alias("pos", "x")).select("id", "pos", F.round("x", 6).alias("x"))


_HUB = f"""{_VEC}, d as (select a.vec_id as l, b.vec_id as r, round(list_distance(a.v, b.v), 9) as d from e a cross join e b where a.vec_id % 2 = 0 and b.vec_id % 2 = 1),
a as (select l, r, d from (select *, row_number() over (partition by l order by d, cast(r as varchar)) as k from d) where k <= 10),
b as (select l, r, d from (select *, row_number() over (partition by r order by d, cast(l as varchar)) as k from d) where k <= 10),
x as (select l, avg(d) as ml, max(d) as fl, stddev_pop(d) as sl from a group by l), y as (select r, avg(d) as mr, max(d) as fr, stddev_pop(d) as sr from b group by r)"""
_TAIL = "1 / (1 + exp(1.5976 * ((d - {m}) / greatest({s}, 1e-12)) + 0.07056 * pow((d - {m}) / greatest({s}, 1e-12), 3)))"


def _hub_sql(value: str) -> str:
    return f"with {_HUB} select cast(a.l as varchar) as left_id, cast(a.r as varchar) as right_id, round({value}, 6) as distance from a join x on x.l = a.l join y on y.r = a.r"


def _hub(spark, sf, method: str) -> DataFrame:
    r = K.reduced_hubness(I.embeddings(spark, sf, 0), I.embeddings(spark, sf, 1), 10, method)
    return r.select("left_id", "right_id", F.round("distance", 6).alias("distance"))


@query(_hub_sql("1 - exp(-d * d / greatest(fl * fr, 1e-12))"))
def local_scaling_distances(spark, sf) -> DataFrame:
    return _hub(spark, sf, "local_scaling")


@query(_hub_sql("d / sqrt(greatest(ml * mr, 1e-12))"))
def nicdm_distances(spark, sf) -> DataFrame:
    return _hub(spark, sf, "nicdm")


@query(_hub_sql(f"1 - ({_TAIL.format(m='ml', s='sl')}) * ({_TAIL.format(m='mr', s='sr')})"))
def mutual_proximity_distances(spark, sf) -> DataFrame:
    return _hub(spark, sf, "mutual_proximity")


@query(f"""with {_HUB}, dims as (select unnest(range(1, (select max(len(v)) from e) + 1)) as p),
ca as (select l as id, p, avg(e.v[p]) as m from a join e on e.vec_id = a.r cross join dims group by l, p), cb as (select r as id, p, avg(e.v[p]) as m from b join e on e.vec_id = b.l cross join dims group by r, p),
oa as (select id, sum((e.v[p] - m) * (e.v[p] - m)) as o from ca join e on e.vec_id = id group by id), ob as (select id, sum((e.v[p] - m) * (e.v[p] - m)) as o from cb join e on e.vec_id = id group by id)
select cast(a.l as varchar) as left_id, cast(a.r as varchar) as right_id, round(d * d - oa.o - ob.o, 6) as distance from a join oa on oa.id = a.l join ob on ob.id = a.r""")
def dis_sim_distances(spark, sf) -> DataFrame:
    return _hub(spark, sf, "dis_sim")
