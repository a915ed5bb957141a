"""Registered queries, each beside its SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..blocks import BlockSet
from ..functions import text as X
from ..metrics import dice, evaluate, gold_hits
from ..model import EntityFrame, gold_from_clusters
from ..operators import graph as G
from ..operators.clustering import AttributeClusteringTokenBlocker, handle_noise
from ..operators.composite import CompositeRelationalTokenBlocker
from ..operators.lsh import MinHashLSHBlocker, permutations
from ..operators.relational import RelationalTokenAttributeBlocker, RelationalTokenBlocker, SimpleRelationalTokenBlocker
from ..operators.standard import QgramsBlocker, StandardBlocker
from ..operators.token import PartitioningTokenBlocker, TfIdfTokenBlocker, TokenBlocker, UniqueNameBlocker, tfidf_weights
from ..vectors import encoders as E
from ..vectors import knn as K
from . import inputs as I

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


TOK = X.Tokenizer()
BIG = "bigint"


def doc_blocks(spark, sf, tokenizer=TOK) -> BlockSet:
    return TokenBlocker(tokenizer).assign(I.documents(spark, sf, 0), I.documents(spark, sf, 1))


# texts


@query("select cast(p_partkey as varchar) as id, regexp_replace(concat_ws(' ', coalesce(p_name, ''), coalesce(p_brand, ''), coalesce(p_type, ''), coalesce(cast(p_size as varchar), '')), '^\\s+|\\s+$', '', 'g') as text from part")
def concat_wide(spark, sf) -> DataFrame:
    return X.concat_wide(I.read(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey")


@query(f"select head as id, trim(string_agg(distinct trim(coalesce(tail, '')), ' ' order by trim(coalesce(tail, '')))) as text from ({I.PARTS}) group by head")
def concat_triples(spark, sf) -> DataFrame:
    return I.parts(spark, sf).texts()


@query(f"select head as id, trim(string_agg(coalesce(tail, ''), ' ' order by coalesce(tail, ''))) as text from ({I.PARTS}) group by head")
def concat_triples_duplicates(spark, sf) -> DataFrame:
    return I.parts(spark, sf).texts(distinct=False)


@query(f"with {I.TOKENS} select d.id, count(tok) as n_tokens, count(distinct tok) as n_distinct from docs d left join tok t on t.id = d.id group by d.id")
def tokenize_filtered(spark, sf) -> DataFrame:
    d = I.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), TOK.tokens(F.col("text")).alias("t"))
    return d.select("id", F.size("t").cast(BIG).alias("n_tokens"), F.size(F.array_distinct("t")).cast(BIG).alias("n_distinct"))


@query(f"select p_partkey, cast(len(list_distinct(regexp_extract_all(p_name, '{I._PATTERN}') || regexp_extract_all(p_type, '{I._PATTERN}'))) as bigint) as n from part")
def row_tokens(spark, sf) -> DataFrame:
    return I.read(spark, sf, "part").select("p_partkey", F.size(X.row_tokens([F.col("p_name"), F.col("p_type")])).cast(BIG).alias("n"))


@query("select gram, count(*) as n from (select p_name[i:i+2] as gram from (select p_name, unnest(range(1, cast(length(p_name) as bigint) - 1)) as i from part)) group by gram")
def qgrams(spark, sf) -> DataFrame:
    return I.read(spark, sf, "part").select(F.explode(X.qgrams(F.col("p_name"), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("select o_orderkey, split_part(cast(o_orderstatus as varchar) || '^^xsd:' || o_orderpriority, '^^', 1) as value from orders")
def clean_datatype(spark, sf) -> DataFrame:
    o = I.read(spark, sf, "orders")
    return o.select("o_orderkey", X.without_datatype(F.concat("o_orderstatus", F.lit("^^xsd:"), "o_orderpriority")).alias("value"))


# blocks by keys and tokens


def _nations(spark, sf) -> BlockSet:
    c = EntityFrame(I.read(spark, sf, "customer").withColumnRenamed("c_nationkey", "nation"), "c_custkey", "left")
    s = EntityFrame(I.read(spark, sf, "supplier").withColumnRenamed("s_nationkey", "nation"), "s_suppkey", "right")
    return StandardBlocker("nation").assign(c, s)


@query("select cast(c_nationkey as varchar) as block_id, n_left, n_right from (select c_nationkey, count(*) as n_left from customer group by 1) join (select s_nationkey, count(*) as n_right from supplier group by 1) on c_nationkey = s_nationkey")
def standard_blocking(spark, sf) -> DataFrame:
    return _nations(spark, sf).sizes()


@query("""with a as (select distinct c_custkey as id, c_name[i:i+2] as g from (select *, unnest(range(1, cast(length(c_name) as bigint) - 1)) as i from customer)),
b as (select distinct s_suppkey as id, s_name[i:i+2] as g from (select *, unnest(range(1, cast(length(s_name) as bigint) - 1)) as i from supplier))
select a.g as block_id, n_left, n_right from (select g, count(*) as n_left from a group by g) a join (select g, count(*) as n_right from b group by g) b on a.g = b.g""")
def qgram_blocking(spark, sf) -> DataFrame:
    a = EntityFrame(I.read(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name")), "c_custkey", "left")
    b = EntityFrame(I.read(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("name")), "s_suppkey", "right")
    return QgramsBlocker("name").assign(a, b).sizes()


@query(f"with {I.TOKENS}, {I.SIZES} select tok as block_id, n_left, n_right from sz")
def token_block_sizes(spark, sf) -> DataFrame:
    return doc_blocks(spark, sf).sizes()


@query(f"with {I.TOKENS}, {I.SIZES} select id as left_id, cast(sum(n_right) as bigint) as n_pairs from m join sz on m.tok = sz.tok where side = 0 group by id")
def token_blocking_pairs(spark, sf) -> DataFrame:
    b = doc_blocks(spark, sf)
    # pairs of an entity are the other side's sizes of its blocks, so none is listed
    return b.left.join(b.sizes(), "block_id").groupBy(F.col("entity_id").alias("left_id")).agg(F.sum("n_right").alias("n_pairs"))


@query(f"""with {I.GRAPH}, t as (select 0 as side, * from a0 union all select 1, * from a1), u as (select side, tail, min(head) as head from t where tail is not null group by side, tail having count(distinct head) = 1)
select 'unique_' || a.tail as block_id, a.head as left_id, b.head as right_id from u a join u b on a.tail = b.tail where a.side = 0 and b.side = 1""")
def unique_name_blocking(spark, sf) -> DataFrame:
    return UniqueNameBlocker().assign(I.graph_attributes(spark, sf, 0), I.graph_attributes(spark, sf, 1)).pairs()


@query(f"""with t as ({I.PARTS}), x as (select side, head as id, string_agg(distinct trim(coalesce(tail, '')), ' ') as text from t group by side, head),
tok as ({I.tokens_sql('x')}), m as (select distinct side, id, tok from tok), p as (select distinct a.id, b.id as r from m a join m b on a.tok = b.tok where a.side = 0 and b.side = 1)
select x.id as left_id, count(r) as n from x left join p on p.id = x.id where side = 0 group by x.id""")
def partitioning_token(spark, sf) -> DataFrame:
    b = PartitioningTokenBlocker().assign(I.parts(spark, sf, 0), I.parts(spark, sf, 1))
    return b.sizes().select(F.col("block_id").alias("left_id"), F.col("n_right").alias("n"))


def _tfidf_sql(tf: str, norm: str, threshold: float, tail: str) -> str:
    return f"""with {I.TOKENS}, tf as (select side, id, tok, count(*) as c from tok group by side, id, tok), df as (select tok, count(*) as df from tf group by tok),
n as (select count(*) as n from docs), w as (select side, id, tf.tok, {tf} * (ln((1.0 + n) / (1.0 + df)) + 1.0) as w from tf join df on tf.tok = df.tok cross join n),
v as (select side, id, tok, w / {norm} over (partition by side, id) as w from w), k as (select side, id, tok from v where w >= {threshold}) {tail}"""


THRESHOLD = 0.2000001


@query(_tfidf_sql("cast(c as double)", "sqrt(sum(w * w)", THRESHOLD, "select tok as block_id, a.id as left_id, b.id as right_id from k a join k b using (tok) where a.side = 0 and b.side = 1").replace("sqrt(sum(w * w) over (partition by side, id)", "sqrt(sum(w * w) over (partition by side, id))"))
def tfidf_token_blocking(spark, sf) -> DataFrame:
    return TfIdfTokenBlocker(THRESHOLD).assign(I.documents(spark, sf, 0), I.documents(spark, sf, 1)).pairs()


@query(_tfidf_sql("(ln(c) + 1)", "sum(abs(w))", 0.0500001, "select id, count(*) as n from k group by id"))
def tfidf_l1_sublinear(spark, sf) -> DataFrame:
    d = I.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    w = tfidf_weights(d, TOK, norm="l1", sublinear_tf=True)
    return w.where(F.col("weight") >= 0.0500001).groupBy("id").agg(F.count("*").alias("n"))


PERM = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(permutations(32)))


@query(f"""with {I.TOKENS}, h as (select side, id, cast(('0x' || substr(md5(tok), 1, 7)) as bigint) as h from m), perm(i, a, b) as (values {PERM}),
sig as (select side, id, i, min((a * h + b) % 2147483647) as v from h cross join perm group by side, id, i),
band as (select side, id, i // 4 as band, string_agg(cast(v as varchar), ',' order by i) as k from sig group by side, id, i // 4)
select distinct a.id as left_id, b.id as right_id from band a join band b on a.band = b.band and a.k = b.k where a.side = 0 and b.side = 1
union select a.id, b.id from docs a join docs b on a.side = 0 and b.side = 1 where a.id not in (select id from m) and b.id not in (select id from m)""")
def minhash_lsh_pairs(spark, sf) -> DataFrame:
    lsh = MinHashLSHBlocker(num_perm=32, shape=(8, 4))
    return lsh.candidate_pairs(I.documents(spark, sf, 0).texts(), I.documents(spark, sf, 1).texts())


# graph


@query(f"with {I.GRAPH} select tail as head, 'inv_' || relation as relation, head as tail from r0")
def reverse_relations(spark, sf) -> DataFrame:
    return G.reversed_relations(I.graph_relations(spark, sf, 0), "inv_")


_N = "n as (select count(distinct id) as n from (select head as id from a0 union all select head from r0 union all select tail from r0))"


@query(f"with {I.GRAPH}, {_N} select n from n")
def count_entities(spark, sf) -> DataFrame:
    return G.count_entities(I.graph_attributes(spark, sf, 0).df, I.graph_relations(spark, sf, 0))


def _n(spark, sf, side=0) -> DataFrame:
    return G.count_entities(I.graph_attributes(spark, sf, side).df, I.graph_relations(spark, sf, side))


_HM = "case when s + d = 0 then 0.0 else 2 * s * d / (s + d) end"
_REL = f"rimp as (select relation, rel_count, tail_count, s as support, d as discriminability, {_HM} as importance from (select relation, count(*) as rel_count, count(tail) as tail_count, count(*) / (min(n) * min(n)) as s, count(tail) / count(*) as d from r0 cross join n group by relation))"
_ROUND = "round(support, 12) as support, round(discriminability, 12) as discriminability, round(importance, 12) as importance"


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols, *(F.round(c, 12).alias(c) for c in ("support", "discriminability", "importance")))


@query(f"with {I.GRAPH}, {_N}, {_REL} select relation, rel_count, tail_count, {_ROUND} from rimp")
def relation_importance(spark, sf) -> DataFrame:
    return _rounded(G.relation_importance(I.graph_relations(spark, sf, 0), _n(spark, sf)), "relation", "rel_count", "tail_count")


@query(f"with {I.GRAPH}, {_N} select relation, rel_count, tail_count, {_ROUND} from (select *, s as support, d as discriminability, {_HM} as importance from (select relation, count(*) as rel_count, count(tail) as tail_count, count(head) / min(n) as s, count(tail) / count(*) as d from a0 cross join n group by relation))")
def name_importance(spark, sf) -> DataFrame:
    return _rounded(G.name_importance(I.graph_attributes(spark, sf, 0).df, _n(spark, sf)), "relation", "rel_count", "tail_count")


def _distinct_sql(rows: str, support: str) -> str:
    return f"select relation, {_ROUND} from (select *, s as support, d as discriminability, {_HM} as importance from (select relation, {support} as s, count(distinct tail) / count(distinct (head, tail)) as d from {rows} cross join n group by relation))"


@query(f"with {I.GRAPH}, {_N} {_distinct_sql('r0', 'count(distinct (head, tail)) / (min(n) * min(n))')}")
def distinct_relation_importance(spark, sf) -> DataFrame:
    return _rounded(G.distinct_relation_importance(I.graph_relations(spark, sf, 0), _n(spark, sf)), "relation")


@query(f"with {I.GRAPH}, {_N} {_distinct_sql('a0', 'count(distinct head) / min(n)')}")
def distinct_name_importance(spark, sf) -> DataFrame:
    return _rounded(G.distinct_name_importance(I.graph_attributes(spark, sf, 0).df, _n(spark, sf)), "relation")


@query(f"""with {I.GRAPH}, {_N}, {_REL}, e as (select * from r0 union all select tail, 'inv_' || relation, head from r0),
k as (select head, relation, row_number() over (partition by head order by importance desc nulls last, relation) as rk from (select distinct head, relation from e) left join rimp using (relation))
select e.head, e.relation, e.tail from e join k on e.head = k.head and e.relation = k.relation where rk <= 1""")
def topn_relations(spark, sf) -> DataFrame:
    rel = I.graph_relations(spark, sf, 0)
    return G.top_relations(rel.unionByName(G.reversed_relations(rel, "inv_")), G.relation_importance(rel, _n(spark, sf)), 1)


def _near_sql(k: int, own: bool) -> str:
    """Neighbour texts x{k} (id, text)."""
    mine = f" union all select id, text from t{k}" if own else ""
    return f"""t{k} as (select head as id, string_agg(distinct trim(coalesce(tail, '')), ' ' order by trim(coalesce(tail, ''))) as text from a{k} group by head),
e{k} as (select head, tail from r{k} union all select tail, head from r{k}),
x{k} as (select id, string_agg(distinct trim(text), ' ' order by trim(text)) as text from (select e{k}.head as id, t{k}.text from e{k} join t{k} on t{k}.id = e{k}.tail{mine}) group by id)"""


@query(f"with {I.GRAPH}, {_near_sql(0, True)} select id, cast(length(text) as bigint) as n_chars, md5(text) as text_md5 from x0")
def neighbor_concat(spark, sf) -> DataFrame:
    t = G.neighbor_texts(I.graph_attributes(spark, sf, 0), I.graph_relations(spark, sf, 0))
    return t.select("id", F.length("text").cast(BIG).alias("n_chars"), F.md5("text").alias("text_md5"))


@query(f"with {I.GRAPH}, {_near_sql(0, False)} select e0.head, md5(t0.text) as value, count(*) as n from e0 join t0 on t0.id = e0.tail group by 1, 2")
def neighbor_values(spark, sf) -> DataFrame:
    v = G.neighbor_values(I.graph_attributes(spark, sf, 0), I.graph_relations(spark, sf, 0), own=False)
    return v.groupBy("head", F.md5("tail").alias("value")).agg(F.count("*").alias("n"))


def _graph(spark, sf):
    return (I.graph_attributes(spark, sf, 0), I.graph_attributes(spark, sf, 1), I.graph_relations(spark, sf, 0), I.graph_relations(spark, sf, 1))


def _blocks_sql(texts: str, name: str = "b") -> str:
    """(block_id, side, id) of blocks with both sides, of a relation (side, id, text)."""
    return f"""{name}m as (select distinct side, id, tok from ({I.tokens_sql(texts)})),
{name} as (select tok as block_id, side, id from {name}m where tok in (select tok from {name}m group by tok having count(distinct side) = 2))"""


_COUNT = "select block_id, cast(sum(case when side = 0 then 1 else 0 end) as bigint) as n_left, cast(sum(case when side = 1 then 1 else 0 end) as bigint) as n_right from {} group by block_id"
_BOTH = "(select 0 as side, id, text from x0 union all select 1, id, text from x1)"
_OWN = "(select 0 as side, id, text from t0 union all select 1, id, text from t1)"


@query(f"with {I.GRAPH}, {_near_sql(0, True)}, {_near_sql(1, True)}, {_blocks_sql(_BOTH)} {_COUNT.format('b')}")
def relational_token_simple(spark, sf) -> DataFrame:
    return SimpleRelationalTokenBlocker().assign(*_graph(spark, sf)).sizes()


@query(f"with {I.GRAPH}, {_near_sql(0, False)}, {_near_sql(1, False)}, {_blocks_sql(_OWN, 'o')}, {_blocks_sql(_BOTH, 'p')}, b as (select * from o union select * from p) {_COUNT.format('b')}")
def relational_token_two_view(spark, sf) -> DataFrame:
    return RelationalTokenBlocker().assign(*_graph(spark, sf)).sizes()


@query(f"""with {I.GRAPH}, {_near_sql(0, False)}, {_near_sql(1, False)}, {_blocks_sql(_OWN, 'o')},
v as (select 0 as side, e0.head as id, t0.text as tok from e0 join t0 on t0.id = e0.tail union select 1, e1.head, t1.text from e1 join t1 on t1.id = e1.tail),
b as (select 'token:' || block_id as block_id, side, id from o union all select 'value:' || tok, side, id from v where tok in (select tok from v group by tok having count(distinct side) = 2)),
c as ({_COUNT.format('b')}) select md5(block_id) as block, n_left, n_right from c""")
def token_attribute_union(spark, sf) -> DataFrame:
    return RelationalTokenAttributeBlocker().assign(*_graph(spark, sf)).sizes().select(F.md5("block_id").alias("block"), "n_left", "n_right")


@query(f"""with {I.GRAPH}, {_near_sql(0, True)}, {_near_sql(1, True)}, a as (select 0 as side, * from a0 union all select 1, * from a1),
one as (select side, tail, min(head) as id from a where tail is not null group by side, tail having count(distinct head) = 1),
u as (select 'unique_' || tail as block_id, side, id from one where tail in (select tail from one group by tail having count(*) = 2)),
rest as (select * from {_BOTH} q where not exists (select 1 from u where u.side = q.side and u.id = q.id)),
{_blocks_sql('rest', 'p')}, b as (select * from u union select * from p) {_COUNT.format('b')}""")
def composite_unique_token(spark, sf) -> DataFrame:
    return CompositeRelationalTokenBlocker().assign(*_graph(spark, sf)).sizes()


@query(f"""with {I.GRAPH}, a as (select 0 as side, * from a0 union all select 1, * from a1),
one as (select side, tail, min(head) as id from a where tail is not null group by side, tail having count(distinct head) = 1),
u as (select side, id from one where tail in (select tail from one group by tail having count(*) = 2))
select distinct head as id from a0 where head not in (select id from u where side = 0)""")
def unmatched_entities(spark, sf) -> DataFrame:
    from ..operators.composite import without_matched

    left, right, *_ = _graph(spark, sf)
    return without_matched(left.entity_ids(), UniqueNameBlocker().assign(left, right).left)


def _top_sql(k: int, rows: str, imp: str, n: int, name: str) -> str:
    return f"{name} as (select head, relation, tail from (select t.*, row_number() over (partition by head order by importance desc nulls last, t.relation, tail) as rk from {rows} t left join {imp} i on t.relation = i.relation) where rk <= {n})"


def _dimp(rows: str, support: str, name: str) -> str:
    return f"{name} as (select relation, {_HM} as importance from (select relation, {support} as s, count(distinct tail) / count(distinct (head, tail)) as d from {rows} cross join n group by relation))"


_N1 = "nb as (select count(distinct id) as n from (select head as id from a1 union all select head from r1 union all select tail from r1))"


@query(f"""with {I.GRAPH}, {_N}, {_dimp('a0', 'count(distinct head) / min(n)', 'i0')}, {_N1}, {_dimp('a1', 'count(distinct head) / min(n)', 'i1').replace('cross join n ', 'cross join nb ')},
{_top_sql(0, 'a0', 'i0', 1, 'k0')}, {_top_sql(1, 'a1', 'i1', 1, 'k1')},
u0 as (select tail, min(head) as head from k0 where tail is not null group by tail having count(*) = 1), u1 as (select tail, min(head) as head from k1 where tail is not null group by tail having count(*) = 1)
select u0.head as left_id, u1.head as right_id, u0.tail from u0 join u1 on u0.tail = u1.tail""")
def name_blocker(spark, sf) -> DataFrame:
    left, right, *_ = _graph(spark, sf)
    return G.name_pairs(left.triples(), right.triples(), _n(spark, sf, 0), _n(spark, sf, 1), 1)


@query(f"""with {I.GRAPH}, {_N}, {_dimp('r0', 'count(distinct (head, tail)) / (min(n) * min(n))', 'i0')}, {_top_sql(0, 'r0', 'i0', 1, 'k0')}, {_near_sql(0, False)},
y as (select id, string_agg(distinct trim(text), ' ' order by trim(text)) as text from (select k0.head as id, t0.text from k0 join t0 on t0.id = k0.tail union all select id, text from t0) group by id)
select id, md5(text) as text_md5 from y""")
def neighbor_filtered(spark, sf) -> DataFrame:
    left = I.graph_attributes(spark, sf, 0)
    t = G.filtered_neighbor_texts(left.triples(), I.graph_relations(spark, sf, 0), _n(spark, sf), 1)
    return t.select("id", F.md5("text").alias("text_md5"))


# block management


@query("""with a as (select cast(c_nationkey as varchar) as block_id, 0 as side, cast(c_custkey as varchar) as id from customer union all select cast(s_nationkey as varchar), 1, cast(s_suppkey as varchar) from supplier),
b as (select split_part(c_name, '#', 2) as block_id, 0 as side, cast(c_custkey as varchar) as id from customer union all select split_part(s_name, '#', 2), 1, cast(s_suppkey as varchar) from supplier),
c as (select * from a where block_id in (select block_id from a group by 1 having count(distinct side) = 2) union select * from b where block_id in (select block_id from b group by 1 having count(distinct side) = 2))
select block_id, cast(sum(case when side = 0 then 1 else 0 end) as bigint) as n_left, cast(sum(case when side = 1 then 1 else 0 end) as bigint) as n_right from c group by block_id""")
def combine_blocks(spark, sf) -> DataFrame:
    number = lambda t, k, n, side: EntityFrame(I.read(spark, sf, t).withColumn("number", F.split_part(F.col(n), F.lit("#"), F.lit(2))), k, side)
    b = StandardBlocker("number").assign(number("customer", "c_custkey", "c_name", "left"), number("supplier", "s_suppkey", "s_name", "right"))
    return _nations(spark, sf).combine(b).sizes()


@query("select cast(c_nationkey as varchar) as block_id, array_to_string(list_sort(list(cast(c_custkey as varchar))), ',') as left_ids from customer where c_nationkey in (select s_nationkey from supplier) and c_nationkey = 7 group by 1")
def block_lookup(spark, sf) -> DataFrame:
    return _nations(spark, sf)["7"].select("block_id", F.array_join("left", ",").alias("left_ids"))


@query("select cast(c_nationkey as varchar) as block_id from customer where c_custkey = 1 and c_nationkey in (select s_nationkey from supplier)")
def find_blocks(spark, sf) -> DataFrame:
    return _nations(spark, sf).find_blocks(1, "left")


@query(f"with {I.TOKENS} select a.id as entity, b.id as other, count(*) as n from m a join m b on a.tok = b.tok where a.side = 0 and b.side = 1 and a.id = '0' group by 1, 2")
def entity_pairs(spark, sf) -> DataFrame:
    return doc_blocks(spark, sf).entity_pairs("0", "left").groupBy("entity", "other").agg(F.count("*").alias("n"))


@query("select cast(c_custkey as varchar) as left_id, cast(s_suppkey as varchar) as right_id from customer join supplier on c_nationkey = s_nationkey")
def all_pairs(spark, sf) -> DataFrame:
    return _nations(spark, sf).all_pairs()


@query(f"""with {I.TOKENS}, {I.SIZES}, l as (select cast(count(*) filter (where side = 0) as double) as nl, cast(count(*) filter (where side = 1) as double) as nr from docs)
select count(*) as blocks, cast(sum(n_left * n_right) as bigint) as pairs, cast(sum(n_left + n_right) as bigint) as assignments, round(avg(n_left + n_right), 9) as mean_block_size,
round(sum(n_left + n_right) / sum(n_left * n_right), 9) as comparisons_cardinality, round(sum(n_left) / min(nl), 9) as left_cardinality, round(sum(n_right) / min(nr), 9) as right_cardinality, round(sum(n_left + n_right) / (min(nl) + min(nr)), 9) as overall_cardinality from sz cross join l""")
def block_statistics(spark, sf) -> DataFrame:
    n = I.read(spark, sf, "documents").agg(F.count_if(F.col("doc_id") % 2 == 0).alias("l"), F.count_if(F.col("doc_id") % 2 == 1).alias("r")).first()
    s = doc_blocks(spark, sf).statistics(n.l, n.r)
    return s.select("blocks", "pairs", "assignments", *(F.round(c, 9).alias(c) for c in s.columns[3:]))


_PURGE = f"""with {I.TOKENS}, {I.SIZES}, c as (select tok, n_left * n_right as card, n_left + n_right as size from sz), one as (select card, arg_min(size, tok) as size from c group by card),
w as (select card, sum(card) over (order by card rows between unbounded preceding and current row) as running, sum(size) over (order by card rows between unbounded preceding and current row) as sizes from one),
q as (select card, running, row_number() over (partition by round(sizes / running, 3) order by card) as seen from w), t as (select coalesce(min(case when seen > 1 then running end), max(running)) as threshold from q)"""


@query(f"{_PURGE} select c.tok as block_id, card as comparisons from c cross join t where card <= threshold")
def purge_blocks(spark, sf) -> DataFrame:
    return doc_blocks(spark, sf).purge(3).comparisons()


@query(f"""with {I.TOKENS}, {I.SIZES}, p as (select n_left * n_right as card, cast(sum(n_left + n_right) as double) as size, cast(sum(n_left * n_right) as double) as s from sz group by 1),
w as (select card, sum(size) over (order by card rows between unbounded preceding and 1 preceding) / sum(s) over (order by card rows between unbounded preceding and 1 preceding) as cc from p),
v as (select card, cc, lag(cc) over (order by card) as prev from w) select coalesce(min(case when cc = prev then card end), max(card)) as threshold from v""")
def purge_iterative(spark, sf) -> DataFrame:
    return doc_blocks(spark, sf).iterative_threshold()


# evaluation

_GOLD = "gold as (select distinct a.id as l, b.id as r from docs a join docs b on a.text = b.text where a.side = 0 and b.side = 1)"
_HITS = "hit as (select l, r, count(*) as n from gold join m a on a.id = l and a.side = 0 join m b on b.id = r and b.side = 1 and b.tok = a.tok group by l, r)"


def _score_sql(fp: str, cmp: str) -> str:
    return f"""s as (select {cmp} as comparisons, (select count(*) from hit) as tp, (select count(*) from gold) as gold, (select coalesce(sum(n), 0) from hit) as hits, (select count(*) from docs where side = 0) as nl, (select count(*) from docs where side = 1) as nr),
v as (select cast(comparisons as bigint) as comparisons, tp, gold - tp as fn, cast({fp} as bigint) as fp, case when gold = 0 then 0.0 else tp / gold end as recall, case when comparisons = 0 then 0.0 else tp / (tp + {fp}) end as precision, 1 - comparisons / (nl * nr) as rr from s)
select comparisons, tp, fn, fp, round(recall, 9) as recall, round(precision, 9) as precision, round(case when recall + precision = 0 then 0 else 2 * recall * precision / (recall + precision) end, 9) as f_measure, round(rr, 9) as reduction_ratio, round(case when rr + recall = 0 then 0 else 2 * rr * recall / (rr + recall) end, 9) as h3r from v"""


def copy_hits(copies, tokenizer=TOK) -> DataFrame:
    """gold_hits of token blocks for the classes of I.copies: only their documents are cut into tokens."""
    gold, left, right = copies
    return gold_hits(TokenBlocker(tokenizer).assign(left, right), gold)


def _score(spark, sf, blocks, distinct=False) -> DataFrame:
    n = I.read(spark, sf, "documents").agg(F.count_if(F.col("doc_id") % 2 == 0).alias("l"), F.count_if(F.col("doc_id") % 2 == 1).alias("r")).first()
    copies = I.copies(spark, sf)
    e = evaluate(blocks, copies[0], n.l, n.r, distinct, copy_hits(copies))
    return e.select("comparisons", "tp", "fn", "fp", *(F.round(c, 9).alias(c) for c in e.columns[4:]))


@query(f"with {I.TOKENS}, {I.SIZES}, {_GOLD}, {_HITS}, {_score_sql('(comparisons - hits)', '(select coalesce(sum(n_left * n_right), 0) from sz)')}")
def eval_duplicates(spark, sf) -> DataFrame:
    return _score(spark, sf, doc_blocks(spark, sf))


@query(f"with {I.TOKENS}, {_GOLD}, {_HITS}, {_score_sql('(comparisons - tp)', '(select count(*) from (select distinct a.id, b.id from m a join m b on a.tok = b.tok where a.side = 0 and b.side = 1))')}".replace("select distinct a.id, b.id from", "select distinct a.id as x, b.id as y from"))
def eval_distinct(spark, sf) -> DataFrame:
    return _score(spark, sf, doc_blocks(spark, sf), distinct=True)


LONG = X.Tokenizer(min_length=9)


@query(f"""with {I.TOKENS}, {_GOLD}, {_HITS}, m9 as (select * from m where length(tok) >= 9), h9 as ({_HITS[len('hit as ('):-1].replace('join m a', 'join m9 a').replace('join m b', 'join m9 b')})
select (select count(*) from hit) as first, (select count(*) from h9) as second, 2.0 * (select count(*) from (select l, r from hit intersect select l, r from h9)) / ((select count(*) from hit) + (select count(*) from h9)) as dice,
(select count(*) from (select l, r from hit union select l, r from h9)) as joined_tp""")
def compare_blocks_dice(spark, sf) -> DataFrame:
    gold = I.exact_copies(spark, sf)
    a, b = (gold_hits(doc_blocks(spark, sf, t), gold).select("left_id", "right_id") for t in (TOK, LONG))
    both = a.unionByName(b).distinct().count()
    return spark.createDataFrame([(a.count(), b.count(), dice(a, b), both)], "first long, second long, dice double, joined_tp long")


@query("select cast(a.doc_id as varchar) as en, cast(b.doc_id as varchar) as other from documents a join documents b on a.source = b.source and a.n_chars = b.n_chars where a.lang = 'en' and b.lang <> 'en'")
def gold_from_clusters_query(spark, sf) -> DataFrame:
    d = I.read(spark, sf, "documents").select(F.struct("source", "n_chars").alias("cluster_id"), F.when(F.col("lang") == "en", "en").otherwise("other").alias("source"), F.col("doc_id").cast("string").alias("id"))
    return gold_from_clusters(d, "en", "other")


# vectors

_VEC = "e as (select vec_id, cast(embedding as double[]) as v, label from embeddings)"


@query(f"""with {_VEC}, d as (select cast(a.vec_id as varchar) as left_id, cast(b.vec_id as varchar) as right_id, round(list_distance(a.v, b.v), 9) as d from e a cross join e b where a.vec_id % 2 = 0 and b.vec_id % 2 = 1),
k as (select *, row_number() over (partition by left_id order by d, right_id) - 1 as rank from d) select left_id, cast(rank as integer) as rank, right_id, round(d, 6) as distance from k where rank < 5""")
def knn_exact(spark, sf) -> DataFrame:
    return K.nearest(I.embeddings(spark, sf, 0), I.embeddings(spark, sf, 1), 5).select("left_id", F.col("rank").cast("int").alias("rank"), "right_id", F.round("distance", 6).alias("distance"))


def _sinkhorn_sql(rounds: int) -> str:
    steps, last = [], "w0"
    for i in range(rounds):
        steps.append(f"a{i} as (select left_id, right_id, w / sum(w) over (partition by left_id) as w from {last})")
        steps.append(f"w{i + 1} as (select left_id, right_id, w / sum(w) over (partition by right_id) as w from a{i})")
        last = f"w{i + 1}"
    return f"""with {_VEC}, d as (select cast(a.vec_id as varchar) as left_id, cast(b.vec_id as varchar) as right_id, round(list_distance(a.v, b.v), 9) as d from e a cross join e b where a.vec_id % 2 = 0 and b.vec_id % 2 = 1),
k as (select left_id, right_id, d from (select *, row_number() over (partition by left_id order by d, right_id) as rk from d) where rk <= 10),
w0 as (select left_id, right_id, exp((hi - d) / (hi - lo) / 0.05) as w from k cross join (select min(d) as lo, max(d) as hi from k)), {', '.join(steps)} select left_id, right_id, round(w, 6) as weight from {last}"""


@query(_sinkhorn_sql(3))
def sinkhorn_weights(spark, sf) -> DataFrame:
    c = K.nearest(I.embeddings(spark, sf, 0), I.embeddings(spark, sf, 1), 10).select("left_id", "right_id", "distance")
    return K.sinkhorn(c, iterations=3).select("left_id", "right_id", F.round("weight", 6).alias("weight"))


@query(f"""with {_VEC}, d as (select a.vec_id as l, b.vec_id as r, round(list_distance(a.v, b.v), 9) as d from e a cross join e b where a.vec_id % 2 = 0 and b.vec_id % 2 = 1),
a as (select l, r, d from (select *, row_number() over (partition by l order by d, cast(r as varchar)) as k from d) where k <= 10),
b as (select l, r, d from (select *, row_number() over (partition by r order by d, cast(l as varchar)) as k from d) where k <= 10)
select cast(a.l as varchar) as left_id, cast(a.r as varchar) as right_id, round(2 * d - ml - mr, 6) as distance from a join (select l, avg(d) as ml from a group by l) x on x.l = a.l join (select r, avg(d) as mr from b group by r) y on y.r = a.r""")
def csls_distances(spark, sf) -> DataFrame:
    r = K.reduced_hubness(I.embeddings(spark, sf, 0), I.embeddings(spark, sf, 1), 10, "csls")
    return r.select("left_id", "right_id", F.round("distance", 6).alias("distance"))


@query("select cast(label as varchar) as block_id, count(*) filter (where vec_id % 2 = 0) as n_left, count(*) filter (where vec_id % 2 = 1) as n_right from embeddings group by label having n_left > 0 and n_right > 0")
def cluster_blocks(spark, sf) -> DataFrame:
    side = lambda k: I.embeddings(spark, sf, k).select(F.col("name").alias("id"), "label")
    return K.cluster_blocks(side(0), side(1)).sizes()


@query("select cast(vec_id as varchar) as value, case when label = 0 then cast(vec_id as varchar) else cast(label - 1 as varchar) end as label from embeddings")
def noise_handling(spark, sf) -> DataFrame:
    d = I.read(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("value"), (F.col("label") - 1).alias("label"))
    return handle_noise(d, "token")


_ALLTOK = f"t as (select cast(doc_id as varchar) as id, unnest(regexp_extract_all(text, '{I._PATTERN}')) as tok from documents)"


@query(f"with {_ALLTOK} select tok, count(*) as n, round(0.001 / (0.001 + count(*) / sum(count(*)) over ()), 9) as weight from t group by tok")
def sif_weights(spark, sf) -> DataFrame:
    t = I.read(spark, sf, "documents").select(F.explode(X.pattern_tokens(F.col("text"))).alias("tok"))
    return E.sif_weights(t).select("tok", "n", F.round("weight", 9).alias("weight"))


_HASHVEC = "cast(('0x' || substr(md5({} || ':' || p), 1, 7)) as bigint) / 268435456.0 * 2 - 1"


@query(f"with {_ALLTOK} select id, cast(p as integer) as pos, round(avg({_HASHVEC.format('tok')}), 6) as x from t cross join (select unnest(range(4)) as p) group by id, p")
def avg_embedding(spark, sf) -> DataFrame:
    d = I.read(spark, sf, "documents").select(F.lit(0).alias("side"), F.col("doc_id").cast("string").alias("id"), "text")
    v = E.AverageEncoder(size=4).vectors(d)
    # texts without tokens have a vector of their id in the encoder; SQL leaves them out
    known = d.where(F.size(X.pattern_tokens(F.col("text"))) > 0).select("id")
    return v.join(known, "id", "left_semi").select("id", F.posexplode("vec").alias("pos", "x")).select("id", "pos", F.round("x", 6).alias("x"))


_EDGES = "select head as src, tail as dst from r0"


@query(f"""with {I.GRAPH}, ids as (select distinct id from (select head as id from r0 union all select tail from r0)), e as (select src, dst, 1.0 as w from ({_EDGES}) where src <> dst union all select id, id, 2.0 from ids),
g as (select dst as id, sum(w) as d from e group by dst), n as (select src, dst, w / sqrt(a.d * b.d) as w from e join g a on a.id = src join g b on b.id = dst)
select src as id, cast(p as integer) as pos, round(sum(w * ({_HASHVEC.format('dst')})), 6) as x from n cross join (select unnest(range(4)) as p) group by src, p""")
def gcn_propagate(spark, sf) -> DataFrame:
    rel = I.graph_relations(spark, sf, 0)
    ids = rel.select(F.col("head").alias("id")).unionAll(rel.select("tail")).distinct()
    v = ids.withColumn("vec", E.hash_vector(F.col("id"), 4))
    out = E.weighted_sums(E.normalised_edges(rel, ids), v)
    return out.select("id", F.posexplode("vec").alias("pos", "x")).select("id", "pos", F.round("x", 6).alias("x"))


@query(f"""with {I.GRAPH}, t as (select distinct * from r0), b as (select head as src, tail as dst, '+' || relation as r from t union all select tail, head, '-' || relation from t),
o as (select src, dst, cast(count(*) as double) as weight from b group by 1, 2), d as (select src, count(*) as n from (select head as src from t union all select tail from t) group by 1)
select src, dst, weight from o where src <> dst union all select d.src, d.src, coalesce(o.weight, cast(n as double)) from d left join o on o.src = d.src and o.dst = d.src""")
def light_ea_adjacency(spark, sf) -> DataFrame:
    return E.adjacency(I.graph_relations(spark, sf, 0))


@query()
def light_ea_neighbors(spark, sf) -> DataFrame:
    left, right, lr, rr = _graph(spark, sf)
    a, b = E.LightEAEncoder(size=8).encode(left.texts(), right.texts(), lr, rr)
    return K.NearestNeighborBuilder(2).build(a, b).df


@query()
def hdbscan_blocks(spark, sf) -> DataFrame:
    return K.HdbscanBuilder(min_cluster_size=5).build(I.embeddings(spark, sf, 0), I.embeddings(spark, sf, 1)).sizes()


@query()
def autoencoder_neighbors(spark, sf) -> DataFrame:
    enc = E.AutoencoderEncoder(E.SifEncoder(size=16), hidden=(12, 8), epochs=5)
    a, b = enc.encode(I.documents(spark, sf, 0).texts(), I.documents(spark, sf, 1).texts())
    return K.NearestNeighborBuilder(3).build(a, b).df


@query()
def attribute_clustering(spark, sf) -> DataFrame:
    left, right = (I.graph_places(spark, sf, side) for side in (0, 1))
    return AttributeClusteringTokenBlocker(text_encoder=E.AverageEncoder(size=8), min_cluster_size=2).assign(left, right).sizes()
