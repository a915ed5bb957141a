"""Small inputs of two sides: films, some of them on both. Expectations are computed from the rows."""

import re
from collections import defaultdict

from linkblocks.functions.text import STOP_WORDS
from linkblocks.model import EntityFrame, TripleFrame

LEFT = [
    ("a1", "Harbor Lights", "1999-03-21", "Norway", None),
    ("a2", "Silent Quarry", "2004-11-02", "Norway", "thriller"),
    ("a3", "Golden Quarry", "2011-07-15", "Chile", "history"),
    ("a4", "Marble Fox", "2015-01-30", "Ghana", "fable"),
    ("a5", "Übermut Żółw", "1987-09-09", "Poland", "satire"),
]
RIGHT = [
    ("b1", "Harbor", "Lights", "1999-03-21", None),
    ("b2", "Silent", "Quarry", "2004-11-02", "Norway"),
    ("b3", "Golden", "Quarry", "2011-07-15", "Chile"),
    ("b4", "Velvet", "Road", "2011-07-15", "Chad"),
    ("b5", "Marble", "Gate", "2020-05-05", "Peru"),
]
LEFT_COLUMNS = ["id", "Title", "Released", "Country", "Genre"]
RIGHT_COLUMNS = ["id", "First", "Second", "Released", "Country"]


def blocks_by(keys):
    """Blocks with members of both sides, by a function of (row, columns) to keys."""
    out = defaultdict(lambda: (set(), set()))
    for k, (rows, columns) in enumerate(((LEFT, LEFT_COLUMNS), (RIGHT, RIGHT_COLUMNS))):
        for r in rows:
            for key in keys(r, columns):
                out[key][k].add(r[0])
    return {k: v for k, v in out.items() if all(v)}


def words(row, columns=None):
    found = {w.lower() for v in row[1:] if v for w in re.findall(r"\w+(?:-\w+)*", v)}
    return {w for w in found if len(w) > 2 and w not in STOP_WORDS}


def grams(column, q):
    return lambda r, c: {(r[c.index(column)] or "")[i : i + q] for i in range(len(r[c.index(column)] or "") - q + 1)}


def unique_names():
    """Values that one entity alone has on each side."""
    return {f"unique_{k}": v for k, v in blocks_by(lambda r, c: {v for v in r[1:] if v}).items() if len(v[0]) == len(v[1]) == 1}


TOKENS = blocks_by(words)
A_REL = [("a1", "knows", "a2"), ("a2", "knows", "a3"), ("a3", "likes", "a1"), ("a4", "knows", "a5"), ("a1", "likes", "a5")]
B_REL = [("b1", "knows", "b2"), ("b2", "knows", "b3"), ("b3", "likes", "b1"), ("b5", "knows", "b4")]


def wide(spark):
    schema = lambda cols: ", ".join(f"{c} string" for c in cols)
    return EntityFrame(spark.createDataFrame(LEFT, schema(LEFT_COLUMNS)), "id", "A"), EntityFrame(spark.createDataFrame(RIGHT, schema(RIGHT_COLUMNS)), "id", "B")


def melted(rows, columns):
    return [(r[0], c, v) for c, *vs in zip(columns[1:], *(r[1:] for r in rows), strict=True) for r, v in zip(rows, vs, strict=True)]


def triples(spark):
    side = lambda rows, cols, n: TripleFrame(spark.createDataFrame(melted(rows, cols), "head string, rel string, tail string"), "head", n)
    return side(LEFT, LEFT_COLUMNS, "A"), side(RIGHT, RIGHT_COLUMNS, "B")


def relations(spark):
    return tuple(spark.createDataFrame(r, "head string, relation string, tail string") for r in (A_REL, B_REL))


def as_sets(blocks):
    return {k: (set(a), set(b)) for k, (a, b) in blocks.to_dict().items()}
