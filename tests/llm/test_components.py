"""Connected components against a plain search, over shapes that take many rounds."""

import random

import pytest

from revq.llm import components as C


def plain(links):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    root = {}
    for start in sorted(near):
        todo = [start] if start not in root else []
        while todo:
            node = todo.pop()
            if node not in root:
                root[node] = start
                todo += near[node]
    return root


def _key(node):
    return bytes(node) if isinstance(node, bytearray) else node


def found(spark, links, kind="long", parts=7):
    rows = C.components(spark.createDataFrame(links, f"a {kind}, b {kind}").repartition(parts)).collect()
    assert len(rows) == len({_key(r.node) for r in rows})
    return {_key(r.node): _key(r.root) for r in rows}


SHAPES = {
    "path": [(i, i + 1) for i in range(60)],
    "path against the order": [(i * 37 % 61, (i + 1) * 37 % 61) for i in range(60)],
    "star with a chain at its rim": [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(399, 430)],
    "two stars that share leaves": [(i % 2, i) for i in range(2, 300)] + [(0, 299)],
    "repeated both ways": [(5, 3), (3, 5), (5, 3), (9, 8)],
}


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("name", SHAPES)
def test_shapes(spark, name, parts):
    assert found(spark, SHAPES[name], parts=parts) == plain(SHAPES[name])


def test_random_graphs_of_binary_nodes(spark):
    draw = random.Random(4)
    links = [(draw.randbytes(1), draw.randbytes(1)) for _ in range(110)]
    links = [(a, b) for a, b in links if a != b]
    assert found(spark, [(bytearray(a), bytearray(b)) for a, b in links], "binary") == plain(links)


def test_loops_nulls_and_no_links(spark):
    assert found(spark, [(1, 1), (2, None), (None, None), (7, 4)]) == {7: 4, 4: 4}
    assert found(spark, []) == {}
