"""Functions on binary trees for SQL: ``register(spark)`` adds them to a session.

``nbt_json(payload, comp)``, ``nbt_get(payload, comp, path)`` and ``nbt_canonical(payload, comp)`` give
null for what can't be read; ``nbt_nodes(payload, comp)`` is a table function with a row for each node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources import nbt
from ..sources.world import decode

NODES = "path string, parent string, key string, idx int, ident string, depth int, tag int, i64 bigint, f64 double, str string, bin binary, ints array<bigint>"


def _tree(payload: bytes | None, comp: int | None) -> nbt.Node | None:
    if payload is None or comp is None:
        return None
    try:
        return decode(int(comp), bytes(payload))
    except ValueError:
        return None


def _get(tree: nbt.Node, path: str) -> str | None:
    found = nbt.get(tree, nbt.parse_path(path))
    return None if found is None else nbt.to_json(found)


def nodes(tree: nbt.Node) -> Iterator[tuple]:
    """Rows of NODES, parents before children; the root has the empty path."""
    stack: list[tuple] = [((), None, None, tree)]
    while stack:
        path, key, idx, node = stack.pop()
        tag, v = node
        number, text = (v if tag <= nbt.LONG else None), nbt.path_text(list(path))
        yield (
            text, nbt.path_text(list(path[:-1])) if path else None, key, idx, nbt.identity(node), len(path), tag, number,
            float(v) if tag in (nbt.FLOAT, nbt.DOUBLE) else None, v if tag == nbt.STRING else None, bytes(v) if tag == nbt.BYTES else None, list(v) if tag in (nbt.INTS, nbt.LONGS) else None,
        )
        if tag == nbt.COMPOUND:
            stack += [((*path, k), k, None, x) for k, x in reversed(v.items())]
        elif tag == nbt.LIST:
            stack += [((*path, i), None, i, x) for i, x in reversed(list(enumerate(v)))]


def register(spark: SparkSession) -> None:
    def of(f: Callable, kind: str):  # noqa: ANN202
        def work(payload: pd.Series, comp: pd.Series) -> pd.Series:
            return pd.Series([None if (t := _tree(p, c)) is None else f(t) for p, c in zip(payload, comp, strict=True)], dtype=object)

        return F.pandas_udf(work, kind)

    def get(payload: pd.Series, comp: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([None if (t := _tree(p, c)) is None or s is None else _get(t, s) for p, c, s in zip(payload, comp, path, strict=True)], dtype=object)

    class Nodes:
        def eval(self, payload: bytes, comp: int) -> Iterator[tuple]:
            tree = _tree(payload, comp)
            if tree is not None:
                yield from nodes(tree)

    spark.udf.register("nbt_json", of(nbt.to_json, "string"))
    spark.udf.register("nbt_canonical", of(nbt.canonical, "binary"))
    spark.udf.register("nbt_get", F.pandas_udf(get, "string"))
    spark.udtf.register("nbt_nodes", F.udtf(Nodes, returnType=NODES))
