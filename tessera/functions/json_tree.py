"""A table function that walks a JSON text of any depth."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf


@udtf(returnType="depth int, path string, name string")
class JsonNames:
    """A row for each text under the key ``name`` anywhere in the tree: how many objects and lists enclose it, the way there, and the text.

    Texts that are no JSON, empty names and names that are no text give no row.
    The walk keeps a list of its own, so depth is bounded by memory only.
    """

    def eval(self, text: str) -> Iterator[tuple[int, str, str]]:
        try:
            todo = [(0, "$", json.loads(text))] if text else []
        except (ValueError, RecursionError):
            return
        while todo:
            depth, path, node = todo.pop()
            if isinstance(node, dict):
                name = node.get("name")
                if isinstance(name, str) and name:
                    yield depth + 1, path, name
                todo += [(depth + 1, f"{path}.{k}", v) for k, v in reversed(node.items()) if isinstance(v, dict | list)]
            elif isinstance(node, list):
                todo += [(depth + 1, f"{path}[{i}]", v) for i, v in reversed(list(enumerate(node))) if isinstance(v, dict | list)]


def names_in(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``key``, ``depth``, ``path``, ``name`` of the names in a JSON column, by a lateral join with the table function."""
    spark = rows.sparkSession
    spark.udtf.register("tessera_json_names", JsonNames)
    return spark.sql(f"SELECT r.`{key}`, n.depth, n.path, n.name FROM {{rows}} r, LATERAL tessera_json_names(r.`{column}`) n", rows=rows)
