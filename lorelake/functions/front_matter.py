"""Front-matter YAML text → flat typed nodes, one Arrow batch at a time.

This is the only place where Python sees corpus text, and it only receives the
front-matter block.  Everything derived from the nodes is a Spark expression.
"""

from __future__ import annotations

import functools
import itertools
import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorelake.functions.text import let

MAX_DEPTH = 64
MAX_NODES = 1_000_000  # alias expansion guard

NODE = T.StructType(
    [
        T.StructField("path", T.StringType()),  # JSON pointer, "" is the root
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
PARSED = T.StructType(
    [
        T.StructField("state", T.StringType()),  # mapping / empty / other / invalid / deep
        T.StructField("error", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("column", T.IntegerType()),
        T.StructField("nodes", T.ArrayType(NODE)),
        T.StructField("odd_keys", T.IntegerType()),
        T.StructField("json", T.StringType()),
    ]
)

_NULLS = {"", "~", "null", "Null", "NULL"}
_BOOLS = {"true": "true", "True": "true", "TRUE": "true",
          "false": "false", "False": "false", "FALSE": "false"}
# What a plain value begins with that may be no string.
_TYPED = frozenset("+-.0123456789~nNtTfF")
_INT = re.compile(r"[-+]?(0|[1-9][0-9]*)$")
_RADIX = re.compile(r"[-+]?0([xob])([0-9A-Fa-f]+)$")
_FLOAT = re.compile(r"[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?$")
_ODD_FLOAT = re.compile(r"([-+]?\.(inf|Inf|INF)|\.(nan|NaN|NAN))$")
_CORE = "tag:yaml.org,2002:"
_to_json = json.JSONEncoder(ensure_ascii=False).encode


def _scalar(node) -> tuple[str, str | None]:
    """(kind, text) under the YAML 1.2 core schema; dates stay strings."""
    value = node.value
    if node.style:  # quoted or block style (the C parser reports plain as "")
        return "string", value
    if value and value[0] not in _TYPED:
        return "string", value
    if value in _NULLS:
        return "null", None
    if value in _BOOLS:
        return "boolean", _BOOLS[value]
    if _INT.match(value):
        return "integer", str(int(value))
    radix = _RADIX.match(value)
    if radix:
        try:
            return "integer", str(int(value, 0))
        except ValueError:
            return "string", value
    if _ODD_FLOAT.match(value):
        return "float", value.lower()
    if _FLOAT.match(value) and not re.match(r"[-+]?0[0-9]+$", value):
        return "float", repr(float(value)).replace("e+", "e")
    return "string", value


class _TooDeep(Exception):
    pass


def _plain(kind, text):
    if kind == "boolean":
        return text == "true"
    if kind == "integer":
        number = int(text)
        return number if abs(number) < 1 << 53 else text
    if kind == "float":
        number = float(text.replace(".inf", "inf").replace(".nan", "nan"))
        return number if number - number == 0 else text
    return text


def _walk(node, path, depth, out):
    import yaml

    if depth > MAX_DEPTH:
        raise _TooDeep
    if len(out) > MAX_NODES:
        raise yaml.MarkedYAMLError(problem="repetition limit exceeded", problem_mark=node.start_mark)
    if not node.tag.startswith(_CORE) and node.tag != "!":
        out.append((path, "tagged", node.tag))
        inner = type(node)(_CORE + "str", node.value, node.start_mark, node.end_mark)
        if isinstance(node, yaml.ScalarNode):
            inner.style = node.style
        return {"tag": node.tag, "value": _walk(inner, path + "/!", depth + 1, out)}
    if isinstance(node, yaml.ScalarNode):
        kind, text = _scalar(node)
        out.append((path, kind, text))
        return _plain(kind, text)
    if isinstance(node, yaml.SequenceNode):
        out.append((path, "sequence", None))
        return [_walk(item, f"{path}/{i}", depth + 1, out) for i, item in enumerate(node.value)]
    out.append((path, "mapping", None))
    result, seen = {}, set()
    for key, value in node.value:
        if isinstance(key, yaml.ScalarNode):
            kind, text = _scalar(key)
        else:
            kind, text = "complex", yaml.serialize(key)
        if (kind, text) in seen:
            raise yaml.MarkedYAMLError(
                problem=f"duplicate entry with key {text!r}", problem_mark=key.start_mark)
        seen.add((kind, text))
        name = "" if text is None else text
        step = path + "/" + name.replace("~", "~0").replace("/", "~1")
        if kind == "complex":
            _walk(key, step + "/?", depth + 1, out)
        elif kind != "null":
            out.append((step, "key" if kind == "string" else "key:" + kind, text))
        result[name] = _walk(value, step, depth + 1, out)
    return result


@functools.cache
def _loader():
    """A loader that tells no kinds: ``_scalar`` does, so a node without a tag gets that of its class."""
    import yaml

    if not hasattr(yaml, "CBaseLoader"):
        return yaml.BaseLoader
    tags = {yaml.ScalarNode: _CORE + "str", yaml.SequenceNode: _CORE + "seq", yaml.MappingNode: _CORE + "map"}

    class Loader(yaml.CBaseLoader):
        def descend_resolver(self, parent, index):
            pass

        def ascend_resolver(self):
            pass

        def resolve(self, kind, value, implicit):
            return tags[kind]

    return Loader


def _parse(text):
    import yaml

    try:
        node = yaml.compose(text, Loader=_loader())
        if node is None or (isinstance(node, yaml.ScalarNode) and _scalar(node)[0] == "null"
                            and node.tag.startswith(_CORE)):
            return ("empty", None, None, None, [], 0, None)
        nodes: list = []
        plain = _walk(node, "", 0, nodes)
    except _TooDeep:
        return ("deep", f"YAML nesting exceeds the supported depth of {MAX_DEPTH}.",
                None, None, [], 0, None)
    except yaml.YAMLError as error:
        mark = getattr(error, "problem_mark", None)
        problem = getattr(error, "problem", None) or str(error)
        return ("invalid", problem, mark.line + 2 if mark else None,
                mark.column + 1 if mark else None, [], 0, None)
    if not isinstance(node, yaml.MappingNode) or not node.tag.startswith(_CORE):
        return ("other", None, None, None, [], 0, None)
    odd = sum(1 for key, _ in node.value
              if not (isinstance(key, yaml.ScalarNode) and _scalar(key)[0] == "string"))
    return ("mapping", None, None, None, nodes, odd, _to_json(plain))


def parse_column(yaml_text: Column) -> Column:
    """Struct of parse state and flat nodes; null for a null input."""
    arrow = pa.struct(
        [
            ("state", pa.string()), ("error", pa.string()), ("line", pa.int32()),
            ("column", pa.int32()),
            ("nodes", pa.list_(pa.struct([("path", pa.string()), ("kind", pa.string()),
                                          ("text", pa.string())]))),
            ("odd_keys", pa.int32()), ("json", pa.string()),
        ]
    )
    node = arrow.field("nodes").type.value_type
    at = [f.name for f in PARSED].index("nodes")

    @F.arrow_udf(PARSED)
    def parse_yaml(texts: pa.Array) -> pa.Array:
        rows = [(None,) * at + ((),) + (None,) * (len(arrow) - at - 1) if text is None else _parse(text) for text in texts.to_pylist()]
        # Column by column: building a dictionary for every node costs more than parsing.
        flat = [n for row in rows for n in row[at]]
        parts = [pa.array(part, field.type) for part, field in zip(zip(*flat) if flat else [()] * len(node), node)]
        ends = list(itertools.accumulate((len(row[at]) for row in rows), initial=0))
        columns = [pa.array([row[i] for row in rows], field.type) for i, field in enumerate(arrow) if i != at]
        columns.insert(at, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(node)), type=arrow.field(at).type))
        return pa.StructArray.from_arrays(columns, fields=list(arrow), mask=texts.is_null())

    return parse_yaml.asNondeterministic()(yaml_text)


# -- expressions over the node array --------------------------------------


def is_value(node: Column) -> Column:
    return ~F.startswith(node["kind"], F.lit("key"))


def node_at(nodes: Column, path: str) -> Column:
    """The value node at a JSON pointer, or null."""
    return F.get(F.filter(nodes, lambda n: (n["path"] == path) & is_value(n)), F.lit(0))


def scalar_at(nodes: Column, path: str, number: bool = True) -> Column:
    kinds = ["string", "integer", "float"] if number else ["string"]
    return let(node_at(nodes, path), lambda node: F.when(node["kind"].isin(kinds), node["text"]))


def leaf_texts(nodes: Column) -> Column:
    """Scalar leaves, mapping keys and values, in document order."""
    kept = F.filter(
        nodes,
        lambda n: n["text"].isNotNull() & ~n["kind"].isin("tagged", "null", "sequence", "mapping"),
    )
    return F.transform(
        kept,
        lambda n: F.when(
            n["kind"].isin("float", "key:float"), F.regexp_replace(n["text"], r"\.0$", "")
        ).otherwise(n["text"]),
    )


def field_texts(nodes: Column, root: str, field: str) -> Column:
    """String values of a mapping field anywhere under a top-level field."""
    return F.transform(
        F.filter(
            nodes,
            lambda n: (n["kind"] == "string")
            & F.startswith(n["path"], F.lit(f"/{root}/"))
            & F.endswith(n["path"], F.lit(f"/{field}")),
        ),
        lambda n: n["text"],
    )
