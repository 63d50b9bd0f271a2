"""Flattening nested records into related tables by shared inlining.

The schema is read as a graph of element types. A struct that occurs once
below its parent is inlined into it; what repeats (arrays), is shared by
several parents or would recurse gets a table of its own, with foreign keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Node:
    """A relation of the plan: where it hangs and what is inlined in it."""

    name: str
    parent: str | None = None
    path: str = ""  # from the parent's element to this one, dotted
    full: str = ""  # from the root, with underscores
    repeated: bool = False
    shared: str | None = None  # the type, if several parents have it
    inlined: dict[str, str] = field(default_factory=dict)  # column -> dotted path
    children: list["Node"] = field(default_factory=list)


def _element(kind: T.DataType) -> tuple[T.DataType, bool]:
    return (kind.elementType, True) if isinstance(kind, T.ArrayType) else (kind, False)


def shared_types(schema: T.StructType) -> set[tuple[str, str]]:
    """(name, type) of struct elements that occur with the same fields below more than one parent."""
    seen: dict[tuple[str, str], set[str]] = {}

    def walk(struct: T.StructType, owner: str) -> None:
        for f in struct.fields:
            kind, _ = _element(f.dataType)
            if isinstance(kind, T.StructType):
                seen.setdefault((f.name, kind.simpleString()), set()).add(owner)
                walk(kind, f"{owner}.{f.name}")

    walk(schema, "")
    return {element for element, owners in seen.items() if len(owners) > 1}


def plan(schema: T.StructType, root: str) -> Node:
    """The relations that shared inlining makes of a schema, as a tree from root."""
    shared = shared_types(schema)

    def fill(node: Node, struct: T.StructType, path: str, prefix: str) -> None:
        for f in struct.fields:
            kind, repeated = _element(f.dataType)
            at = f"{path}.{f.name}" if path else f.name
            common = isinstance(kind, T.StructType) and (f.name, kind.simpleString()) in shared
            if repeated or common:
                child = Node(f.name, node.name, at, f"{node.full}_{at.replace('.', '_')}", repeated, kind.simpleString() if common else None)
                if isinstance(kind, T.StructType):
                    fill(child, kind, "", "")
                else:
                    child.inlined["value"] = ""
                node.children.append(child)
            elif isinstance(kind, T.StructType):
                fill(node, kind, at, f"{prefix}{f.name}_")
            else:
                node.inlined[prefix + f.name] = at
    top = Node(root, full=root)
    fill(top, schema, "", "")
    return top


def shred(df: DataFrame, key: str, root: str = "record") -> dict[str, DataFrame]:
    """Flat tables of nested records, by the name of their relation, of like-named ones by the whole path from the second on.

    Every table has the record's key and, for each repeated level above it, the
    position there (``<level>_no``, from 1, null elements included in the
    counting). (key, positions) is the primary key; without its last position
    it is the foreign key to the parent's table. Elements of a shared type,
    single or repeated, lie in one table per type, with ``parent`` naming the
    relation they belong to, and the path in it if they lie deeper. Null elements and null or empty arrays give no
    rows; a struct whose fields are all null is a row. Repeated records stay
    repeated. Narrow: one generator per level, no shuffle.
    """
    top = plan(df.schema, root)
    out: dict[str, DataFrame] = {}
    kinds: dict[tuple[str, str], str] = {}  # the table of each shared type

    def named(node: Node) -> str:
        name = node.name if node.name not in out else node.full
        while name in out:
            name += "_"
        return name

    def emit(node: Node, at: DataFrame, keys: list[str]) -> None:
        cols = [F.col(f"_e.{p}" if p else "_e").alias(c) for c, p in node.inlined.items() if c not in keys]
        rows = at.select(*[F.col(f"`{k}`") for k in keys], *cols)
        if node.shared:
            within = node.path.rpartition(".")[0]  # below what is inlined in the parent
            rows = rows.select(F.lit(f"{node.parent}.{within}" if within else node.parent).alias("parent"), "*")
            name = kinds.get((node.name, node.shared))
            if name is None:
                name = kinds[node.name, node.shared] = named(node)
                out[name] = rows
            else:
                out[name] = out[name].unionByName(rows, allowMissingColumns=True)
        else:
            out[named(node)] = rows
        for child in node.children:
            source = F.col(f"_e.{child.path}")
            if child.repeated:
                no = f"{child.name}_no" if f"{child.name}_no" not in keys else f"{child.full}_no"
                below = at.select(*[F.col(f"`{k}`") for k in keys], F.posexplode(source).alias("_p", "_x")).filter("_x IS NOT NULL")
                emit(child, below.select(*[F.col(f"`{k}`") for k in keys], (F.col("_p") + 1).alias(no), F.col("_x").alias("_e")), [*keys, no])
            else:
                emit(child, at.select(*[F.col(f"`{k}`") for k in keys], source.alias("_e")).filter("_e IS NOT NULL"), keys)

    emit(top, df.select(F.col(key).alias(key), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_e")), [key])
    return out
