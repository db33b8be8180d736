"""Filling fixed-capacity containers with texts (problem 7).

Method: bounded-space online packing. Each partition keeps at most ``windows`` open containers of a kind; an item goes
into the open container it fills best; when it fits none and all windows are open, the fullest is emitted. What is open
at the end of a partition is merged in rounds: leftovers of ``fan_in`` partitions at a time are packed as items, the
largest first, until one group is left. A round holds at most ``fan_in * windows`` leftovers a kind in one task.

Defined results: an item larger than the capacity, and only such a one, is cut into full containers and a rest; items of
size 0 (null and empty texts) need no container and are left out; ties go to the older window; repeated ids are items of
their own; an empty table gives no containers. ``container_id`` is unique but its value has no meaning.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .tokens import TOKENIZERS, encode

SCHEMA = "container_kind string, capacity int, used int, container_id string, grp long, closed boolean, items array<struct<key:{},piece:int,tokens:int>>"


class Windows:
    """Open containers of one kind: a list sorted by free room, so best fit is one search."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.order, self.open, self.n = capacity, most, [], {}, 0

    def put(self, items: list[tuple], size: int) -> tuple[int, list[tuple]] | None:
        """Place items that belong together; returns ``(used, items)`` of a container that had to be emitted, if any."""
        gone = None
        k = bisect_left(self.order, (size, -1))
        if k < len(self.order):
            free, w = self.order.pop(k)
            self.open[w].extend(items)
        else:
            if len(self.order) >= self.most:
                free, w = self.order.pop(0)
                gone = self.capacity - free, self.open.pop(w)
            self.n += 1
            free, w = self.capacity, self.n
            self.open[w] = list(items)
        if free > size:
            insort(self.order, (free - size, w))
        else:
            gone2 = self.capacity, self.open.pop(w)
            return [x for x in (gone, gone2) if x]
        return [gone] if gone else []

    def rest(self) -> list[tuple[int, list[tuple]]]:
        return [(self.capacity - free, self.open[w]) for free, w in self.order]


def _batch(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    item = pa.struct([("key", key), ("piece", pa.int32()), ("tokens", pa.int32())])
    c = list(zip(*rows, strict=True)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays(
        [pa.array(c[0], pa.string()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.string()), pa.array(c[4], pa.int64()), pa.array(c[5], pa.bool_()),
         pa.array([[{"key": k, "piece": p, "tokens": t} for k, p, t in x] for x in c[6]], pa.list_(item))],
        ["container_kind", "capacity", "used", "container_id", "grp", "closed", "items"],
    )


def pack(sizes: DataFrame, kinds: dict[str, int], key: str = "doc_id", size: str = "n_tokens", windows: int = 128, fan_in: int = 32) -> DataFrame:
    """Containers ``container_kind, container_id, capacity, used, items`` that hold every item of ``sizes`` once for each kind.

    ``kinds`` (name -> capacity) is a small parameter; every container of a kind has its capacity.
    """
    kinds = {k: int(c) for k, c in kinds.items() if k is not None and c and c > 0}
    of_key = sizes.schema[key].dataType
    arrow, schema = to_arrow_type(of_key), SCHEMA.format(of_key.simpleString())

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        state, n = {k: Windows(c, windows) for k, c in kinds.items()}, 0

        def full(kind: str, used: int, items: list[tuple]) -> tuple:
            nonlocal n
            n += 1
            return kind, kinds[kind], used, f"{kind}-{part}-{n}", part, True, items

        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for kind, capacity in kinds.items():
                    piece, left = 0, t
                    while left > capacity:
                        out.append(full(kind, capacity, [(k, piece, capacity)]))
                        piece, left = piece + 1, left - capacity
                    out += [full(kind, *x) for x in state[kind].put([(k, piece, left)], left)]
            if out:
                yield _batch(out, arrow)
        yield _batch([(kind, kinds[kind], used, f"{kind}-{part}-o{j}", part, False, items) for kind, w in state.items() for j, (used, items) in enumerate(w.rest())], arrow)

    def merge(level: int):
        def run(key_: tuple, group: pa.Table) -> pa.Table:
            kind, grp = key_[0].as_py(), key_[1].as_py()
            rows = sorted(zip(group["used"].to_pylist(), group["container_id"].to_pylist(), group["items"].to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
            w, out, n = Windows(kinds[kind], windows), [], 0
            for used, _, items in rows:
                for u, x in w.put([(i["key"], i["piece"], i["tokens"]) for i in items], used):
                    n += 1
                    out.append((kind, kinds[kind], u, f"{kind}-m{level}-{grp}-{n}", grp, True, x))
            out += [(kind, kinds[kind], u, f"{kind}-m{level}-{grp}-o{j}", grp, False, x) for j, (u, x) in enumerate(w.rest())]
            return pa.Table.from_batches([_batch(out, arrow)])

        return run

    from ..session import materialize

    items = sizes.select(F.col(f"`{key}`").alias("key"), F.col(f"`{size}`").cast("int").alias("tokens")).filter(F.col("tokens") > 0)
    now = materialize(items.mapInArrow(first, schema), "packed")
    done = now.filter("closed")
    left, level = now.filter("not closed"), 0
    groups = (left.agg(F.max("grp")).first()[0] or 0) + 1
    while True:
        groups, level = -(-groups // fan_in), level + 1
        merged = left.withColumn("grp", F.floor(F.col("grp") / fan_in)).groupBy("container_kind", "grp").applyInArrow(merge(level), schema)
        if groups == 1:
            done = done.unionByName(merged)
            break
        merged = materialize(merged, "packed")
        done, left = done.unionByName(merged.filter("closed")), merged.filter("not closed")
    return done.select("container_kind", "container_id", "capacity", "used", F.transform("items", lambda i: F.struct(i["key"].alias(key), i["piece"].alias("piece"), i["tokens"].alias("tokens"))).alias("items"))


def pack_documents(documents: DataFrame, containers: DataFrame, tokenizers: str = TOKENIZERS, windows: int = 128) -> DataFrame:
    """Documents, measured in tokens of a public tokenizer, in containers of every kind of ``containers`` (a dimension of a few rows)."""
    kinds = {r[0]: r[1] for r in containers.select("container_kind", "capacity_tokens").distinct().collect()}
    return pack(encode(documents, tokenizers=tokenizers, counts=True), kinds, windows=windows)
