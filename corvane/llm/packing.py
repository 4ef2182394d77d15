"""Items of varying size into containers of one capacity, by bounded-space online best fit.

Each task keeps a fixed number of open containers. An item goes into the open container that it leaves the least room in; if
none fits, the fullest is emitted and a new one opened. What is still open at the end of a task, at most `open_windows`
containers, is merged in further rounds of the same packing, whole containers being the items, over ever fewer tasks.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.session import cut

CAPACITY = 2_048
OPEN_WINDOWS = 64
#: Tasks whose leftovers one task of the next round merges.
FAN_IN = 16


class BestFit:
    """Open containers ordered by fill. put() says where an item goes and which container had to be emitted for it."""

    def __init__(self, capacity: int, windows: int, prefix: str) -> None:
        self.capacity, self.windows, self.prefix = capacity, windows, prefix
        self.open: list[tuple[int, int]] = []  # (fill, number)
        self.count: dict[int, int] = {}
        self.made = 0

    def put(self, size: int) -> tuple[int, int, int, int | None]:
        """(container number, position, fill before, number of the container emitted to make room)."""
        at = bisect_left(self.open, (self.capacity - size + 1, -1)) - 1
        emitted = None
        if at < 0:
            if len(self.open) >= self.windows:
                emitted = self.open.pop()[1]
                del self.count[emitted]
            number, fill = self.made, 0
            self.made += 1
        else:
            fill, number = self.open.pop(at)
        position = self.count.get(number, 0)
        if fill + size == self.capacity:
            self.count.pop(number, None)
        else:
            insort(self.open, (fill + size, number))
            self.count[number] = position + 1
        return number, position, fill, emitted


def _pack(capacity: int, windows: int, label: str):
    """(item, piece, size) -> (item, piece, size, box, position, start, leftover); a box is a task's number and its own count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        prefix = f"{label}{TaskContext.get().partitionId():06d}-"
        fit = BestFit(capacity, windows, prefix)
        for batch in batches:
            out = []
            for item, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if size <= 0:  # needs no room
                    out.append((item, 0, size, None, None, None))
                    continue
                whole, rest = divmod(size, capacity)
                for piece in range(whole):  # an item beyond the capacity: full containers of its own, then the rest
                    out.append((item, piece, capacity, f"{prefix}{fit.made}", 0, 0))
                    fit.made += 1
                if rest:
                    number, position, fill, _ = fit.put(rest)
                    out.append((item, whole, rest, f"{prefix}{number}", position, fill))
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds)), pa.array([None] * len(out), pa.string())], ["item", "piece", "size", "box", "position", "start", "left_box"])
        left = [f"{prefix}{n}" for _, n in fit.open]  # a marker row for each container still open
        if left:
            m = len(left)
            nulls = [pa.nulls(m, k) for k in (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array(left, pa.string())], ["item", "piece", "size", "box", "position", "start", "left_box"])

    return run


_SCHEMA = "item string, piece long, size long, box string, position long, start long, left_box string"


def pack(items: DataFrame, item_col: str, size_col: str, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS, fan_in: int = FAN_IN) -> DataFrame:
    """(item, piece, size, container, position, start, fill) of each item; fill is the used share of the container.

    An item larger than the capacity is cut into full containers and a rest, as pieces 0, 1, ...; any other item is
    one whole piece. Items of size 0 or null need no room: one row with container, position and fill null. Repeated
    items are packed each time. start is the place inside the container where the piece begins.
    """
    if capacity < 1 or open_windows < 1 or fan_in < 2:
        raise ValueError("capacity and open_windows must be positive, fan_in at least 2")
    sized = items.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"))
    placed = cut(sized.mapInArrow(_pack(capacity, open_windows, "c"), _SCHEMA))
    first = placed.where("box is not null").drop("left_box")
    fills = first.groupBy("box").agg(F.sum("size").alias("fill"))
    left = cut(placed.where("left_box is not null").select("left_box").join(fills, F.col("left_box") == F.col("box")).select("box", "fill"))
    moves = None  # box -> (target, offsets); one table a round, each over the boxes left by the round before
    rounds = 0
    tasks = placed.select(F.substring_index("box", "-", 1).alias("t")).where("t is not null").distinct().count()
    while left.limit(1).count():
        tasks, last = max(1, -(-tasks // fan_in)), tasks <= fan_in
        spread = left.repartition(tasks, F.substring_index("box", "-", 1)) if tasks > 1 else left.coalesce(1)
        merged = cut(spread.sortWithinPartitions(F.desc("fill"), "box").select(F.col("box").alias("item"), F.col("fill").alias("size")).mapInArrow(_pack(capacity, open_windows, f"m{rounds}x"), _SCHEMA))
        now = merged.where("left_box is null").select(F.col("item").alias("box"), F.col("box").alias("to"), F.col("start").alias("shift"), "position")
        if moves is None:
            moves = now.select("box", "to", "shift")
        else:
            again = now.toDF("mid", "to2", "shift2", "pos2")
            moves = moves.join(again, moves["to"] == again["mid"], "left").select("box", F.coalesce("to2", "to").alias("to"), (F.col("shift") + F.coalesce("shift2", F.lit(0))).alias("shift"))
        if last:
            break
        size = now.join(left, "box").groupBy("to").agg(F.sum("fill").alias("fill"))
        left = cut(merged.where("left_box is not null").select("left_box").join(size, F.col("left_box") == F.col("to")).select(F.col("to").alias("box"), "fill"))
        rounds += 1
    if moves is not None:
        first = first.join(moves, "box", "left").select("item", "piece", "size", F.coalesce("to", "box").alias("container"), (F.col("start") + F.coalesce("shift", F.lit(0))).alias("start"))
    else:
        first = first.select("item", "piece", "size", F.col("box").alias("container"), "start")
    inside = Window.partitionBy("container")  # a container holds at most `capacity` pieces
    full = first.select("item", "piece", "size", "container", (F.row_number().over(inside.orderBy("start")) - 1).cast("long").alias("position"), "start", (F.sum("size").over(inside) / F.lit(float(capacity))).alias("fill"))
    none = placed.where("box is null and left_box is null").select("item", "piece", "size", F.lit(None).cast("string").alias("container"), F.lit(None).cast("long").alias("position"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("double").alias("fill"))
    return full.unionByName(none)
