"""Look-ahead alignment of two tables of which one lost rows, in chunks: no task holds or walks a whole group.

The walk is sequential: its state is a left row and a place on the right. The right side is cut into chunks, and a walk enters
a chunk at one of its first ``ahead + 1`` places. A first pass finds, for each of these and every left row, where the walk leaves
the chunk; a second follows these hand-overs from the start of the group; a third walks each chunk from its true entry.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.operators.order import numbered
from cellsight.operators.storage import stored

LOOK_AHEAD = 20
#: Right rows of a chunk.
CHUNK = 1 << 14


def _sections(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """``(group, chunk), rows`` of sorted batches; a chunk that goes on in the next batch comes in several pieces."""
    for pdf in batches:
        same = (pdf["g"] == pdf["g"].shift()) & (pdf["chunk"] == pdf["chunk"].shift())
        for _, part in pdf.groupby((~same).cumsum(), sort=False):
            yield (int(part["g"].iloc[0]), int(part["chunk"].iloc[0])), part


class _Exits:
    """Where walks that begin at each place of a chunk leave it, given the left rows from some row on; rows come last first."""

    def __init__(self, size: int, ahead: int):
        self.size, self.ahead, self.places, self.moves = size, ahead, {}, {}
        self.row, self.at = np.full(size + ahead + 1, -1), np.full(size + ahead + 1, -1)

    def add(self, key: str, at: int) -> None:
        self.places.setdefault(key, []).append(at)

    def move(self, key: str) -> tuple[np.ndarray, np.ndarray]:
        """Places from which a left row of this key finds a partner, and where the walk goes on from each."""
        if key not in self.moves:
            here, there, last = [], [], -1
            for j in self.places[key]:
                first = max(last + 1, j - self.ahead)
                stop = min(j + 1, self.size)
                here += range(first, stop)
                there += [j + 1] * max(0, stop - first)
                last = j
            self.moves[key] = np.array(here, np.int64), np.array(there, np.int64)
        return self.moves[key]

    def step(self, key: str, row: int) -> list[tuple[int, int, int, int]]:
        """Takes in an earlier left row; returns ``entry, row, exit row, exit place`` of the entries whose exit it changes."""
        here, there = self.move(key)
        out = there >= self.size
        rows, at = np.where(out, row + 1, self.row[there]), np.where(out, there, self.at[there])
        new = (here <= self.ahead) & ((rows != self.row[here]) | (at != self.at[here]))
        self.row[here], self.at[here] = rows, at
        return [(int(e), row, int(r), int(a)) for e, r, a in zip(here[new], rows[new], at[new])]


def _exit_tables(size: int, ahead: int):
    def go(batches):
        now, exits = None, None
        for name, part in _sections(batches):
            if name != now:
                now, exits = name, _Exits(size, ahead)
            found = []
            for left, key, row in zip(part["is_left"], part["key"], part["n"]):
                if not left:
                    exits.add(key, row - now[1] * size)
                else:
                    found += exits.step(key, row)
            if found:
                e, row, to, at = zip(*found)
                yield pd.DataFrame({"g": now[0], "chunk": now[1], "entry": e, "row": row, "to_row": to, "to_at": at})

    return go


def _follow(size: int):
    """Entries of all chunks that the walk reaches, from tables sorted by group, chunk, entry and row; holds one state."""

    def go(batches):
        group, chunk, row, at = None, 0, 0, 0
        for pdf in batches:
            found = []
            for g, c, e, r, to, there in zip(pdf["g"], pdf["chunk"], pdf["entry"], pdf["row"], pdf["to_row"], pdf["to_at"]):
                if g != group:
                    group, chunk, row, at = g, 0, 0, 0
                if c == chunk and e == at and r >= row:
                    # an exit of -1: the walk ends in this chunk
                    chunk, row, at = (c + 1, to, there - size) if to >= 0 else (-1, 0, 0)
                    if to >= 0:
                        found.append((g, chunk, row, at))
            yield pd.DataFrame(found, columns=["g", "chunk", "enter_row", "enter_at"])

    return go


def _walks(size: int, ahead: int):
    def go(batches):
        now, places, at = None, {}, 0
        for name, part in _sections(batches):
            if name != now:
                now, places, at = name, {}, int(part["enter_at"].iloc[0])
            found = []
            for left, key, row, place in zip(part["is_left"], part["key"], part["n"], part["place"]):
                if not left:
                    places.setdefault(key, ([], []))[0].append(row - now[1] * size)
                    places[key][1].append(place)
                elif at < size:
                    own, where = places[key]
                    i = bisect_left(own, at)
                    if i < len(own) and own[i] <= at + ahead:
                        found.append((now[0], row, where[i]))
                        at = own[i] + 1
            yield pd.DataFrame(found, columns=["g", "n", "right_position"])

    return go


def align(left: DataFrame, right: DataFrame, group: str = "part", order: str = "position", key: str = "key", ahead: int = LOOK_AHEAD, chunk: int = CHUNK) -> DataFrame:
    """``group, left_position, right_position``: each left row meets the next equal right row at most ``ahead`` rows on, in order.

    Rows without a partner have a null place; null keys have none; null groups are a group; equal places are in order of the key.
    A task holds ``chunk`` right rows and streams over the left rows that share a key with them. Hand-overs are followed in one
    task for a group of several chunks; only rows that change an exit are there, and it holds one at a time. A key that is in
    many chunks meets its left rows in each of them.
    """
    if chunk <= ahead:
        raise ValueError("a chunk must be longer than the look-ahead")
    sides = {}
    names = stored(left.select(F.col(group).alias("part")).union(right.select(F.col(group))).distinct().withColumn("g", F.monotonically_increasing_id()))
    for name, df in (("left", left), ("right", right)):
        own = df.select(F.col(group).alias("p"), F.col(order).cast("long").alias("place"), F.col(key).cast("string").alias("key"))
        own = own.join(names, F.col("p").eqNullSafe(F.col("part"))).select("g", "place", "key")
        sides[name] = stored(numbered(own, ["g"], ["place", "key"], "n"))
    own = F.floor(F.col("n") / chunk).cast("long")
    # the first rows of a chunk are also looked at from the one before
    among = F.when((F.col("n") % chunk < ahead) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    held = sides["right"].where("key IS NOT NULL").select("g", F.explode(among).alias("chunk"), F.lit(False).alias("is_left"), "n", "key", "place")
    met = sides["left"].where("key IS NOT NULL").join(held.select("g", "chunk", "key").distinct(), ["g", "key"]).select("g", "chunk", F.lit(True).alias("is_left"), "n", "key", "place")
    rows = stored(held.union(met))
    last = sides["right"].groupBy("g").agg(F.max(own).alias("last"))
    several = rows.join(last, "g").where(F.col("chunk") < F.col("last")).select(*rows.columns)
    back = F.when(F.col("is_left"), -F.col("n")).otherwise(F.col("n"))
    tables = several.repartition("g", "chunk").sortWithinPartitions("g", "chunk", "is_left", back).mapInPandas(_exit_tables(chunk, ahead), "g long, chunk long, entry long, row long, to_row long, to_at long")
    entries = tables.repartition("g").sortWithinPartitions("g", "chunk", "entry", "row").mapInPandas(_follow(chunk), "g long, chunk long, enter_row long, enter_at long")
    first = names.select("g", F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("enter_row"), F.lit(0).cast("long").alias("enter_at"))
    entries = stored(entries.union(first))
    reached = rows.join(entries, ["g", "chunk"]).where(~F.col("is_left") | (F.col("n") >= F.col("enter_row")))
    found = reached.repartition("g", "chunk").sortWithinPartitions("g", "chunk", "is_left", "n").mapInPandas(_walks(chunk, ahead), "g long, n long, right_position long")
    out = sides["left"].join(found, ["g", "n"], "left").join(names, "g")
    return out.select(F.col("part").alias(group), F.col("place").alias("left_position"), "right_position")
