"""Op 12: repair of the structure of conversations by a weighted automaton that is determinised on demand.

The wanted shape, an optional system turn and then pairs of user and assistant turns, has four places: nothing yet,
after the system turn, after a user, after an assistant. Edits have costs, so each point of a conversation has four
costs of what is still to come. Taken less their least, these vectors repeat: they are the states of a deterministic
automaton, found when first met and kept in a transition table with the cost that each step adds. The scan over the
table goes from the last turn to the first, so that the trace, which goes backward over it along arcs that are tight,
meets the turns in order and can take the least letter: from a place, a letter leads to one other place only, so the
least letter at each step gives the least audit.

Conversations are numbered through ranges and scanned in blocks. A long one has blocks whose steps are composed: each
gives the costs between its ends, a pass over blocks from the last hands these over, every block is traced from
each of the four places, and the last pass chooses. Only that pass, which digests the repaired text, is sequential, as
the digest is; it streams over sorted rows and keeps no turns.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellsight.llm.common import bound_batches, settle

#: Turns of one block.
BLOCK_TURNS = 1024
SPACES = " \t\n\x0b\x0c\r"
HAS_WORD = r"[^\x20\x09-\x0D]"
NEVER = 1 << 40
REROLE, DELETE, INSERT, LEFT_OPEN = 2, 3, 2, 1
#: Places: 0 nothing yet, 1 after the system turn, 2 after a user, 3 after an assistant. Where a user or assistant turn leads.
ALTERNATE = (2, 2, 3, 2)
ROLE_AT = ("user", "user", "assistant", "user")
DONE = (0, None, None, 0)


def _keep(place: int, initial: str) -> int | None:
    """Where a kept turn leads; None where it can't stand."""
    if initial == "s":
        return 1 if place == 0 else None
    return ALTERNATE[place] if initial == ROLE_AT[place][0] else None


def _closed(costs: list[int]) -> tuple[int, ...]:
    """Costs with insertions allowed first; after two of them nothing gets cheaper."""
    for _ in range(3):
        costs = [min(c, NEVER, INSERT + costs[ALTERNATE[p]]) for p, c in enumerate(costs)]
    return tuple(costs)


class Automaton:
    """States are normalised vectors of the costs to come; steps are worked out when first needed.

    A turn's symbol is ``b`` blank, ``d`` repeated, else the initial of its role among ``s u a o``, in capitals if its text is
    left open. There are 10 symbols and few vectors, as costs of places differ by less than some edits.
    """

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.table: dict[tuple[int, str], tuple[int, int]] = {}
        self.arcs: dict[tuple[int, str, int], tuple[str, int]] = {}
        self.end, self.end_cost = self.state([NEVER if c is None else c for c in DONE])

    def state(self, costs) -> tuple[int, int]:
        """The state of a vector of costs, and what was taken off."""
        closed = _closed(list(costs))
        least = min(closed)
        vector = tuple(c if c >= NEVER else c - least for c in closed)
        number = self.numbers.setdefault(vector, len(self.vectors))
        if number == len(self.vectors):
            self.vectors.append(vector)
        return number, least

    def _choices(self, after: tuple[int, ...], symbol: str, place: int) -> list[tuple[str, int, int]]:
        """Letter, cost and next place of the edits that use up a turn."""
        found = [("D", DELETE + after[place], place)]
        if symbol not in "bd":
            open_ = LEFT_OPEN if symbol.isupper() else 0
            to = _keep(place, symbol.lower())
            if to is not None:
                found.append(("K", open_ + after[to], to))
            found.append(("R", REROLE + open_ + after[ALTERNATE[place]], ALTERNATE[place]))
        return found

    def step(self, after: int, symbol: str) -> tuple[int, int]:
        """The state before a turn, and the cost that normalising took off."""
        found = self.table.get((after, symbol))
        if found is None:
            vector = self.vectors[after]
            found = self.table[after, symbol] = self.state([min(c for _, c, _ in self._choices(vector, symbol, p)) for p in range(4)])
        return found

    def scan(self, symbols: str, after: int) -> tuple[list[int], int]:
        """The states at every point, the first one included, and the cost taken off in all."""
        states, total, table = [after], 0, self.table
        for symbol in reversed(symbols):
            after, cost = table.get((after, symbol)) or self.step(after, symbol)
            total += cost
            states.append(after)
        states.reverse()
        return states, total

    def arc(self, after: int, symbol: str, place: int) -> tuple[str, int]:
        """The least letters that use up a turn along tight arcs from ``place``, and the next place."""
        found = self.arcs.get((after, symbol, place))
        if found is None:
            before, off = self.step(after, symbol)
            costs = [c + off for c in self.vectors[before]]
            inserts, at = "", place
            while True:
                tight = {letter: to for letter, cost, to in self._choices(self.vectors[after], symbol, at) if cost == costs[at]}
                if "D" not in tight and INSERT + costs[ALTERNATE[at]] == costs[at]:
                    inserts, at = inserts + "I", ALTERNATE[at]
                    continue
                letter = min(tight)
                break
            found = self.arcs[after, symbol, place] = inserts + letter, tight[letter]
        return found

    def trace(self, symbols: str, states: list[int], place: int) -> tuple[str, int]:
        """The letters for a block of turns from ``place``, and the place after it."""
        letters = []
        for symbol, after in zip(symbols, states[1:]):
            piece, place = self.arcs.get((after, symbol, place)) or self.arc(after, symbol, place)
            letters.append(piece)
        return "".join(letters), place

    def tail(self, place: int) -> str:
        """Insertions after the last turn."""
        found = ""
        while DONE[place] is None:
            found, place = found + "I", ALTERNATE[place]
        return found


#: One table for each Python worker; it depends on nothing but the costs above.
AUTOMATON = Automaton()


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, copy`` after the stated damage; null roles and texts are one space, as are null ids and turns in the checksum."""
    c = conversations.select(conversations[conv].alias("conv_id"), conversations[turn].cast("long").alias("turn"), F.coalesce(conversations[role].cast("string"), F.lit(" ")).alias("role"), F.coalesce(conversations[text].cast("string"), F.lit(" ")).alias("text"))
    blank = F.lit(" ")
    hit = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text_now = F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return c.withColumn("hit", hit).where("hit <> 0").select("conv_id", "turn", F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text_now.alias("text"), F.explode(copies).alias("copy"))


def _symbol(role: Column, blank: Column, again: Column, open_: Column) -> Column:
    first = F.substring(role, 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("o"))
    return F.when(blank, F.lit("b")).when(again, F.lit("d")).when(open_, F.upper(initial)).otherwise(initial)


ORDER = ["turn", "role", "digest", "tie"]


def _blocks(ranged: DataFrame, block_turns: int) -> DataFrame:
    """``conv, block, n_blocks, symbols, first``: the turns of a block as symbols in order, and where its first turn stands."""
    of_conv = W.partitionBy("conv")
    counts = ranged.groupBy("conv", "part").agg(F.count("*").alias("here"))
    counts = counts.select("conv", "part", (F.sum("here").over(of_conv.orderBy("part")) - F.col("here")).alias("before"), F.sum("here").over(of_conv).alias("total"))
    light = ranged.drop("text").join(counts, ["conv", "part"])
    ranked = light.withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("conv", "part").orderBy(*ORDER)) - 1)
    # repeated texts: few keys, counted before the shuffle; the join back is one that can be split where a text is hot
    ranked = settle(ranked.select("conv", *ORDER, "blank", "open", "rank", "total"), "ranks")
    earliest = ranked.where(~F.col("blank")).groupBy("conv", "role", "digest").agg(F.min("rank").alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = ranked.join(earliest, ["conv", "role", "digest"], "left")
    symbol = _symbol(F.col("role"), F.col("blank"), F.coalesce(F.col("rank") > F.col("earliest"), F.lit(False)), F.col("open"))
    block = F.floor(F.col("rank") / block_turns).cast("long")
    grouped = marked.select("conv", block.alias("block"), "rank", "total", symbol.alias("symbol"), F.struct(*ORDER).alias("at")).groupBy("conv", "block")
    each = grouped.agg(F.array_sort(F.collect_list(F.struct("rank", "symbol"))).alias("s"), F.min("at").alias("first"), F.max("total").alias("total"))
    return each.select("conv", "block", F.ceil(F.col("total") / block_turns).cast("long").alias("n_blocks"), F.array_join(F.transform("s", lambda x: x["symbol"]), "").alias("symbols"), "first")


def _between_ends(symbols: str) -> list[int]:
    """Costs from each of the four places before a block to each of those after it, row by row of the place after."""
    out = []
    for end in range(4):
        after, least = AUTOMATON.state([0 if p == end else NEVER for p in range(4)])
        states, total = AUTOMATON.scan(symbols, after)
        out += [c if c >= NEVER else c + total + least for c in AUTOMATON.vectors[states[0]]]
    return out


def _hand_over(long_: DataFrame) -> DataFrame:
    """``conv, block, after, cost`` for blocks of long conversations: the costs to come after each block, and from its first place."""
    key = long_.schema["conv"].dataType.simpleString()

    def ends(batches):
        for batch in batches:
            costs = [_between_ends(s) for s in batch.column("symbols").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), pa.array(costs, pa.list_(pa.int64()))], names=["conv", "block", "costs"])

    def carry(batches):
        known, now = None, None
        for batch in batches:
            out, total = [], []
            for conv, costs in zip(batch.column("conv").to_pylist(), batch.column("costs").to_pylist()):
                if now is None or conv != known:
                    known, now = conv, [NEVER if c is None else c for c in DONE]
                out.append(now)
                now = [min(NEVER, *(costs[4 * end + p] + now[end] for end in range(4))) for p in range(4)]
                total.append(now[0])
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), pa.array(out, pa.list_(pa.int64())), pa.array(total, pa.int64())], names=["conv", "block", "after", "cost"])

    costs = long_.select("conv", "block", "symbols").mapInArrow(ends, f"conv {key}, block long, costs array<long>")
    ordered = costs.repartition("conv").sortWithinPartitions("conv", F.desc("block"))
    return ordered.mapInArrow(carry, f"conv {key}, block long, after array<long>, cost long")


def _trace(blocks: DataFrame) -> DataFrame:
    """Blocks with ``pieces``, the letters from each of the four places, ``exits``, the places after it, and ``cost``, that of the table's scan."""
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

    def run(batches):
        for batch in batches:
            pieces, exits, costs = [], [], []
            for symbols, block, n, after, cost in zip(*(batch.column(c).to_pylist() for c in ("symbols", "block", "n_blocks", "after", "cost"))):
                number, least = (AUTOMATON.end, AUTOMATON.end_cost) if after is None else AUTOMATON.state(after)
                states, total = AUTOMATON.scan(symbols, number)
                found = [AUTOMATON.trace(symbols, states, p) for p in (range(4) if block else range(1))]
                if block == n - 1:
                    found = [(letters + AUTOMATON.tail(p), p) for letters, p in found]
                pieces.append([x for x, _ in found])
                exits.append([p for _, p in found])
                costs.append(total + least + AUTOMATON.vectors[states[0]][0] if cost is None else cost)
            kept = [batch.column(c) for c in ("conv", "first", "symbols")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pieces, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int32())), pa.array(costs, pa.int64())], names=["conv", "first", "symbols", "pieces", "exits", "cost"])

    kept = [blocks.schema[c] for c in ("conv", "first", "symbols")]
    return blocks.mapInArrow(run, StructType([*kept, StructField("pieces", ArrayType(StringType())), StructField("exits", ArrayType(IntegerType())), StructField("cost", LongType())]))


class Conversation:
    """What one conversation has so far: counts, place, letters and the digest of its repaired turns."""

    def __init__(self, conv):
        self.conv, self.cost, self.place, self.left = conv, None, 0, ""
        self.audit: list[str] = []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = self.initial = None
        self.turns = self.spent = self.exit = 0
        self.digest, self.any = hashlib.sha256(), False

    def block(self, symbols: str, pieces: list[str], exits: list[int], cost: int) -> None:
        if self.cost is None:
            self.cost, self.exit = cost, 0
        choice = self.exit
        self.symbols, self.letters, self.at, self.row = symbols, pieces[choice], 0, 0
        self.exit = exits[choice]
        self.audit.append(self.letters)

    def _put(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.any else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any = True

    def _insert(self) -> None:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self._put(ROLE_AT[self.place], "")
            self.place, self.at, self.spent = ALTERNATE[self.place], self.at + 1, self.spent + INSERT

    def turn(self, turn, role: str, text: str) -> None:
        symbol, self.row = self.symbols[self.row], self.row + 1
        for name, found in (("blank", symbol == "b"), ("duplicate", symbol == "d"), ("truncated", symbol.isupper()), ("illegal", self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"))):
            self.counts[name] += found
        self.initial = role[:1]
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self._insert()
        letter, self.at = self.letters[self.at], self.at + 1
        if letter == "D":
            self.spent += DELETE
        else:
            self.spent += (REROLE if letter == "R" else 0) + (LEFT_OPEN if symbol.isupper() else 0)
            self._put(ROLE_AT[self.place] if letter == "R" else role, text)
            self.place = ALTERNATE[self.place] if letter == "R" else _keep(self.place, symbol.lower())
        if self.row == len(self.symbols) and self.letters[self.at :].strip("I") == "":
            self._insert()

    def result(self) -> dict:
        if self.spent != self.cost:
            raise RuntimeError(f"the audit of conversation {self.conv} costs {self.spent}, the table's scan {self.cost}")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv_id": self.conv, "gaps": gaps, **self.counts, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_turns: int = BLOCK_TURNS) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation, damaged as stated first.

    Turns go by number, nulls first; those of one number by role, then by the SHA-256 of the text, so repeats are adjacent.
    Repeated rows are turns of their own. Null conversation ids are one conversation. Texts are equal if their SHA-256 is. A
    role other than those of the shape must be changed or its turn deleted; an empty role has no initial. Conversations
    whose turns were all dropped have zeros, no audit and the digest of the empty text; no rows give no rows. Other columns
    are not read.
    """
    spark = conversations.sparkSession
    bound_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    rows = damaged(conversations, conv, turn, role, text).select(
        F.struct("conv_id").alias("conv"), "turn", "role", "text", F.sha2("text", 256).alias("digest"), F.monotonically_increasing_id().alias("tie"),
        (~F.col("text").rlike(HAS_WORD)).alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("open"),
    )
    ranged = settle(rows.repartitionByRange(n, "conv", *ORDER).withColumn("part", F.spark_partition_id()), "turns")
    blocks = settle(_blocks(ranged, block_turns), "blocks")
    over = settle(_hand_over(blocks.where("n_blocks > 1")), "over")
    traced = _trace(blocks.join(over, ["conv", "block"], "left"))

    nothing = lambda kind: F.lit(None).cast(kind)
    heads = traced.select("conv", "first.*", F.lit(0).alias("kind"), nothing("string").alias("text"), "symbols", "pieces", "exits", "cost")
    bodies = ranged.select("conv", *ORDER, F.lit(1).alias("kind"), "text", nothing("string").alias("symbols"), nothing("array<string>").alias("pieces"), nothing("array<int>").alias("exits"), nothing("long").alias("cost"))
    ordered = heads.union(bodies).repartition("conv").sortWithinPartitions("conv", *ORDER, "kind").select("conv.conv_id", "turn", "role", "kind", "text", "symbols", "pieces", "exits", "cost")
    id_type = ordered.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]

    def write(batches):
        now, done = None, []

        def flush(rows):
            columns = [pa.array([r[c] for r in rows], batch.schema.field("conv_id").type if c == "conv_id" else pa.int64() if c in COUNTS else pa.string()) for c in names]
            return pa.RecordBatch.from_arrays(columns, names=names)

        batch = None
        for batch in batches:
            for conv_id, at, who, kind, said, symbols, pieces, exits, cost in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv != conv_id:
                    if now is not None:
                        done.append(now.result())
                    now = Conversation(conv_id)
                if kind == 0:
                    now.block(symbols, pieces, exits, cost)
                else:
                    now.turn(at, who, said)
            if done:
                yield flush(done)
                done = []
        if now is not None:
            yield flush([now.result()])

    found = ordered.mapInArrow(write, f"conv_id {id_type}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")
    every = conversations.select(conversations[conv].alias("every")).distinct()
    joined = every.join(found, F.col("every").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(F.col("every").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
