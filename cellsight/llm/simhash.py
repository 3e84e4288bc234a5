"""Op 5: SimHash near-duplicates with anchor points of a covering code.

The 64 bits hold two blocks of 31 bits (bit 31 and bit 63 belong to none). Two
fingerprints at no more than three differing bits differ in at most one bit of
one of the blocks. Anchors of a block are the words of the perfect Hamming code
of length 31: its covering radius is 1, so every block value has one anchor
within distance 1, its home. A fingerprint is replicated to all anchors within
radius plus threshold, 1 + 1 = 2: one or sixteen in each block. If y is within one bit
of x, then y is within two of x's home, so they meet there. On each
anchor, those at home are compared with all that came. Only links that join two
parts of an anchor's group are passed on, so a group of any size emits fewer
links than it has members. Groups above a size are split by their home members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.llm.common import bound_batches, byte_view, map_arrow, settle, texts_of, window_hashes, word_hashes, word_spans
from cellsight.llm.components import components

#: Members of an anchor's group above which its home members are dealt out to several tasks.
HOT_GROUP = 4096
#: Groups up to this size are compared by shifts of the whole batch.
SMALL_GROUP = 12
#: Cells of one comparison tile.
TILE = 1 << 22
BLOCK_SHIFTS = (0, 32)
BLOCK_MASK = (1 << 31) - 1


def fingerprint(text: str, size: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles (A-Z lower-cased, repeats count; no words: zero)."""
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    n = len(words)
    if n <= size:
        return digest(line, seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(begins[: n - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long for every row. Null texts count as empty (zero); null ids stay null."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, size) for t in texts_of(batch.column(1))], np.uint64).astype(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    frame = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return map_arrow(frame, run, "doc_id long, fp long")


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ``(row, anchor key, at home)`` of unsigned fingerprints. The key is the code word with the block's number above it."""
    rows, keys, homes = [], [], []
    one = np.uint64(1)
    for block, shift in enumerate(BLOCK_SHIFTS):
        x = fps >> np.uint64(shift) & np.uint64(BLOCK_MASK)
        syndrome = np.zeros(len(x), np.uint64)
        for bit in range(31):
            syndrome ^= (x >> np.uint64(bit) & one) * np.uint64(bit + 1)
        flip = lambda place: np.where(place > 0, one << (np.maximum(place, one) - one), np.uint64(0))
        mark = np.uint64(block << 32)
        rows.append(np.arange(len(x)))
        keys.append(x ^ flip(syndrome) | mark)
        homes.append(np.ones(len(x), bool))
        for i in range(1, 32):
            place = np.uint64(i)
            other = place ^ syndrome
            pick = (syndrome > 0) & (other > place)  # each pair i, j with i xor j = syndrome once; a pair with j = 0 is the home
            rows.append(np.flatnonzero(pick))
            keys.append((x ^ flip(np.full(len(x), place)) ^ flip(other) | mark)[pick])
            homes.append(np.zeros(int(pick.sum()), bool))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def link_group(fps: np.ndarray, home: np.ndarray, bits: int = 3) -> list[tuple[int, int]]:
    """Links that join the parts of one group (home against all, in tiles), fewer than the group has members."""
    label = np.arange(len(fps))
    out = []
    at = np.flatnonzero(home)
    step = max(1, TILE // len(fps))
    for i in range(0, len(at), step):
        near = np.bitwise_count(fps[at[i : i + step], None] ^ fps[None, :]) <= bits
        for k, row in zip(at[i : i + step], near):
            found = label[row]
            if (found != found[0]).any():
                first = {}
                for m, lab in zip(np.flatnonzero(row).tolist(), found.tolist()):
                    first.setdefault(lab, m)
                mine = label[k]
                for lab, m in first.items():
                    if lab != mine:
                        out.append((int(k), m))
                label[np.isin(label, list(first))] = mine
    return out


def links_of_groups(key: np.ndarray, fps: np.ndarray, home: np.ndarray, bits: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Links of all groups of equal, adjacent keys: small groups by comparing rows at the same shift, others in tiles."""
    n = len(key)
    a, b = [], []
    if n < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(cut, n))
    small = np.repeat(size <= SMALL_GROUP, size)
    for d in range(1, SMALL_GROUP):
        i = np.flatnonzero((key[d:] == key[:-d]) & small[d:] & (home[d:] | home[:-d])) if d < n else np.zeros(0, np.int64)
        if not len(i) and d > 1:
            break
        hit = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= bits]
        a.append(fps[hit])
        b.append(fps[hit + d])
    for c, s in zip(cut[size > SMALL_GROUP].tolist(), size[size > SMALL_GROUP].tolist()):
        pairs = link_group(fps[c : c + s], home[c : c + s], bits)
        a.append(fps[[c + i for i, _ in pairs]] if pairs else fps[:0])
        b.append(fps[[c + j for _, j in pairs]] if pairs else fps[:0])
    return np.concatenate(a), np.concatenate(b)


def links(distinct: DataFrame, bits: int = 3, hot: int = HOT_GROUP) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) whose components are those of all pairs at ``bits`` or fewer bits."""
    spark = distinct.sparkSession
    bound_batches(spark)

    def spread(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().astype(np.uint64)
            row, key, home = anchors(fps)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(fps[row].astype(np.int64)), pa.array(home)], names=["key", "fp", "home"])

    def compare(batches):
        held: list[np.ndarray] = []

        def done(key, fps, home):
            x, y = links_of_groups(key, fps, home, bits)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)), pa.array(y.astype(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            # the key and the part are one number here: groups are only told apart
            key = batch.column(0).to_numpy() * np.int64(1_000_003) + batch.column(1).to_numpy()
            new = (key, batch.column(2).to_numpy().astype(np.uint64), batch.column(3).to_numpy(zero_copy_only=False))
            held = [np.concatenate(x) for x in zip(held, new)] if held else list(new)
            last = np.flatnonzero(held[0] != held[0][-1])
            whole = last[-1] + 1 if len(last) else 0
            if whole:
                yield from done(*(x[:whole] for x in held))
                held = [x[whole:] for x in held]
        if held:
            yield from done(*held)

    spread_out = distinct.select("fp").where("fp is not null").mapInArrow(spread, "key long, fp long, home boolean")
    n, at_home = F.count("*"), F.count_if("home")
    tiles = lambda x: F.ceil(F.greatest(x, F.lit(1)) / hot).cast("int")
    crowded = settle(spread_out.groupBy("key").agg(n.alias("n"), tiles(at_home).alias("rows"), tiles(n).alias("columns")).where(F.col("n") > hot).drop("n"), "crowded")
    if crowded.isEmpty():
        dealt = spread_out.withColumn("part", F.lit(0))
    else:
        joined = spread_out.join(crowded, "key", "left").withColumns({"rows": F.coalesce("rows", F.lit(1)), "columns": F.coalesce("columns", F.lit(1))})
        # tiles of home members by tiles of all: a home member is at home along its row of tiles and a visitor elsewhere in its column
        row, column = F.pmod(F.xxhash64("fp"), F.col("rows")).cast("int"), F.pmod(F.xxhash64("fp", F.lit(1)), F.col("columns")).cast("int")
        tile = lambda i, j, home: F.struct((i * F.col("columns") + j).alias("part"), F.lit(home).alias("home"))
        along = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda j: tile(row, j, True))).otherwise(F.array().cast("array<struct<part:int,home:boolean>>"))
        other = F.transform(F.filter(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: ~F.col("home") | (i != row)), lambda i: tile(i, column, False))
        dealt = joined.select("key", "fp", F.inline(F.concat(along, other)))
    grouped = dealt.select("key", "part", "fp", "home").repartition("key", "part").sortWithinPartitions("key", "part")
    return grouped.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3, bits: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Equal fingerprints are one class before anything is compared. A component's id is the least id of its rows; null
    ids count only if there is no other. Repeated rows fall into one class; an empty table gives no rows.
    """
    if bits > 3:
        raise ValueError("the anchors cover up to three differing bits")
    fps = settle(fingerprints(docs, size, id_column, text_column), "fingerprints")
    classes = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = settle(components(links(classes, bits)), "components")
    member = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    member = settle(member, "members")
    ids = settle(member.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    labels = settle(member.join(ids, "root").select("fp", "component_id"), "labels")
    return fps.join(labels, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = 3, bits: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the least of their component (all columns kept).

    Rows that repeat an id are the same document and stay or go together; rows without an id stay if one of them is in a
    component without ids.
    """
    kept = near_duplicates(docs, size, bits, id_column, text_column).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs[id_column].cast("long").eqNullSafe(F.col("__kept")), "left_semi")


# copies at a lower similarity -------------------------------------------------------

#: Sampled fingerprints of a document, and shingles in each.
SAMPLES, SAMPLE_SIZE = 16, 4
#: Documents at home in one comparison and their shingles at most; documents that pass by in one task.
HOME_DOCS, HOME_SHINGLES, PASSING = 256, 1 << 21, 512


def shingle_lists(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted hashes of the distinct shingles of every text; one of fewer words is one shingle, one without words has none."""
    raw, offsets = byte_view(column)
    raw = np.where((raw >= 65) & (raw <= 90), raw | 32, raw).astype(np.uint8)
    starts, ends, first = word_spans(raw, offsets)
    words = word_hashes(raw, starts, ends)
    hashes = window_hashes(words, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a < size:
            yield window_hashes(words[a:b], b - a) if b > a else words[:0]
        else:
            h = np.sort(hashes[a : b - size + 1])
            yield h[np.concatenate([[True], h[1:] != h[:-1]])]


def sample_keys(h: np.ndarray) -> np.ndarray:
    """Fingerprints of small samples of sorted shingle hashes: the four that come next, in a circle, after evenly spaced points.

    Of texts with fewer shingles than all samples together every shingle is such a point.
    """
    n = len(h)
    if n <= SAMPLES * SAMPLE_SIZE:
        at = np.arange(n)
    else:
        at = np.unique(np.searchsorted(h, np.arange(SAMPLES, dtype=np.uint64) << np.uint64(64 - SAMPLES.bit_length() + 1)) % n)
    k = min(SAMPLE_SIZE, n)
    run = window_hashes(np.concatenate([h, h[: k - 1]]), k)
    return np.unique(run[at]).astype(np.int64)


def samples(docs: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id, n_shingles, keys`` of ``doc_id, text``: fingerprints of small samples of the distinct shingles.

    At a similarity of 0.8 two documents have the same sample after a point with a chance of about 0.4, so after one of
    sixteen points almost surely. Rows without words or id drop out.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts, keys = [], [], []
        for d, h in zip(batch.column(0).to_pylist(), shingle_lists(batch.column(1), size)):
            if d is not None and len(h):
                ids.append(d)
                counts.append(len(h))
                keys.append(sample_keys(h))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "keys"])

    return map_arrow(docs, run, "doc_id long, n_shingles long, keys array<long>")


def shingle_sets(docs: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id, shingles`` of ``doc_id, text``: the sorted hashes of all distinct shingles."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [h.tobytes() for h in shingle_lists(batch.column(1), size)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "shingles"])

    return map_arrow(docs, run, "doc_id long, shingles binary")


def similarity_of(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two shingle sets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


class Homes:
    """The documents at home in one comparison, as postings of their shingles. Links are given only where they join two parts."""

    def __init__(self, similarity: float):
        self.similarity, self.ids, self.labels, self.sets, self.active = similarity, [], [], [], []

    def add(self, doc: int, label: int, shingle_set: bytes, compared: bool) -> None:
        if compared:
            self.active.append(len(self.ids))
        self.ids.append(doc)
        self.labels.append(label)
        self.sets.append(shingle_set)

    def close(self) -> list[tuple[int, int]]:
        """No more come home: links among them."""
        self.ids, self.labels = np.array(self.ids, np.int64), np.array(self.labels, np.int64)
        found = [np.frombuffer(x, np.uint64) for x in self.sets]
        self.sizes = np.array([len(x) for x in found], np.int64)
        every = np.concatenate(found) if found else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.owners = np.repeat(np.arange(len(found), dtype=np.int32), self.sizes)[order]
        self.hashes, begins = np.unique(every[order], return_index=True)
        self.begins = np.append(begins, len(every))
        return [e for k in self.active for e in self.meet(self.ids[k], self.labels[k], self.sets[k])]

    def near(self, shingle_set: bytes) -> np.ndarray:
        """Which of those at home have a Jaccard similarity to these shingles that reaches the limit."""
        x = np.frombuffer(shingle_set, np.uint64)
        at = np.minimum(np.searchsorted(self.hashes, x), len(self.hashes) - 1)
        at = at[self.hashes[at] == x]
        count = self.begins[at + 1] - self.begins[at]
        posting = np.repeat(self.begins[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        both = np.bincount(self.owners[posting], minlength=len(self.ids))
        return both / (self.sizes + len(x) - both) >= self.similarity

    def meet(self, doc: int, label: int, shingle_set: bytes) -> list[tuple[int, int]]:
        """Links of one document with parts of those at home that it does not belong to yet."""
        if not len(self.ids):
            return []
        hit = np.flatnonzero(self.near(shingle_set) & (self.labels != label))
        parts, first = np.unique(self.labels[hit], return_index=True)
        out = [(int(doc), int(self.ids[k])) for k in hit[first]]
        if out:
            self.labels[np.isin(self.labels, parts)] = label
        return out


def similar_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: links at ``similarity`` between members of a group, of which one at least is at home.

    ``members`` has ``g, doc_id, n_shingles, label, home``. Every document at home meets every member once, whatever the group's
    size: those at home are dealt out in one direction, all members in the other, and a task holds what is at home in
    its cell while the others pass by. Documents of equal labels are known to be connected.
    """
    bound_batches(members.sparkSession)
    n_home = F.sum(F.col("home").cast("long"))
    words = F.sum(F.when(F.col("home"), F.col("n_shingles")).otherwise(F.lit(0).cast("long")))
    load = members.groupBy("g").agg(F.ceil(F.greatest(n_home / HOME_DOCS, words / HOME_SHINGLES)).cast("int").alias("across"), F.ceil(F.count("*") / PASSING).cast("int").alias("down")).where("across > 0")
    load = settle(load, "loads")
    own_x, own_y = F.pmod(F.xxhash64("doc_id"), F.col("across")).cast("int"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("down")).cast("int")
    cell = lambda x, y, role: F.struct(x.alias("x"), y.alias("y"), role.cast("int").alias("role"))
    # 2: at home and compared, 1: at home only, 0: passing
    passing = F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda x: cell(x, own_y, F.when(F.col("home") & (x == own_x), 2).otherwise(0)))
    staying = F.transform(F.filter(F.sequence(F.lit(0), F.col("down") - 1), lambda y: F.col("home") & (y != own_y)), lambda y: cell(own_x, y, F.lit(1)))
    rows = members.join(load, "g").select("g", "doc_id", "label", F.explode(F.concat(passing, staying)).alias("c")).select("g", "c.*", "doc_id", "label")
    rows = rows.join(sets, "doc_id").select("g", "x", "y", "role", "doc_id", "label", "shingles")

    def compare(batches):
        key = homes = None
        open_ = False
        for batch in batches:
            out = []
            for g, x, y, role, doc, label, found in zip(*(c.to_pylist() for c in batch.columns)):
                if (g, x, y) != key:
                    if open_:
                        out += homes.close()
                    key, homes, open_ = (g, x, y), Homes(similarity), True
                if role:
                    homes.add(doc, label, found, role == 2)
                    continue
                if open_:
                    out += homes.close()
                    open_ = False
                out += homes.meet(doc, label, found)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
        if open_:
            out = homes.close()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    dealt = rows.repartition("g", "x", "y").sortWithinPartitions("g", "x", "y", F.desc("role"))
    return dealt.mapInArrow(compare, "a long, b long")


def keep_dissimilar(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) without those similar to one that stays: one document of each component of links.

    Documents that share a sample's fingerprint form a group; groups of the same members are one. Every member is compared once
    with each hub of its groups, the one that is in the most and largest groups. In a group of three or more, those still apart
    from its largest part are then compared with all its members, so every pair of a group is either compared or known to be
    connected. The shingle sets of the whole texts decide. Rows without an id or without words stay; rows that share an id stay or go together.
    """
    frame = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    made = settle(samples(frame, size), "samples")
    rows = made.select("doc_id", "n_shingles", F.explode("keys").alias("key"))
    ends = rows.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("all")).where("low < high")
    ends = settle(ends.select("key", F.xxhash64("low", "high", "n", "all").alias("g")), "groups")
    members = settle(rows.join(ends, "key").groupBy("g", "doc_id").agg(F.max("n_shingles").alias("n_shingles")), "members")
    found = shingle_sets(frame.join(members.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text"), size)
    sets = settle(found.groupBy("doc_id").agg(F.min("shingles").alias("shingles")), "sets")  # rows that repeat an id

    sizes = members.groupBy("g").agg(F.count("*").alias("n"))
    score = members.join(sizes, "g").groupBy("doc_id").agg(F.sum("n").alias("score"))
    hubs = settle(members.join(score, "doc_id").groupBy("g").agg(F.max_by("doc_id", F.struct("score", "doc_id")).alias("hub"), F.count("*").alias("n")), "hubs")
    spokes = members.join(hubs, "g").groupBy(F.col("hub").alias("g"), "doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    spokes = spokes.select("g", "doc_id", "n_shingles", F.col("doc_id").alias("label"), (F.col("doc_id") == F.col("g")).alias("home"))
    edges = settle(similar_links(settle(spokes, "spokes"), sets, similarity), "links")
    known = settle(components(edges), "known")
    several = members.join(hubs.where("n > 2").select("g"), "g")
    labelled = settle(several.join(known, F.col("doc_id") == F.col("node"), "left").select("g", "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("label")), "labelled")
    largest = labelled.groupBy("g", "label").agg(F.count("*").alias("n")).groupBy("g").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    apart = labelled.join(largest, "g").select("g", "doc_id", "n_shingles", "label", (F.col("label") != F.col("main")).alias("home"))
    more = settle(similar_links(settle(apart, "apart"), sets, similarity), "links")
    gone = settle(components(edges.union(more)).where("node <> root").select(F.col("node").alias("__gone")).distinct(), "gone")
    return docs.join(gone, docs[id_column].cast("long") == F.col("__gone"), "left_anti")
