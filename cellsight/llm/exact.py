"""Op 11: exact deduplication by an extendible-hash index in shared files, in DataFrame functions only.

Keys are 64-bit hashes of normalised texts. The directory has an entry for each prefix of its global depth and names
the bucket, itself a shorter prefix, that holds the keys. It starts with one bucket and doubles while one is overfull:
the overfull buckets split by their next bit, the others keep their depth. Prefixes are key ranges, so each bucket is a
range that one task owns: it gets the whole texts of its keys, chains texts that share a key and compares their
bytes. Pages of the index hold a row for each different text: bucket, key, place in the chain, digest, the row
that stays and the number of copies. Load is counted in keys, as splitting can't part copies.

A text with very many copies has the owner's work shared: its rows are dealt over a number of tasks that group them
first, and their few results meet once more. At most ``1 / HOT_SHARE`` keys can have that many copies, whatever the
table's size, and a directory has at most ``2 ** MAX_DEPTH`` entries, so both may be broadcast. A bucket that is still
overfull at the last depth simply holds more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellsight.llm.common import settle

#: Keys of a bucket that is not overfull, and bits of the deepest directory.
BUCKET_KEYS, MAX_DEPTH = 512, 16
#: A key is hot if it has more copies than HOT_COPIES and than this share of all rows; its rows go to so many tasks.
HOT_COPIES, HOT_SHARE, HOT_TASKS = 100, 1e-4, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """``text`` with A to Z in lower case and nothing else changed; a null is empty. ASCII texts take the quick way to the same."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def cell(key: Column) -> Column:
    """The first ``MAX_DEPTH`` bits of a key: 0 to 65,535."""
    return F.shiftrightunsigned(key, 64 - MAX_DEPTH)


def directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``entry, bucket, depth``: the directory for the distinct keys in column ``key``.

    An entry is a key's first ``MAX_DEPTH`` bits; those that share a bucket name the same one, and those without keys are left
    out. Doubling by doubling, each bucket over ``bucket_keys`` keys splits in two. All doublings are worked out together, on
    counts of at most 65,536 cells.
    """
    loads = settle(keys.groupBy(cell(F.col("key")).alias("entry")).agg(F.count("*").alias("load")), "loads")
    # the loads of all buckets that a doubling could make: one row for each prefix of each depth
    depths = F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth")
    at = F.expr(f"shiftright(entry, cast({MAX_DEPTH} - depth as int))")
    buckets = loads.select("entry", "load", depths).withColumn("bucket", at).groupBy("depth", "bucket").agg(F.sum("load").alias("load"))
    # a bucket is split while it is overfull, so an entry's bucket is the first on its way that is not
    fits = buckets.where((F.col("load") <= bucket_keys) | (F.col("depth") == max_depth)).select("depth", "bucket")
    way = loads.select("entry", depths).withColumn("bucket", at)
    found = way.join(fits, ["depth", "bucket"]).groupBy("entry").agg(F.min(F.struct("depth", "bucket")).alias("b"))
    return settle(found.select("entry", "b.bucket", "b.depth"), "directory")


class Index:
    """The index of one table in shared files: ``directory`` (entry, bucket, depth) and ``pages`` (a row for each different text)."""

    def __init__(self, directory: DataFrame, pages: DataFrame):
        self.directory, self.pages = directory, pages

    def depth(self) -> int:
        """The global depth: that of the deepest bucket."""
        return self.directory.agg(F.max("depth")).first()[0] or 0


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", hashed: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """``id, key, sha, row`` of every row, settled; ``row`` tells rows apart."""
    norm = docs.select(docs[key].alias("id"), normalised(docs[text]).alias("norm"))
    return settle(norm.select("id", hashed("norm").alias("key"), F.unhex(F.sha2("norm", 256)).alias("sha"), F.monotonically_increasing_id().alias("row")), "digests")


def build(docs: DataFrame, entries: DataFrame, key: str = "doc_id", text: str = "text", bucket_keys: int = BUCKET_KEYS, hot_copies: int = HOT_COPIES, hashed: Callable[[str], Column] = F.xxhash64) -> Index:
    """The index over ``docs``, whose digests are ``entries``; ``hashed`` makes the 64-bit keys."""
    copies = settle(entries.groupBy("key").agg(F.count("*").alias("n")), "keys")
    table = directory(copies.select("key"), bucket_keys)
    total = copies.agg(F.sum("n")).first()[0] or 0
    hot = copies.where(F.col("n") > max(hot_copies, total * HOT_SHARE)).select("key", F.lit(True).alias("hot"))

    rows = docs.select(docs[key].alias("id"), normalised(docs[text]).alias("norm")).withColumn("key", hashed("norm")).withColumn("entry", cell(F.col("key")))
    # bounds: a directory has 65,536 entries, hot keys are fewer than 1 / HOT_SHARE
    owned = rows.join(F.broadcast(table.select("entry", "bucket", "depth")), "entry").join(F.broadcast(hot), "key", "left")
    lane = F.when(F.col("hot"), 1 + F.pmod(F.xxhash64("id", F.spark_partition_id()), F.lit(HOT_TASKS))).otherwise(0)
    dealt = owned.select("id", "norm", "key", "depth", "bucket", lane.alias("lane")).repartition("depth", "bucket", "lane")
    # the owner groups by the text itself: texts of one key are chained, and their bytes decide
    chains = dealt.groupBy("depth", "bucket", "lane", "key", "norm").agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
    parts = chains.select("depth", "bucket", "key", F.unhex(F.sha2("norm", 256)).alias("sha"), F.when(F.col("lane") > 0, F.col("norm")).alias("text"), "keep_id", "n")
    whole = parts.repartition("depth", "bucket").groupBy("depth", "bucket", "key", "sha").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.min("text").alias("least"), F.max("text").alias("most"), F.count("*").alias("pieces"), F.count("text").alias("shared"))
    one_text = (F.col("pieces") == 1) | ((F.col("pieces") == F.col("shared")) & (F.col("least") == F.col("most")))
    place = F.row_number().over(W.partitionBy("depth", "bucket", "key").orderBy("sha")) - 1
    pages = whole.select("depth", "bucket", "key", place.alias("chain"), "sha", "keep_id", "group_size", F.when(one_text, True).otherwise(F.raise_error(F.lit("two texts share key and digest")).cast("boolean")).alias("compared"))
    return Index(table, settle(pages, "pages"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", hashed: Callable[[str], Column] = F.xxhash64, **limits) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs``, dropped ones too.

    Texts are equal when identical after lower-casing A to Z; null is empty. The row with the largest id stays, and of rows that
    share that id one. Null ids are smaller than all others; a group of nothing else keeps one row and has a null
    ``keep_id``. No rows give no rows; other columns are not read.
    """
    entries = digests(docs, key, text, hashed)
    index = build(docs, entries, key, text, hashed=hashed, **limits)
    last = entries.groupBy("key", "sha").agg(F.max(F.struct(F.col("id").isNotNull(), "id", "row")).alias("last"))
    # settled, so that nothing but the join reads the shuffled rows and a hot key can be split
    groups = settle(index.pages.where("compared").join(last, ["key", "sha"]).select("key", "sha", "keep_id", "group_size", F.col("last.row").alias("stays")), "groups")
    found = entries.join(groups, ["key", "sha"])
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("stays")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


DEDUPLICATE_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)
"""
