"""Helpers that read the session: tables, widths, the shared folder for cut lineage; and joins that hot keys can't hold up."""

from __future__ import annotations

import tempfile
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text whose distinct elements one fragment of a global order gets, on average.
FRAGMENT_BYTES = 32 << 20


def fragment_count(documents: DataFrame) -> int:
    """Fragments of a global order over the documents' elements: as many as keep a fragment's part of the corpus to FRAGMENT_BYTES, and one for each shuffle partition at least."""
    size = documents.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    return max(width(documents.sparkSession), -(-size // FRAGMENT_BYTES))


def settled(documents: DataFrame) -> DataFrame:
    """doc_id, text in an order within partitions that a repeated task finds again, also after a shuffle."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).sortWithinPartitions("doc_id", "text")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.  Only a local session without one, as in tests, gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif context.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="tidemark-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared file system that this library wrote."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(frame: DataFrame) -> DataFrame:
    """The frame, written to the shared folder: later reads don't depend on executors that may be lost."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def fold(doc_id, parts: int = 5):
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def fit_sample(rows: DataFrame, label: str, most: int, longest: int, texts: DataFrame | None = None) -> pa.Table:
    """A bounded sample of labelled rows on the driver: (text, label) of about ``most`` rows, evenly from the labels, as chosen by a hash of doc_id; in an order of its own.

    rows have doc_id, the label and text, unless ``texts`` has those: then the sampled
    ids, ``most`` at most, are broadcast to it.  Bounds: ``most`` rows, so ``most`` labels,
    the most frequent ones; and none with over ``longest`` characters (a warning says if
    that leaves nothing)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), label).limit(most)
    labels = counts.count()
    rates = counts.select(label, F.least(F.lit(1.0), F.lit(0.9 * most / max(1, labels)) / F.col("_n")).alias("_rate"))
    draw = (F.xxhash64(F.col("doc_id")).bitwiseAND(0xFFFFFFF)) / float(1 << 28)
    chosen = rows.join(F.broadcast(rates), label).filter(draw < F.col("_rate"))
    if texts is not None:
        chosen = texts.join(F.broadcast(chosen.select("doc_id", label).limit(most)), "doc_id")
    sample = chosen.filter(F.length("text") <= longest).select("text", label).limit(most).toArrow()
    if labels and not sample.num_rows:
        warnings.warn(f"no labelled text in the sample has at most {longest} characters: nothing is learned", stacklevel=2)
    return sample.sort_by([("text", "ascending"), (label, "ascending")])


def text_digest(text):
    """MD5 of a text, null as empty: 16 bytes."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


#: Rows and bytes of groups that may be broadcast, and rows of a group from which it counts as hot.
BROADCAST_ROWS, BROADCAST_BYTES, HOT_ROWS = 500_000, 64 << 20, 1_000_000
SALTS = 1024


def join_back(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: str | tuple[str, ...] = "doc_id") -> DataFrame:
    """rows left join groups, a cut frame of one row for each key, on ``key``; ``size`` is the number of rows of a group.

    Up to BROADCAST_ROWS groups of BROADCAST_BYTES together are broadcast, so rows don't
    move.  Of more, those of over
    HOT_ROWS rows are: their number is bounded by all rows over HOT_ROWS.  Rows of hot
    groups are then dealt to SALTS tasks, and no other group has more than HOT_ROWS."""
    spelled = F.octet_length(F.to_json(F.struct(*groups.columns)))
    held = groups.agg(F.count("*").alias("rows"), F.sum(spelled).alias("bytes")).first()
    if held["rows"] <= BROADCAST_ROWS and (held["bytes"] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(groups), key, "left")
    own = [c for c in groups.columns if c != key]
    hot = groups.filter(F.col(size) > HOT_ROWS).select(key, F.struct(*own).alias("_hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    marked = marked.withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*([spread] if isinstance(spread, str) else spread)), F.lit(SALTS))).cast("int"))
    rest = groups.select(key, F.lit(0).alias("_salt"), F.struct(*own).alias("_own"))
    found = F.coalesce("_hot", "_own")
    return marked.join(rest, [key, "_salt"], "left").select(*rows.columns, *(found[c].alias(c) for c in own))


def keep_chosen(documents: DataFrame, digest, choice: DataFrame) -> DataFrame:
    """documents less the rows that ``choice`` drops, with all their columns, whatever their names.

    choice has a row for each digest of a text that isn't alone: ``digest``; ``stays``,
    whether a row with this text stays; ``keep_id``, the doc_id that stays (null: the row
    without one); ``rows`` with this text; ``ties``, rows with this text and the id that
    stays, of which one does.  Texts move only if there are too many digests to broadcast."""
    choice = cut(choice)
    marked = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"))
    placed = join_back(marked, choice, "digest", "rows")
    kept = placed.filter(F.col("rows").isNull() | (F.col("stays") & F.col("doc_id").eqNullSafe(F.col("keep_id"))))
    if choice.filter("stays AND ties > 1").isEmpty():
        return kept.select("row.*")
    repeated = kept.filter("ties > 1").dropDuplicates(["digest"]).select("row.*")
    return kept.filter("ties IS NULL OR ties = 1").select("row.*").union(repeated)


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of an undirected graph of links (a, b), by alternating large and small stars.

    Each round joins links with the smallest neighbour of their node; rounds are as many
    as the logarithm of the longest path, about.  The links between rounds are cut from
    their lineage."""
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = cut(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
