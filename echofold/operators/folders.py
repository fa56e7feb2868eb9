"""Folder roll-ups and fingerprints.

A folder stands for the multiset of the contents of all files beneath it, whatever their names and
nesting. Its fingerprint is the root of a tree over the hash space, the same tree for a folder of one
file and for the root of a whole store:

- a leaf is SHA-256 over ``hash:copies,`` of the folder's contents whose hashes begin with the same
  four hex digits, in hash order;
- an inner node is SHA-256 over the leaves (in hex) that share their first two digits, in order;
- the root is SHA-256 over the bytes of the inner nodes, in order, and the number of files as a
  little-endian 64-bit integer.

Equal multisets get equal fingerprints and different ones different fingerprints. A folder holding any
file without a hash has none.

Files are first reduced to their own folder (one row per distinct content), and only those reduced
rows are copied to the ancestors, so the fan-out is folders x depth rather than files x depth. They are
copied after they have been dealt by leaf, so the copies are not shuffled. Copies of a content are summed
before anything is collected, so a leaf holds a common content once. A leaf holds one 65,536th of a
folder's contents, an inner node and the root at most 256 digests.
"""

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold import schemas as S
from echofold.functions import paths, text
from echofold.operators.among import maybe_among
from echofold.staging import stage

# Leading hex digits of a hash that name its leaf and its inner node.
LEAF_DIGITS = 4
NODE_DIGITS = 2
# Copies of a content that are written out at once.
_CHAIN_COPIES = 1 << 15

# The columns of a content summary, each the sum of one piece of all hashes.
LANES = ["lane_0", "lane_1", "lane_2", "lane_3"]

_FOLDER = ["scan_run_id", "folder"]
_FOLDER_KEY = ["scan_run_id", "full_path"]


def _with_folder(files: DataFrame) -> DataFrame:
    return files.withColumn("folder", paths.folder_of("full_path"))


def _lane(number: int) -> Column:
    """Some digits of a content hash as a number of 24 bits: sums of 2^39 of them fit a bigint."""
    return F.conv(F.substring("content_hash", 1 + 6 * number, 6), 16, 10).cast("bigint")


def folder_rollup(files: DataFrame, summarize: bool = False) -> DataFrame:
    """Per run and folder: files beneath it, how many are hashed, total size, newest and oldest date.

    ``own_files`` counts the files directly inside. ``summarize`` adds the content summary: sums of pieces
    of the content hashes (``LANES``). Sums of a folder's parts add up to its own, so a summary is made
    from one row per folder, whatever the number of contents.
    """
    lanes = LANES if summarize else []
    own = (
        _with_folder(files)
        .groupBy(*_FOLDER)
        .agg(
            F.count(F.lit(1)).alias("own_files"),
            F.count("content_hash").alias("own_hashed"),
            F.sum("size_bytes").alias("own_size"),
            F.max("date_modified_utc").alias("own_modified"),
            F.min("date_created_utc").alias("own_created"),
            *[F.sum(_lane(i)).alias(f"own_{lane}") for i, lane in enumerate(lanes)],
        )
    )
    return (
        paths.with_ancestors(own, "folder", "ancestor")
        .groupBy("scan_run_id", F.col("ancestor").alias("full_path"))
        .agg(
            F.sum("own_files").alias("file_count"),
            F.sum("own_hashed").alias("hashed_count"),
            F.sum("own_size").alias("size_bytes"),
            F.max("own_modified").alias("date_modified_utc"),
            F.min("own_created").alias("date_created_utc"),
            F.sum(F.when(F.col("folder") == F.col("ancestor"), F.col("own_files")).otherwise(0))
            .alias("own_files"),
            *[F.sum(f"own_{lane}").alias(lane) for lane in lanes],
        )
    )


def _sha256_hex(hex_text: Column) -> Column:
    return F.sha2(F.unhex(hex_text), 256)


def _ordered_text(item: str, order: str, name: str) -> Column:
    return F.expr(f"listagg({item}, '') within group (order by {order}) as {name}")


def _packed() -> Column:
    return text.packed_hash(F.rtrim("content_hash"))


def _counted(files: DataFrame) -> DataFrame:
    """Copies of each content directly inside each folder: scan_run_id, folder, packed, copies.

    Files without a hash are counted as a null content.
    """
    return _with_folder(files).groupBy(*_FOLDER, _packed().alias("packed")).agg(F.count(F.lit(1)).alias("copies"))


def _to_ancestors(counted: DataFrame) -> DataFrame:
    """The rows of ``_counted`` once for every folder that contains them, as ``full_path``."""
    return paths.with_ancestors(counted, "folder", "full_path").drop("folder")


def _leaves(files: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The leaves of the hashed contents of folders: scan_run_id, full_path, node, leaf, files, digest.

    Contents are dealt by leaf, one row for each folder that holds them directly, and copied to the
    ancestors where they lie, so no copy is moved. With ``wanted``, where most copies are not needed, they
    are made and cut down before; others than the wanted folders may be left in.
    """
    hashed = files.filter("content_hash is not null")
    if wanted is None:
        counted = _counted(hashed)
    else:
        rows = _to_ancestors(_with_folder(hashed).select(*_FOLDER, _packed().alias("packed")))
        by_content = maybe_among(rows, _FOLDER_KEY, wanted, _FOLDER_KEY).groupBy("scan_run_id", "full_path", "packed")
        counted = by_content.agg(F.count(F.lit(1)).alias("copies"))
    leaf = F.substring(text.unpacked_hash(F.col("packed")), 1, LEAF_DIGITS)
    dealt = counted.withColumn("leaf", leaf).repartition("leaf")
    copied = _to_ancestors(dealt) if wanted is None else dealt
    contents = copied.groupBy("scan_run_id", "full_path", "leaf", "packed").agg(F.sum("copies").alias("copies"))
    return (
        contents.withColumn("content_hash", text.unpacked_hash(F.col("packed")))
        .groupBy("scan_run_id", "full_path", "leaf")
        .agg(
            _ordered_text("concat(content_hash, ':', copies, ',')", "content_hash", "counted"),
            F.sum("copies").alias("files"),
        )
        .select(
            "scan_run_id", "full_path", F.substring("leaf", 1, NODE_DIGITS).alias("node"), "leaf", "files",
            F.sha2("counted", 256).alias("digest"),
        )
    )


def _complete(wanted: DataFrame) -> DataFrame:
    return wanted.filter("file_count = hashed_count").select("scan_run_id", "full_path")


def leaf_digests(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The leaves of the fully hashed folders among the ``wanted`` ones of a roll-up."""
    return _leaves(files).join(_complete(wanted), ["scan_run_id", "full_path"], "left_semi")


def _roots(files: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The root over the hashed contents of folders: scan_run_id, full_path, content_hash.

    All leaves of a folder go to one task, 65,536 at most, where nodes and root are made.
    """
    dealt = (
        _leaves(files, wanted)
        .select("scan_run_id", "full_path", "node", "leaf", "files", F.unhex("digest").alias("digest"))
        .repartition("scan_run_id", "full_path")
    )
    nodes = dealt.groupBy("scan_run_id", "full_path", "node").agg(
        _ordered_text("lower(hex(digest))", "leaf", "leaves"), F.sum("files").alias("files")
    )
    nodes = nodes.withColumn("digest", F.sha2("leaves", 256))
    joined = nodes.groupBy("scan_run_id", "full_path").agg(
        _ordered_text("digest", "node", "hashes"), F.sum("files").alias("files")
    )
    ending = text.int64_le_hex(F.col("files"))
    return joined.select("scan_run_id", "full_path", _sha256_hex(F.concat("hashes", ending)).alias("content_hash"))


def fingerprints(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The fingerprint of every fully hashed folder among the ``wanted`` ones of a staged roll-up."""
    complete = _complete(wanted)
    return _roots(files, complete).join(complete, ["scan_run_id", "full_path"], "left_semi")


def _chain_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest each folder's hashes in the order they come in; the folder at hand goes on in the next batch.

    A null content comes first: its folder has no chain.
    """
    names = ["scan_run_id", "full_path", "chain_hash"]
    folder = digest = None
    count = 0
    for batch in batches:
        done = []
        columns = (batch.column(c).to_pylist() for c in ("scan_run_id", "full_path", "content_hash", "copies"))
        for run, path, content, copies in zip(*columns, strict=True):
            if (run, path) != folder:
                if digest is not None:
                    digest.update(count.to_bytes(8, "little"))
                    done.append((*folder, digest.hexdigest()))
                folder, digest, count = (run, path), hashlib.sha256(), 0
            if content is None:
                digest = None
            if digest is None:
                continue
            count += copies
            raw = bytes.fromhex(content)
            while copies > 0:
                # A common content is fed in pieces, not written out whole.
                digest.update(raw * min(copies, _CHAIN_COPIES))
                copies -= _CHAIN_COPIES
        yield pa.record_batch([pa.array([row[i] for row in done], pa.string()) for i in range(3)], names=names)
    if digest is not None:
        digest.update(count.to_bytes(8, "little"))
        yield pa.record_batch([pa.array([v], pa.string()) for v in (*folder, digest.hexdigest())], names=names)


def chain_hashes(files: DataFrame) -> DataFrame:
    """Every fully hashed folder with its plain chain: SHA-256 over all its hashes, sorted, and their number.

    For exchange with tools that use this value: scan_run_id, full_path, chain_hash. The hashes count as
    32 bytes each, a content as often as it has copies, and the number of files as a little-endian 64-bit
    integer. A chain has one end, so a folder is digested by one task; it sees the contents of each folder
    beneath in order and holds a batch of them. The tree above is what splits.
    """
    copied = _to_ancestors(_counted(files.filter("scan_run_id is not null")))
    dealt = copied.repartition("scan_run_id", "full_path").sortWithinPartitions("scan_run_id", "full_path", "packed")
    ordered = dealt.select("scan_run_id", "full_path", text.unpacked_hash(F.col("packed")).alias("content_hash"), "copies")
    return ordered.mapInArrow(_chain_batches, "scan_run_id string, full_path string, chain_hash string")


def with_repeated_summary(rollup: DataFrame) -> DataFrame:
    """Fully hashed folders that share summary, number of files and size with another folder of any run.

    Folders of equal content are among them. Different contents can be too, if ever so rarely, so their
    fingerprints decide. Returns scan_run_id, full_path, file_count, hashed_count.
    """
    summary = F.xxhash64("file_count", "size_bytes", *LANES)
    complete = rollup.filter("file_count = hashed_count").withColumn("summary", summary)
    repeated = complete.groupBy("summary").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    found = complete.join(repeated, "summary", "left_semi")
    return found.select("scan_run_id", "full_path", "file_count", "hashed_count")


def folder_rows(files: DataFrame, repeated_only: bool = False) -> DataFrame:
    """One row per run and folder, in the shape of an entry; the fingerprint is the content hash.

    ``repeated_only`` works out fingerprints only where another folder may have the same content, which
    is all that looking for duplicate folders needs: the others get none.
    """
    rollup = folder_rollup(files, repeated_only)
    if repeated_only:
        rollup = stage(rollup, "rollup")
        found = fingerprints(files, stage(with_repeated_summary(rollup), "repeated-folders"))
    else:
        found = _roots(files)
    content_hash = F.when(F.col("file_count") == F.col("hashed_count"), F.col("content_hash"))
    return rollup.join(found, ["scan_run_id", "full_path"], "left").select(
        "scan_run_id",
        F.lit(S.FOLDER).alias("entry_type"),
        paths.leaf_name("full_path").alias("file_name"),
        "full_path",
        "size_bytes",
        "date_modified_utc",
        "date_created_utc",
        content_hash.alias("content_hash"),
        F.lit(None).cast("string").alias("scan_error"),
    )
