"""Duplicate folder sets, reduced to the top-most redundant trees.

Two prunings apply. A folder is dropped when its parent has the same content (it is the parent's only
content). A whole set is dropped when one other set covers it: every copy lies beneath some copy of
that set, so removing the larger trees already reclaims it.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.functions import paths, text
from echofold.operators.among import mark_among, maybe_among
from echofold.operators.duplicates import duplicate_sets
from echofold.schemas import CONTENT_KEY
from echofold.staging import stage


def candidates(folders: DataFrame) -> DataFrame:
    """Folders whose content occurs at least twice; only these can join or prune a set."""
    rows = folders.filter("content_hash is not null").select("full_path", "file_name", *CONTENT_KEY)
    repeated = (
        rows.groupBy(*CONTENT_KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    )
    return rows.join(repeated, CONTENT_KEY, "left_semi")


def independent(found: DataFrame) -> DataFrame:
    """Candidates whose parent is not a candidate with the same content.

    Comparing with the parent alone is enough: sizes and counts only grow towards the root, so an
    equal ancestor forces every folder in between to be equal as well.
    """
    children = found.withColumn("parent", paths.parent_path("full_path"))
    # Most parents are no candidates, and most candidates no parents: those stay where they are.
    marked = mark_among(children, ["parent"], found, ["full_path"])
    parents = maybe_among(found, ["full_path"], children, ["parent"])
    parents = parents.select(F.col("full_path").alias("parent"), *CONTENT_KEY)
    compared = marked.filter("_among").join(parents, ["parent", *CONTENT_KEY], "left_anti")
    return compared.select(*found.columns).unionByName(marked.filter("not _among").select(*found.columns))


def set_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*CONTENT_KEY).agg(F.count(F.lit(1)).alias("copy_count")).filter("copy_count > 1")


def members(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Independent folders that belong to a set of two or more."""
    return rows.join(sizes.select(*CONTENT_KEY), CONTENT_KEY, "left_semi")


def member_ancestors(of_sets: DataFrame) -> DataFrame:
    """Each set paired with the ancestors of its copies.

    Copies side by side in one folder share all their ancestors, so they are counted first
    (``siblings``) and climb together. A path is counted once per set.
    """
    siblings = (
        of_sets.select(*CONTENT_KEY, "full_path").distinct()
        .groupBy(*CONTENT_KEY, paths.folder_of("full_path").alias("parent"))
        .agg(F.count(F.lit(1)).alias("siblings"))
    )
    return paths.with_ancestors(siblings, "parent", "ancestor")


def cover(of_sets: DataFrame) -> DataFrame:
    """Pairs (set, covering set) with the number of the set's copies beneath the covering one."""
    tops = of_sets.select(
        F.col("full_path").alias("ancestor"),
        F.col("content_hash").alias("cover_hash"),
        F.col("size_bytes").alias("cover_size"),
    )
    pair = [*CONTENT_KEY, "cover_hash", "cover_size"]
    above = member_ancestors(of_sets)
    # Most ancestors are in no set, and most folders of sets hold no other: neither is moved for the join.
    of_tops = maybe_among(tops, ["ancestor"], above, ["ancestor"])
    return (
        maybe_among(above, ["ancestor"], of_sets, ["full_path"])
        .join(of_tops.distinct(), "ancestor")
        .select(*pair, "parent", "siblings")
        .distinct()
        .groupBy(*pair)
        .agg(F.sum("siblings").alias("covered_members"))
    )


def redundant_sets(of_sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """Sets all of whose copies lie beneath one other set."""
    return (
        cover(of_sets)
        .join(sizes, CONTENT_KEY)
        .filter("covered_members = copy_count")
        .select(*CONTENT_KEY)
        .distinct()
    )


@dataclass(frozen=True)
class FolderSets:
    """The pruned folders: every independent copy, and those left in sets worth reporting."""

    independent: DataFrame
    kept: DataFrame

    def sets(self, min_wasted: int = 0) -> DataFrame:
        return duplicate_sets(self.kept, min_wasted)


def prune_folders(folders: DataFrame) -> FolderSets:
    """Run both prunings. The reduced tables that several steps read are staged.

    Hashes are only compared on the way, so they go packed.
    """
    packed = folders.withColumn("content_hash", text.packed_hash(F.col("content_hash")))
    top_most = stage(independent(stage(candidates(packed), "candidates")), "independent")
    sizes = set_sizes(top_most)
    of_sets = stage(members(top_most, sizes), "set-members")
    kept = of_sets.join(redundant_sets(of_sets, set_sizes(of_sets)), CONTENT_KEY, "left_anti")
    unpacked = text.unpacked_hash(F.col("content_hash"))
    return FolderSets(
        independent=top_most.withColumn("content_hash", unpacked), kept=kept.withColumn("content_hash", unpacked)
    )
