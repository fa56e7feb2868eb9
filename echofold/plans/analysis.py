"""Finding duplicates over the newest completed run of each drive."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold import schemas as S
from echofold.operators import duplicates as D
from echofold.operators import runs as R
from echofold.operators.prune import FolderSets, prune_folders
from echofold.staging import stage


class NoCompletedRun(ValueError):
    """There is no completed run to work on."""


@dataclass(frozen=True)
class DuplicateAnalysis:
    """Duplicate file and folder sets with the copies of each, and the runs they come from.

    ``total`` sums the waste of all file sets, listed or not. Folder waste overlaps it.
    """

    scans: DataFrame
    total: DataFrame
    file_sets: DataFrame
    folder_sets: DataFrame
    file_locations: DataFrame
    folder_locations: DataFrame


@dataclass(frozen=True)
class CurrentContent:
    """The hashed files and folders of the selected runs."""

    runs: DataFrame
    files: DataFrame
    folders: DataFrame

    def pruned_folders(self) -> FolderSets:
        return prune_folders(self.folders)


def select_content(
    entries: DataFrame, scans: DataFrame, drives: list[str] | None = None, require_hash: bool = False
) -> CurrentContent:
    wanted = R.canonical_drives(scans, drives) if drives else None
    runs = stage(R.latest_runs(scans, wanted, require_hash), "runs")
    return CurrentContent(
        runs=runs.orderBy("drive"),
        files=R.hashed(R.current_entries(entries, runs, S.FILE)),
        folders=R.hashed(R.current_entries(entries, runs, S.FOLDER)),
    )


def top_duplicates(
    entries: DataFrame, scans: DataFrame, n: int = 10, k: int = 5, drives: list[str] | None = None,
    require_hash: bool = False,
) -> DuplicateAnalysis:
    """The ``n`` most wasteful file and folder sets with up to ``k`` copies of each."""
    content = select_content(entries, scans, drives, require_hash)
    if content.runs.isEmpty():
        scope = f" for {', '.join(drives)}" if drives else ""
        raise NoCompletedRun(f"no completed run found{scope}; finish a run before analyzing")
    pruned = content.pruned_folders()
    # The entries are grouped once; the total and the top sets both come from the stored sets.
    all_sets = stage(D.duplicate_sets(content.files), "all-file-sets")
    file_sets = stage(D.top_sets(all_sets, n), "file-sets")
    folder_sets = stage(D.top_sets(pruned.sets(), n), "folder-sets")
    return DuplicateAnalysis(
        scans=content.runs,
        total=D.total_of_sets(all_sets),
        file_sets=file_sets,
        folder_sets=folder_sets,
        file_locations=D.sample_locations(D.of_chosen(content.files, file_sets), file_sets, k),
        folder_locations=D.sample_locations(pruned.independent, folder_sets, k),
    )


def duplicates_over(
    entries: DataFrame, scans: DataFrame, min_wasted: int, drives: list[str] | None = None,
    require_hash: bool = False,
) -> DuplicateAnalysis:
    """Every set wasting at least ``min_wasted`` bytes with all of its copies; empty without runs."""
    floor = max(min_wasted, 0)
    content = select_content(entries, scans, drives, require_hash)
    pruned = content.pruned_folders()
    all_sets = stage(D.duplicate_sets(content.files), "all-file-sets")
    file_sets = all_sets.filter(F.col("wasted_bytes") >= floor)
    folder_sets = stage(pruned.sets(floor), "folder-sets")
    return DuplicateAnalysis(
        scans=content.runs,
        total=D.total_of_sets(all_sets),
        file_sets=file_sets,
        folder_sets=folder_sets,
        file_locations=D.locations(content.files, file_sets),
        folder_locations=D.locations(pruned.independent, folder_sets),
    )
