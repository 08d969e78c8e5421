"""Patient folders as a Spark data source: names only, listed by the executors."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders of a session that make it a study, and the session's name.
ANATOMY, TREATMENT = "anat", "rt"
SESSION = re.compile(r"ses-\d{14}")
#: Patients that one partition lists.
PATIENTS = 64
#: Sessions whose folders a task has on its disk at once, where a tree is not kept.
SESSIONS = 1000


def opened(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or address (file:, hdfs:, s3:, gs:), and the path there."""
    if "://" not in root and root.startswith("file:"):
        root = "file://" + root.removeprefix("file:")
    files, top = pyarrow.fs.FileSystem.from_uri(root) if "://" in root else (pyarrow.fs.LocalFileSystem(), root)
    return files, top.rstrip("/")


def folders(files: pyarrow.fs.FileSystem, path: str) -> list[str]:
    if isinstance(files, pyarrow.fs.LocalFileSystem):
        # The system tells folders from files as it lists them: no further call an entry.
        try:
            with os.scandir(path) as entries:
                return sorted(e.name for e in entries if e.is_dir())
        except FileNotFoundError:
            return []
    found = files.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == pyarrow.fs.FileType.Directory)


class Patients(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class StudyFolders(DataSource):
    """(patient_id, session, has_anat, has_rt): the session folders of the tree <root>/<patient>/ses-<14 digits>/."""

    columns = "patient_id string, session string, has_anat boolean, has_rt boolean"

    @classmethod
    def name(cls) -> str:
        return "study_folders"

    def schema(self) -> str:
        return self.columns

    def reader(self, schema) -> DataSourceReader:
        return StudyReader(self.options["path"])


class StudyReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        names = folders(*opened(self.root))
        return [Patients(names[i : i + PATIENTS]) for i in range(0, len(names), PATIENTS)] or [Patients([])]

    def read(self, partition: Patients) -> Iterator[tuple[str, str, bool, bool]]:
        files, top = opened(self.root)
        for patient in partition.names:
            for session in folders(files, f"{top}/{patient}"):
                if SESSION.fullmatch(session):
                    inside = set(folders(files, f"{top}/{patient}/{session}"))
                    yield patient, session, ANATOMY in inside, TREATMENT in inside


def passing_studies(paths: DataFrame, path: str = "path") -> DataFrame:
    """What the data source reads from the tree of these folders (<patient>/<session>/<folder>), without keeping that tree: each task makes
    SESSIONS sessions at a time on its own disk, lists them by the source's reader and drops them. A session's folders meet in one row
    first, so no session is cut. New inodes are what costs disk and time, so sessions with the same folders inside are names of one link
    to one folder that has them, and a patient's folder is one of an earlier patient under another name."""
    part = lambda i: F.get(F.split(F.col(path), "/"), F.lit(i))
    names = paths.where(F.col(path).isNotNull()).select(part(0).alias("patient"), part(1).alias("session"), part(2).alias("folder")).where("session is not null")
    # As many tasks as the session asks for: the rows are small, but each means work on a disk.
    dealt = names.repartition(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), "patient")
    inside = dealt.groupBy("patient", "session").agg(F.array_sort(F.collect_set("folder")).alias("inside")).sortWithinPartitions("patient")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory(prefix="studies-") as own:
            passing = Passing(own)
            for batch in batches:
                for a in range(0, batch.num_rows, SESSIONS):
                    found = passing.visited(batch.slice(a, SESSIONS).to_pylist())
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string() if i < 2 else pa.bool_()) for i in range(4)], names=["patient_id", "session", "has_anat", "has_rt"])

    return inside.mapInArrow(visit, StudyFolders.columns)


class Passing:
    """A tree under a folder, made and dropped for some sessions at a time."""

    def __init__(self, own: str):
        self.top, self.spare = f"{own}/tree", f"{own}/spare"
        #: Links to the folders made so far, by what they have inside; and the number of patients' folders that wait for a name.
        self.kinds: dict[tuple[str, ...], str] = {}
        self.spares = 0
        os.mkdir(self.top)
        os.mkdir(self.spare)

    def kind(self, inside: tuple[str, ...]) -> str:
        """The link to a folder that has these inside."""
        if inside not in self.kinds:
            made = f"{self.top}-{len(self.kinds)}"
            for folder in inside or [""]:
                os.makedirs(f"{made}/{folder}")
            os.symlink(made, f"{made}.link")
            self.kinds[inside] = f"{made}.link"
        return self.kinds[inside]

    def name_session(self, link: str, path: str) -> None:
        try:
            os.link(link, path, follow_symlinks=False)
        except (OSError, NotImplementedError):
            # Not every file system gives a link a second name.
            os.symlink(os.readlink(link), path)

    def visited(self, rows: list[dict]) -> list[tuple[str, str, bool, bool]]:
        """What the reader finds in a tree of these sessions."""
        patients = sorted({r["patient"] for r in rows})
        for patient in patients:
            if self.spares:
                self.spares -= 1
                os.rename(f"{self.spare}/{self.spares}", f"{self.top}/{patient}")
            else:
                os.mkdir(f"{self.top}/{patient}")
        paths = [f"{self.top}/{r['patient']}/{r['session']}" for r in rows]
        for r, p in zip(rows, paths, strict=True):
            self.name_session(self.kind(tuple(r["inside"])), p)
        found = [*StudyReader(self.top).read(Patients(patients))]
        for p in paths:
            os.unlink(p)
        for patient in patients:
            os.rename(f"{self.top}/{patient}", f"{self.spare}/{self.spares}")
            self.spares += 1
        return found
