"""Which drops a table has: a small ledger in a folder beside the table.

A drop is known by the names and lengths of its files. It is written down with the
table's last id before its rows are added, and again afterwards. A job that died in
between tells by the table's last id whether the rows arrived.

Before anything else a job claims the table: it creates a file, which only one of several
jobs can do. The last id is read, and ids are given, under the claim only.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spokeworks.sources import files

NEW, ARRIVED, FINISHED = "new", "arrived", "finished"


def _ledger(table: str) -> str:
    return f"{table.rstrip('/')}_drops"


@dataclass(frozen=True)
class Drop:
    """The files of a folder, without their folder: ``(name, length)``."""

    files: tuple[tuple[str, int], ...]

    @property
    def id(self) -> str:
        """The same for the same names and lengths, in whatever order they are listed."""
        lines = "\n".join(self.lines())
        return hashlib.sha256(lines.encode()).hexdigest()[:16]

    def lines(self) -> list[str]:
        return [f"{length} {name}" for name, length in self.files]


def listed(spark: SparkSession, path: str) -> Drop:
    found = files.files_below(spark, path, ".csv")
    if not found:
        raise ValueError("the drop has no files")
    return Drop(tuple(sorted((os.path.basename(p), n) for p, n in found)))


@contextmanager
def claimed(spark: SparkSession, table: str, resume: bool = False) -> Iterator[None]:
    """Keep other jobs from writing to the table meanwhile.

    If another job has the claim, that is an error. A job gives its claim back also when it
    fails; only one that was killed leaves it, and ``resume`` takes it over.
    """
    claim, own = f"{table.rstrip('/')}__claim", f"{spark.sparkContext.applicationId} {uuid.uuid4().hex}"
    if resume:
        files.remove(spark, claim)
    if not files.create_once(spark, claim, own):
        raise ValueError(
            f"another job is writing to {table}; if it was killed, remove {claim} or run this one with resume"
        )
    try:
        yield
    finally:
        if files.exists(spark, claim) and files.read_text(spark, claim) == own:
            files.remove(spark, claim)


def begin(spark: SparkSession, table: str, drop: Drop, last_id: int) -> tuple[str, int]:
    """Write down that the drop is being added, under a claim.

    Gives its state (``NEW``: to be added; ``ARRIVED``: its rows are there, but it
    was not finished; ``FINISHED``) and the last id before it. Another drop that was begun
    and whose rows haven't arrived is an error: it has to be run again first. So is a folder
    with some files of an earlier drop.
    """
    ledger = _ledger(table)
    own, state, before = f"drop={drop.id}", NEW, last_id
    folders = [f for f in files.folder_names(spark, ledger) if f.startswith("drop=")]
    for folder in folders:
        if files.exists(spark, f"{ledger}/{folder}/finished"):
            if folder == own:
                return FINISHED, last_id
            continue
        begun = int(files.read_text(spark, f"{ledger}/{folder}/begun").split("\n")[0])
        if folder == own:
            state, before = (ARRIVED if last_id > begun else NEW), begun
        elif last_id <= begun:
            raise ValueError(f"another drop is being added to {table}; if its job died, run that again")
    if state == ARRIVED:
        return state, before
    others = [f"{ledger}/{f}/begun" for f in folders if f != own]
    if others:
        mine = spark.createDataFrame([(x,) for x in drop.lines()], "value STRING")
        again = spark.read.text(others).join(mine, "value", "left_semi").limit(3).collect()
        if again:
            names = [r["value"].partition(" ")[2] for r in again]
            raise ValueError(f"{table} has {names} already: put new files in a folder of their own")
    files.remove(spark, f"{ledger}/{own}/begun")
    files.create_once(spark, f"{ledger}/{own}/begun", "\n".join([str(last_id), *drop.lines()]))
    return NEW, last_id


def finish(spark: SparkSession, table: str, drop: Drop) -> None:
    files.create_once(spark, f"{_ledger(table)}/drop={drop.id}/finished", "")
