"""A sink that writes one whole file for each session, and the report driver that fills it in any of five formats."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as afs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from docengine import constants as C
from docengine.functions import pages
from docengine.functions import text as T
from docengine.operators import session_reports as S


#: Times that removing staged files is tried again while tasks of a failed job still write.
TRIES = 5


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has staged: (staged, final) paths."""

    files: list[tuple[str, str]]


class SessionFiles(DataSource):
    """Rows of (session string, content binary) to files path/session/file. Tasks write beside the final places; the driver
    moves all files once every task is done, so a failed task or job leaves none. A session that is null, has no usable
    name or comes twice is an error; a null content makes an empty file. Mode append fails where a file exists, overwrite
    replaces the files of the sessions given and no others. path is any that pyarrow opens from driver and executors."""

    @classmethod
    def name(cls) -> str:
        return "session_files"

    def schema(self) -> str:
        return "session string, content binary"

    def writer(self, schema, overwrite: bool) -> SessionWriter:
        return SessionWriter(self.options["path"], self.options["file"], overwrite)


class SessionWriter(DataSourceWriter):
    def __init__(self, path: str, file: str, overwrite: bool):
        self.path, self.file, self.overwrite, self.job = path, file, overwrite, uuid.uuid4().hex
        where, root = self._open()
        where.create_dir(self._staging(root))

    def _open(self) -> tuple[afs.FileSystem, str]:
        return afs.FileSystem.from_uri(self.path if "://" in self.path else os.path.abspath(self.path))

    def _staging(self, root: str) -> str:
        return f"{root}/_staging-{self.job}"

    def write(self, iterator: Iterator) -> Written:
        where, root = self._open()
        attempt, files = f"{self._staging(root)}/{uuid.uuid4().hex}", []
        # not recursive: a task that outlives its job finds no folder to write to
        where.create_dir(attempt, recursive=False)
        for i, row in enumerate(iterator):
            if row["session"] in (None, "", ".", ".."):
                raise ValueError(f"no file for a session named {row['session']!r}")
            staged = f"{attempt}/{i}"
            with where.open_output_stream(staged) as f:
                f.write(row["content"] or b"")
            files.append((staged, f"{root}/{quote(row['session'], safe=' ')}/{self.file}"))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        where, root = self._open()
        files = [f for m in messages if m for f in m.files]
        finals = [final for _, final in files]
        if len(set(finals)) < len(finals):
            raise ValueError("a session has more than one report")
        taken = [] if self.overwrite else [f for f in finals if where.get_file_info(f).type != afs.FileType.NotFound]
        if taken:
            raise FileExistsError(taken[0])
        for staged, final in files:
            where.create_dir(final.rsplit("/", 1)[0])
            if self.overwrite and where.get_file_info(final).type != afs.FileType.NotFound:
                where.delete_file(final)
            where.move(staged, final)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        where, root = self._open()
        for left in range(TRIES, -1, -1):
            try:
                if where.get_file_info(self._staging(root)).type != afs.FileType.NotFound:
                    where.delete_dir(self._staging(root))
                return
            except OSError:  # a task still writes there
                if not left:
                    raise
                time.sleep(0.2)


def write_session_files(contents: DataFrame, path: str, file: str, mode: str = "append") -> None:
    contents.sparkSession.dataSource.register(SessionFiles)
    contents.select(F.col("session").cast("string"), F.col("content").cast("binary")).write.format("session_files").option("path", path).option("file", file).mode(mode).save()


def _composed(rows: DataFrame, compose) -> DataFrame:
    """(session, content) of each row by a function of the row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"session": b["session"], "content": [compose(r) for r in b.to_dict("records")]})

    return rows.mapInPandas(run, "session string, content binary")


def _docx(row: dict) -> bytes:
    names = list(row["documents"]) if row["documents"] is not None else []
    listed = f"{len(names)} document(s):\n" + "\n".join(f"{i}. {n}" for i, n in enumerate(names, 1)) if names else "0 documents"
    fields = [
        ("Project Name", row["project_name"]), ("Project ID", row["project_id"]), ("Crediting Period", row["crediting_period"] or "_Not specified_"), ("Date of Submission", (row["reviewed_at"] or "")[:10]),
        ("Project Proponent", row["proponent"]), ("Registry Agents", "AI-assisted review"), ("Documents Submitted", listed),
    ]
    return pages.docx([(k, v or "") for k, v in fields], [] if row["cells"] is None else list(row["cells"]))


def report_files(format: str, projects: DataFrame, found: DataFrame, checks: DataFrame, snippets: DataFrame | None = None, template: str | None = None) -> DataFrame:
    """(session, content) of each session of projects in a format: markdown, json, pdf, or checklist and docx, which need
    the snippets; a checklist is filled into its template. An unknown format is an error."""
    if format not in C.REPORT_FILES:
        raise ValueError(f"Unsupported format: {format}. Choose: {', '.join(C.REPORT_FILES)}")
    if format in ("checklist", "docx") and snippets is None or format == "checklist" and template is None:
        raise ValueError(f"a report in format {format} needs snippets, a checklist its template too")
    if format == "pdf":
        text = S.markdown_texts(projects, found, checks, detailed=True).select("session", T.latin1(F.col("text")).alias("text"))
        return _composed(text, lambda r: pages.pdf(r["text"]))
    if format == "docx":
        cells = S.checklist_cells(found, snippets, projects)
        by_id = F.sort_array(F.collect_list(F.struct("requirement_id", *(c for c in cells.columns if c not in ("session", "requirement_id")))))
        return _composed(projects.join(cells.groupBy("session").agg(by_id.alias("cells")), "session", "left"), _docx)
    if format == "checklist":
        text = S.checklist_texts(template, S.totals(projects, found, checks), S.checklist_cells(found, snippets, projects))
    else:
        text = (S.markdown_texts if format == "markdown" else S.json_texts)(projects, found, checks)
    return text.select("session", F.encode("text", "UTF-8").alias("content"))


def write_reports(path: str, format: str, projects: DataFrame, found: DataFrame, checks: DataFrame, snippets: DataFrame | None = None, template: str | None = None, mode: str = "overwrite") -> None:
    """Each session's report as one file in a folder of its name; the file's name goes by the format."""
    write_session_files(report_files(format, projects, found, checks, snippets, template), path, C.REPORT_FILES[format], mode)
