"""Files of pages as a data source, in which a broken file or page is a row and not the end of the job.

    spark.dataSource.register(page_source(parser, ocr))
    pages = spark.read.format("pages").load(folder)

A partition of the scan is some small files, or a range of the pages of a large one; the driver lists names and sizes and opens nothing.
``parser`` is called once in each task and gives the function from a file's bytes to its pages, or to a pair of these and a dict of what
the file says of itself (title, author, subject, creator).  A page is its text, or a function that gives the text and is only called for
pages of the task's own range.  ``ocr`` likewise gives the function from bytes and a page's number to a text.

A file that can't be read or parsed gives one row with status "error", the reason, and no page number; a page that fails gives such a
row with its number.  OCR that fails leaves the page empty, as the page itself was read.  Files that are no PDF are errors, too.
"""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

OCR_LEAST = 50
#: Bytes of files that a partition reads, about; larger files are divided by their pages.
RANGE = 16 << 20
SCHEMA = (
    "path string, hash string, filename string, size_kb double, title string, author string, subject string, creator string, "
    "page_count int, page_num int, text string, has_ocr boolean, char_count int, status string, error string"
)
NOT_PDF = "Only PDF files supported"


def is_pdf_name(name: str) -> bool:
    return name.lower().endswith(".pdf")


def page_rows(path: str, content: bytes, parse: Callable, look: Callable | None, part: int = 0, parts: int = 1) -> Iterator[tuple]:
    """Rows of SCHEMA: the pages of range ``part`` of ``parts``, or the reason why there are none, which the first range gives."""
    name, digest, size = posixpath.basename(path), hashlib.md5(content).hexdigest(), round(len(content) / 1024, 2)
    try:
        if not is_pdf_name(name):
            raise ValueError(NOT_PDF)
        found = parse(content)
        pages, says = found if isinstance(found, tuple) else (found, {})
        pages = pages if isinstance(pages, Sequence) else list(pages)
        said = [says.get(k) or default for k, default in (("title", name.rsplit(".", 1)[0]), ("author", "Unknown"), ("subject", ""), ("creator", ""))]
    except Exception as e:  # noqa: BLE001 - whatever a parser raises is that file's error
        if part == 0:
            yield (path, digest, name, size, None, None, None, None, None, None, None, None, None, "error", _reason(e))
        return
    head = (path, digest, name, size, *said, len(pages))
    for at in range(part * len(pages) // parts, (part + 1) * len(pages) // parts):
        try:
            text = pages[at]
            text = (text() if callable(text) else text).strip()
        except Exception as e:  # noqa: BLE001
            yield (*head, at + 1, "", None, 0, "error", _reason(e))
            continue
        flagged = len(text) < OCR_LEAST
        if flagged and look:
            try:
                text = (look(content, at + 1) or "").strip()
            except Exception:  # noqa: BLE001 - a page that OCR can't read is an empty page
                text = ""
        yield (*head, at + 1, text, flagged, len(text), "ok", None)


def _reason(e: Exception) -> str:
    return (str(e) or type(e).__name__)[:500]


class FileRanges(InputPartition):
    """(path, range, number of ranges) of the files that one task reads."""

    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


class PageReader(DataSourceReader):
    def __init__(self, path: str, size: int, parser: Callable, ocr: Callable | None):
        self.path, self.size, self.parser, self.ocr = path, size, parser, ocr

    def _system(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("/") else f"file:{self.path}")

    def partitions(self) -> list[FileRanges]:
        from pyarrow.fs import FileSelector, FileType

        system, root = self._system()
        root_info = system.get_file_info(root)
        found = [root_info] if root_info.type == FileType.File else system.get_file_info(FileSelector(root, recursive=True))
        out, held, room = [], [], self.size
        for f in sorted((x for x in found if x.type == FileType.File), key=lambda x: x.path):
            parts = max(1, -(-f.size // self.size))
            if parts > 1:
                out += [FileRanges([(f.path, i, parts)]) for i in range(parts)]
                continue
            if held and f.size > room:
                out.append(FileRanges(held))
                held, room = [], self.size
            held.append((f.path, 0, 1))
            room -= f.size
        return out + ([FileRanges(held)] if held else [])

    def read(self, partition: FileRanges) -> Iterator[tuple]:
        system, _ = self._system()
        parse, look = self.parser(), self.ocr() if self.ocr else None
        for path, part, parts in partition.files:
            try:
                with system.open_input_stream(path) as f:
                    content = f.read()
            except Exception as e:  # noqa: BLE001
                if part == 0:
                    yield (path, None, posixpath.basename(path), *[None] * 10, "error", _reason(e))
                continue
            yield from page_rows(path, content, parse, look, part, parts)


def page_source(parser: Callable, ocr: Callable | None = None, name: str = "pages") -> type[DataSource]:
    """A data source of that name, to be registered with the session; option ``rangeBytes`` sets the size of a partition."""

    class PageSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return PageReader(self.options["path"], int(self.options.get("rangeBytes", RANGE)), parser, ocr)

    return PageSource
