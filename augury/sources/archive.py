"""A folder as one compressed archive, for handing a data set on."""

from __future__ import annotations

import tarfile
from pathlib import Path


def pack(folder: str | Path, archive: str | Path) -> Path:
    """Writes ``archive``: zstandard for ``.tar.zst``, gzip otherwise; entries in name order."""
    folder, archive = Path(folder), Path(archive)
    if archive.suffix != ".zst":
        with tarfile.open(archive, "w:gz") as t:
            t.add(folder, folder.name, filter=lambda i: i)
        return archive
    import zstandard

    with archive.open("wb") as f, zstandard.ZstdCompressor(level=10).stream_writer(f) as z, tarfile.open(fileobj=z, mode="w|") as t:
        for p in sorted(folder.rglob("*")):
            if p.is_file():
                t.add(p, str(Path(folder.name) / p.relative_to(folder)))
    return archive


def unpack(archive: str | Path, folder: str | Path) -> Path:
    """Extracts an archive of :func:`pack`; entries outside the folder are refused."""
    archive, folder = Path(archive), Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    if archive.suffix != ".zst":
        with tarfile.open(archive) as t:
            t.extractall(folder, filter="data")
        return folder
    import zstandard

    with archive.open("rb") as f, zstandard.ZstdDecompressor().stream_reader(f) as z, tarfile.open(fileobj=z, mode="r|") as t:
        t.extractall(folder, filter="data")
    return folder
