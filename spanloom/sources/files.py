"""Files of shared storage by URI, for sources that Spark has no reader of: local paths, file:, hdfs:, s3: and gs: through pyarrow."""

from __future__ import annotations

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri and not uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return fs.LocalFileSystem(), "/" + uri.split(":", 1)[1].lstrip("/") if uri.startswith("file:") else uri


def list_files(uri: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files under a folder in order of path; names with "." or "_" in front are skipped, folders too."""
    system, path = resolve(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    base = path.rstrip("/")
    out = []
    for f in system.get_file_info(fs.FileSelector(path, recursive=True)):
        if f.type == fs.FileType.File and not any(p[:1] in (".", "_") for p in f.path[len(base) :].strip("/").split("/")):
            out.append((f.path, f.size))
    return sorted(out)


def exists(uri: str) -> bool:
    system, path = resolve(uri)
    return system.get_file_info(path).type != fs.FileType.NotFound
