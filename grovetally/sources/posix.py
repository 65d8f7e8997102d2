"""``spark.read.format("grove_posix")``: a directory tree as entry rows.

Register with ``spark.dataSource.register(PosixSource)``.  The driver lists the
first two levels; every directory of the second is one partition, walked by an
executor that sees the same mount.  Option ``skips`` turns the output into the
rows that could not be read or were not followed, with their reason.
"""

from __future__ import annotations

import os
import stat

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Private directories that are left out at the root only.
PRIVATE = {".fseventsd", ".Spotlight-V100", ".Trashes"}
SCHEMA = "path string, entry_kind string, file_id long, logical_size long, symlink_target string, allocated_size long, real_size long"
SKIPS = "path string, reason string"


class _Tree(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


def _reason(e: OSError) -> str:
    if isinstance(e, PermissionError):
        return "permission_denied"
    return "not_found" if isinstance(e, FileNotFoundError) else f"read_error:{type(e).__name__}"


class PosixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.realpath(options["path"])
        self.skips = options.get("skips", "false").lower() == "true"
        self.cross = options.get("cross_mounts", "false").lower() == "true"
        overlay = options.get("overlays")
        self.overlays = frozenset(line.split("\t")[0].strip("/") for line in overlay.split("\n") if line.strip()) if overlay else frozenset()
        if not os.path.isdir(self.root):
            raise ValueError(f"not a directory: {options['path']}")
        self.device = os.stat(self.root).st_dev

    def partitions(self):
        """The root's and its directories' own rows shallow, then each directory below them whole."""
        out = [_Tree("", False)]
        for first in self._folders(""):
            out.append(_Tree(first, False))
            out += [_Tree(second, True) for second in self._folders(first)]
        return out

    def _folders(self, folder: str) -> list[str]:
        return [path for path, entry, follow in self._listed(folder, []) if follow]

    def _listed(self, folder: str, skipped: list):
        """(path, entry, is it followed) of the children of a directory, by name."""
        try:
            with os.scandir(os.path.join(self.root, folder)) as found:
                entries = sorted(found, key=lambda e: os.fsencode(e.name))
        except OSError as e:
            skipped.append((folder or ".", _reason(e)))
            return
        for entry in entries:
            try:
                entry.name.encode("utf-8")
            except UnicodeEncodeError:
                skipped.append((folder or ".", "non_utf8_name"))
                continue
            path = f"{folder}/{entry.name}" if folder else entry.name
            is_dir = entry.is_dir(follow_symlinks=False)
            if not folder and is_dir and entry.name in PRIVATE:
                continue
            if is_dir and path in self.overlays:
                skipped.append((path, "firmlink_overlay_source"))
                continue
            follow = is_dir
            if is_dir and not self.cross:
                try:
                    if entry.stat(follow_symlinks=False).st_dev != self.device:
                        skipped.append((path, "mount_boundary"))
                        follow = False
                except OSError:
                    pass
            yield path, entry, follow

    def read(self, partition: _Tree):
        todo, skipped = [partition.folder], []
        while todo:
            for path, entry, follow in self._listed(todo.pop(), skipped):
                try:
                    row = self._row(path, entry)
                except OSError as e:
                    skipped.append((path, _reason(e)))
                    continue
                if follow and partition.deep:
                    todo.append(path)
                if not self.skips:
                    yield row
        if self.skips:
            yield from skipped

    @staticmethod
    def _row(path: str, entry: os.DirEntry) -> tuple:
        s = entry.stat(follow_symlinks=False)
        kind = "file" if stat.S_ISREG(s.st_mode) else "dir" if stat.S_ISDIR(s.st_mode) else "symlink" if stat.S_ISLNK(s.st_mode) else "other"
        target = os.readlink(entry.path) if kind == "symlink" else None
        logical = s.st_size if kind == "file" else len(os.fsencode(target)) if target is not None else 0
        allocated = s.st_blocks * 512 if kind == "file" else None if kind == "other" else 0
        return path, kind, s.st_ino, logical, target, allocated, allocated


class PosixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "grove_posix"

    def schema(self) -> str:
        return SKIPS if self.options.get("skips", "false").lower() == "true" else SCHEMA

    def reader(self, schema) -> PosixReader:
        return PosixReader(dict(self.options))


def one_path_per_directory(entries):
    """Of directories seen under several paths with one identity the least path stays; the rest go with all below them.

    The second DataFrame tells which went and why.
    """
    from pyspark.sql import functions as F

    from ..functions import paths as p

    dirs = entries.filter("entry_kind = 'dir'")
    first = dirs.groupBy("file_id").agg(F.min("path").alias("first"))
    gone = dirs.join(first, "file_id").filter("path <> first").select("path").distinct()
    up = entries.withColumn("_up", F.explode(F.concat(p.ancestors(F.col("path")), F.array("path"))))
    lost = up.join(gone.withColumnRenamed("path", "_up"), "_up", "left_semi").select("path").distinct()
    return entries.join(lost, "path", "left_anti"), gone.withColumn("reason", F.lit("duplicate_dir_inode"))
