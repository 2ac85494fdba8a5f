"""Projects: where each folder's index lies, building it, and a small cache of loaded ones."""

from __future__ import annotations

import hashlib
import os
import subprocess
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphmill.operators import index
from glyphmill.sources import files as source
from glyphmill.sources import snapshot

#: Name of the file in a project's data folder that holds the project's path.
MARKER = "project.txt"
REMOTE_ACTIONS = ("tree", "outline", "search", "meta")


def git_head(root: str) -> str | None:
    """The 40 hex digits of a folder's checked-out commit, or None."""
    try:
        out = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=20, check=False).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None
    return out if len(out) == 40 and all(c in "0123456789abcdef" for c in out) else None


def data_folder(store: str, root: str) -> str:
    """A project's data folder, named by a hash of its path."""
    return f"{store}/{hashlib.sha256(os.path.abspath(root).encode()).hexdigest()[:16]}"


def build_index(spark: SparkSession, root: str, store: str, policy: bool = True, **flags: bool) -> str:
    """Reads the folder ``root``, writes files and relations as a snapshot in its data folder, and returns that folder."""
    folder = data_folder(store, root)
    files = source.read_files(spark, root, policy=policy)
    snapshot.write_snapshot(files, index.build(files, **flags), folder, root=os.path.abspath(root), git_head=git_head(root) or "")
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{MARKER}", "w", encoding="utf-8") as f:
        f.write(os.path.abspath(root))
    return folder


def list_projects(store: str) -> list[dict]:
    """(path, folder, snapshot) of every project below ``store``, by path."""
    out = []
    for entry in os.scandir(store) if os.path.isdir(store) else []:
        marker = f"{entry.path}/{MARKER}"
        if os.path.isfile(marker):
            with open(marker, encoding="utf-8") as f:
                out.append({"path": f.read().strip(), "folder": entry.path, "snapshot": os.path.exists(f"{entry.path}/meta")})
    return sorted(out, key=lambda x: x["path"])


class Projects:
    """The relations of the projects used last, at most ``most`` of them; the one unused for longest goes first."""

    def __init__(self, spark: SparkSession, store: str, most: int = 5) -> None:
        self.spark, self.store, self.most, self.held = spark, store, most, OrderedDict()

    def load(self, root: str) -> dict[str, DataFrame]:
        """A project's relations from its snapshot, if that is whole and of the commit that is checked out; else built anew."""
        root = os.path.abspath(root)
        head = git_head(root) or ""
        if root in self.held and self.held[root][0] == head:
            self.held.move_to_end(root)
            return self.held[root][1]
        self.drop(root)
        folder = data_folder(self.store, root)
        found = snapshot.read_snapshot(self.spark, folder, root, head)
        if found is None:
            found = snapshot.read_snapshot(self.spark, build_index(self.spark, root, self.store, policy=False), root)
        self.held[root] = (head, {n: d.cache() for n, d in found.items()})
        while len(self.held) > self.most:
            self.drop(next(iter(self.held)))
        return self.held[root][1]

    def drop(self, root: str) -> None:
        for d in self.held.pop(root, ("", {}))[1].values():
            d.unpersist()


def remote(repository: str, action: str, fetch: Callable[[str], str], base: str, **query: str) -> str:
    """What a remote service answers for ``owner/repo``; only known actions and plain names are asked for. ``fetch`` does the transfer."""
    from urllib.parse import quote, urlencode

    owner, _, name = repository.partition("/")
    if action not in REMOTE_ACTIONS or not owner or not name or any(not c.isalnum() and c not in "-_." for c in owner + name) or ".." in (owner, name):
        raise ValueError(f"{action} of {repository!r} is no known request")
    return fetch(f"{base.rstrip('/')}/{quote(owner)}/{quote(name)}/{action}" + (f"?{urlencode(query)}" if query else ""))
