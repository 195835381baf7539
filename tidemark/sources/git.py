"""Git mirrors in a folder that all executors see, as snapshot tables."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidemark.functions import scalar


class GitError(Exception):
    """A git command failed; the message is short and free of content."""


class Mirror:
    """A bare mirror `<root>/<slug>.git`."""

    def __init__(self, root: str, slug: str, timeout: int = 300):
        if not scalar.valid_path(slug) or slug.startswith("-"):
            raise ValueError("invalid path — path traversal is rejected")
        self.slug, self.dir, self.timeout = slug, Path(root, f"{slug}.git"), timeout

    def _git(self, *args: str) -> bytes:
        env = os.environ | {"GIT_TERMINAL_PROMPT": "0", "LC_ALL": "C"}
        done = subprocess.run(["git", "-c", "core.quotePath=false", *args], capture_output=True, timeout=self.timeout, env=env)
        if done.returncode:
            raise GitError(f"git {args[0]} ended with {done.returncode}")
        return done.stdout

    def _at(self, *args: str) -> bytes:
        return self._git("--git-dir", str(self.dir), *args)

    def ensure(self, url: str) -> None:
        """Clone the mirror, or fetch it if it is there."""
        if not scalar.valid_url(url):
            raise ValueError("invalid url")
        if self.dir.exists():
            self._at("fetch", "--prune", "--quiet")
        else:
            self.dir.parent.mkdir(parents=True, exist_ok=True)
            self._git("clone", "--mirror", "--quiet", "--", url, str(self.dir))

    def head(self, ref: str = "HEAD") -> str | None:
        """The commit of a ref; None in a repository without commits."""
        if not scalar.valid_ref(ref):
            raise ValueError("invalid ref")
        try:
            return self._at("rev-parse", "--verify", "--quiet", "--end-of-options", f"{ref}^{{commit}}").decode().strip()
        except GitError:
            if ref == "HEAD" and not self._at("rev-list", "--all", "--max-count=1").strip():
                return None
            raise

    def snapshot(self, spark: SparkSession, source_id: str, ref: str = "HEAD") -> DataFrame:
        """files(source_id, repo, ref, path, content) of a ref: blobs up to MAX_FILE_BYTES, as bytes;
        submodules aren't blobs. The driver lists them; tasks read their contents from the mirror, one
        git process a batch."""
        sha = self.head(ref)
        rows = []
        for record in self._at("ls-tree", "-r", "-l", "-z", sha).split(b"\0") if sha else []:
            if not record:
                continue
            info, _, path = record.partition(b"\t")
            mode, kind, blob, size = info.split()
            if kind == b"blob" and int(size) <= scalar.MAX_FILE_BYTES:
                rows.append((source_id, self.slug, ref, path.decode("utf-8", "replace"), blob.decode()))
        listed = spark.createDataFrame(rows, "source_id string, repo string, ref string, path string, blob string")
        return listed.mapInPandas(_contents(str(self.dir), self.timeout), "source_id string, repo string, ref string, path string, content binary")


def _contents(mirror: str, timeout: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = "".join(f"{b}\n" for b in batch["blob"]).encode()
            done = subprocess.run(["git", "--git-dir", mirror, "cat-file", "--batch"], input=asked, capture_output=True, timeout=timeout)
            if done.returncode:
                raise GitError(f"git cat-file ended with {done.returncode}")
            out, at = [], 0
            for _ in range(len(batch)):
                end = done.stdout.index(b"\n", at)
                size = int(done.stdout[at:end].split()[2])
                out.append(done.stdout[end + 1 : end + 1 + size])
                at = end + size + 2
            yield batch.drop(columns="blob").assign(content=out)

    return run
