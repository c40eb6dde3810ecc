"""Git objects as a Spark data source, read by the ``git`` command on the executors.

    spark.dataSource.register(GitSource)
    spark.read.format("git").option("repo", path).option("scan", "tree").option("rev", "HEAD").load()

Scans: ``tree`` (path and blob of every file of a commit), ``blobs`` (the same with the text), ``commits`` (metadata and
diff of ``rev``, which may be a range), ``refs`` (branches and their tips), ``workdir`` (what differs from HEAD in the working
directory: modified, staged and deleted files).  ``partitions`` is the least number that a scan is divided into; trees are
divided by their uppermost folders, commits into slices of at most ``COMMITS``.
"""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
import uuid
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_SCHEMAS = {
    "tree": "commit_sha string, file_path string, git_file_hash string",
    "blobs": "commit_sha string, file_path string, git_file_hash string, content string",
    "commits": "git_sha string, parent_sha array<string>, author string, subject string, message string, diff string, files array<string>, timestamp bigint",
    "refs": "branch_name string, tip_commit string, remote string",
    "workdir": "file_path string, deleted boolean, git_file_hash string, content string",
}
#: Commits of a partition at most, and those that one git process is asked for.
COMMITS, BATCH = 2000, 200
#: The id of the empty tree, which every repository knows.
_SHA = re.compile("^[0-9a-f]{40,64}$")


def normal_rev(rev: str) -> str:
    """``X~n`` and ``X^n`` read X as a commit, so that tags of commits work alike."""
    m = re.match(r"^([^~^]+)([~^].*)$", rev)
    return f"{m[1]}^{{commit}}{m[2]}" if m and not m[2].startswith("^{") else rev


def git(repo: str, *args: str, text: bool = True, given: bytes | None = None):
    out = subprocess.run(["git", "-c", "safe.directory=*", "-c", "core.quotePath=false", "-C", repo, *args], capture_output=True, check=True, input=given).stdout
    return out.decode("utf-8", "replace") if text else out


def resolve(repo: str, branch: str | None = None, sha: str | None = None) -> str:
    """A branch goes before a commit, a commit before HEAD; local branches before remote ones; zeros where nothing resolves."""
    for name in ([f"refs/heads/{branch}", f"refs/remotes/{branch}", branch] if branch else [sha] if sha else ["HEAD"]):
        try:
            return git(repo, "rev-parse", "--verify", "--quiet", "--end-of-options", normal_rev(name) + "^{commit}").strip()
        except subprocess.CalledProcessError:
            continue
    return "0" * 40


class _Slice(InputPartition):
    def __init__(self, items: list):
        self.items = items


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return _SCHEMAS[self.options.get("scan", "tree")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.scan, self.rev = options["repo"], options.get("scan", "tree"), options.get("rev", "HEAD")
        self.parts = max(1, int(options.get("partitions", 8)))

    def partitions(self) -> list[_Slice]:
        if self.scan in ("refs", "workdir"):
            items: list = [None]
        elif self.scan in ("tree", "blobs"):
            items = _top(self.repo, self.rev)
        else:
            args = [normal_rev(r) for r in self.rev.split("..")] if ".." in self.rev else [normal_rev(self.rev)]
            spec = "..".join(args)
            items = git(self.repo, "rev-list", "--reverse", "--end-of-options", spec).split()
        n = min(max(self.parts, -(-len(items) // COMMITS)), max(1, len(items)))
        return [_Slice(items[i::n]) for i in range(n)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        if self.scan == "refs":
            for line in git(self.repo, "for-each-ref", "--format=%(refname) %(objectname)", "refs/heads", "refs/remotes").splitlines():
                ref, sha = line.split(" ")
                _, kind, name = ref.split("/", 2)
                if not name.endswith("/HEAD"):
                    yield name, sha, name.split("/")[0] if kind == "remotes" else None
        elif self.scan == "workdir":
            yield from _workdir(self.repo)
        elif self.scan == "commits":
            for i in range(0, len(partition.items), BATCH):
                yield from _commits(self.repo, partition.items[i : i + BATCH])
        elif partition.items:
            commit = git(self.repo, "rev-parse", "--end-of-options", normal_rev(self.rev) + "^{commit}").strip()
            listed = _tree(self.repo, self.rev, partition.items)
            if self.scan == "tree":
                for path, sha in listed:
                    yield commit, path, sha
            else:
                for path, sha, content in _blobs(self.repo, list(listed)):
                    yield commit, path, sha, content


def _top(repo: str, rev: str) -> list[str]:
    """Names in the uppermost folder."""
    return [e.decode("utf-8", "surrogateescape") for e in git(repo, "ls-tree", "-z", "--full-tree", "--name-only", normal_rev(rev), text=False).split(b"\0") if e]


def _tree(repo: str, rev: str, below: list[str]) -> Iterator[tuple[str, str]]:
    for entry in git(repo, "ls-tree", "-r", "-z", "--full-tree", normal_rev(rev), "--", *below, text=False).split(b"\0"):
        if entry:
            meta, path = entry.split(b"\t", 1)
            _, kind, sha = meta.split()
            if kind == b"blob":
                yield path.decode("utf-8", "replace"), sha.decode()


def _blobs(repo: str, items: list) -> Iterator[tuple[str, str, str]]:
    """In batches, so that a slice's files aren't all held at once."""
    for i in range(0, len(items), 256):
        part = items[i : i + 256]
        data, at = git(repo, "cat-file", "--batch", text=False, given="\n".join(s for _, s in part).encode() + b"\n"), 0
        for path, sha in part:
            end = data.index(b"\n", at)
            size = int(data[at:end].rsplit(b" ", 1)[1])
            yield path, sha, data[end + 1 : end + 1 + size].decode("utf-8", "replace")
            at = end + 1 + size + 1


def _commits(repo: str, shas: list[str]) -> Iterator[tuple]:
    """Two processes for all of them.  Merges and roots have neither diff nor files."""
    mark = uuid.uuid4().hex
    log = ["-c", "log.showRoot=false", "log", "--stdin", "--no-walk=unsorted", "--no-renames", "--no-color", "--no-ext-diff"]
    ask = lambda *more: git_log(repo, log + list(more), shas).split(mark)[1:]
    files = {}
    for part in ask("--name-only", "-z", f"--format=tformat:{mark}%H%x00"):
        sha, *names = part.split("\0")
        files[sha] = sorted({n.strip("\n") for n in names} - {""})
    for part in ask("-p", f"--format=tformat:{mark}%H%x00%P%x00%an <%ae>%x00%s%x00%B%x00%ct%x00"):
        sha, parents, author, subject, message, at, diff = part.split("\0", 6)
        whole = len(parents.split()) == 1
        yield sha, parents.split(), author, subject, message.strip(), diff.lstrip("\n") if whole else "", files[sha] if whole else [], int(at)


def git_log(repo: str, args: list[str], shas: list[str]) -> str:
    return git(repo, *args, given="\n".join(shas).encode() + b"\n")


def _workdir(repo: str) -> Iterator[tuple]:
    """Tracked files that differ from HEAD, staged or not; a file's hash is that of its bytes as a blob."""
    top = git(repo, "rev-parse", "--show-toplevel").strip()
    fields = git(repo, "diff", "--name-status", "-z", "--no-renames", "HEAD").split("\0")
    for status, path in zip(fields[::2], fields[1::2]):
        file = os.path.join(top, path)
        if status == "D" or not os.path.isfile(file):
            yield path, True, None, None
        else:
            with open(file, "rb") as f:
                data = f.read()
            yield path, False, hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest(), data.decode("utf-8", "replace")
