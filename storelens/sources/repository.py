"""Finding a repository, its hash, its refs and revisions; small files, read on the driver."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from pathlib import Path


class NotARepository(Exception):
    """No repository at the path or above it."""


class BadRevision(Exception):
    """A revision that names nothing, or too much."""


@dataclass(frozen=True)
class Repository:
    git_dir: str
    common_dir: str
    worktree: str | None
    kind: str  # normal, bare or worktree
    hash_bytes: int  # 20 or 32

    @property
    def objects_dir(self) -> str:
        return f"{self.common_dir}/objects"

    @property
    def name(self) -> str:
        return os.path.basename(self.worktree or self.git_dir.removesuffix(".git").rstrip("/") or self.git_dir).rstrip(".")


@dataclass(frozen=True)
class Ref:
    name: str
    target: bytes
    is_head: bool


def _hash_bytes(common_dir: str) -> int:
    """32 where the configuration's extensions section asks for SHA-256, else 20."""
    try:
        text = Path(common_dir, "config").read_text(errors="replace")
    except OSError:
        return 20
    section, found = "", 20
    for line in map(str.strip, text.splitlines()):
        if m := re.match(r'\[\s*([^\s"\]]+)[^\]]*\]', line):
            section = m[1].lower()
        elif section == "extensions" and (m := re.match(r'objectformat\s*=\s*"?(\w+)', line, re.IGNORECASE)):
            found = 32 if m[1].lower() == "sha256" else 20
    return found


def discover(start: str) -> Repository:
    """The repository that holds ``start``: a ``.git`` folder or file in it or above, or a bare layout."""
    try:
        here = Path(start).resolve(strict=True)
    except OSError as e:
        raise NotARepository(start) from e
    for folder in (here, *here.parents):
        dot = folder / ".git"
        if dot.is_dir():
            return Repository(str(dot), str(dot), str(folder), "normal", _hash_bytes(str(dot)))
        if dot.is_file():
            return _linked(folder, dot)
        if (folder / "HEAD").is_file() and (folder / "objects").is_dir() and (folder / "refs").is_dir():
            return Repository(str(folder), str(folder), None, "bare", _hash_bytes(str(folder)))
    raise NotARepository(start)


def _linked(folder: Path, pointer: Path) -> Repository:
    text = pointer.read_text().strip()
    if not text.startswith("gitdir:"):
        raise NotARepository(str(folder))
    git_dir = (folder / text[7:].strip()).resolve()
    common = git_dir / "commondir"
    shared = (git_dir / common.read_text().strip()).resolve() if common.is_file() else git_dir
    return Repository(str(git_dir), str(shared), str(folder), "worktree", _hash_bytes(str(shared)))


def _oid(text: str, width: int) -> bytes | None:
    text = text.strip()
    return bytes.fromhex(text) if re.fullmatch(rf"[0-9a-fA-F]{{{2 * width}}}", text) else None


def read_refs(repo: Repository) -> list[Ref]:
    """All refs by name, loose ones over packed ones, and HEAD (marked) if it leads anywhere."""
    raw: dict[str, str] = {}
    packed = Path(repo.common_dir, "packed-refs")
    if packed.is_file():
        for line in packed.read_text(errors="surrogateescape").splitlines():
            oid, _, name = line.partition(" ")
            if name and line[0] not in "#^":
                raw[name] = oid
    root = Path(repo.common_dir, "refs")
    for path in sorted(p for p in root.rglob("*") if p.is_file()):
        raw[f"refs/{path.relative_to(root).as_posix()}"] = path.read_text(errors="surrogateescape").strip()

    def resolve(text: str) -> bytes | None:
        for _ in range(8):
            if not text.startswith("ref:"):
                return _oid(text, repo.hash_bytes)
            text = raw.get(text[4:].strip(), "")
        return None

    out = [Ref(n, oid, False) for n in sorted(raw) if (oid := resolve(raw[n]))]
    head = Path(repo.git_dir, "HEAD")
    if head.is_file() and (oid := resolve(head.read_text(errors="surrogateescape").strip())):
        out.append(Ref("HEAD", oid, True))
    return out


@dataclass(frozen=True)
class Revision:
    base: str
    steps: tuple[tuple[str, int], ...]


def parse_revision(text: str) -> Revision:
    """``NAME`` followed by up to 32 ``~N`` or ``^N``; N is 1 if left out."""
    m = re.fullmatch(r"([^~^]+)((?:[~^][0-9]*)*)", text)
    if not m:
        raise BadRevision(text)
    steps = tuple((s[0], int(s[1:] or 1)) for s in re.findall(r"[~^][0-9]*", m[2]))
    if len(steps) > 32:
        raise BadRevision(text)
    return Revision(m[1], steps)


def resolve_base(name: str, refs: list[Ref], width: int) -> bytes:
    """A full id, else a ref by its name as it stands, or under heads, tags or remotes."""
    known = {r.name: r.target for r in refs}
    found = _oid(name, width)
    for prefix in ("", "refs/heads/", "refs/tags/", "refs/remotes/"):
        found = found or known.get(prefix + name)
    if not found:
        raise BadRevision(name)
    return found


def file_sizes(root: str, skip: str | None = None) -> int:
    """Bytes of regular files below ``root``; links aren't followed, names equal to ``skip`` are left out."""
    total = 0
    for folder, names, files in os.walk(root):
        if skip:
            names[:] = [n for n in names if n != skip]
        for name in files:
            if name != skip:
                try:
                    stat = os.lstat(os.path.join(folder, name))
                except OSError:
                    continue
                total += stat.st_size if stat.st_mode & 0o170000 == 0o100000 else 0
    return total
