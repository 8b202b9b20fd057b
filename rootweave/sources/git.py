"""What git says of a root: its commit, and the paths that changed. Git runs on the driver, with arguments as a list."""

from __future__ import annotations

import subprocess


def _git(root: str, *arguments: str, seconds: int = 20) -> subprocess.CompletedProcess | None:
    try:
        return subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True, timeout=seconds, check=False)
    except (OSError, subprocess.SubprocessError):
        return None


def _lines(done: subprocess.CompletedProcess | None) -> list[str]:
    return [x for x in done.stdout.splitlines() if x] if done and done.returncode == 0 else []


def head(root: str) -> str | None:
    """The commit that is checked out, or None."""
    return next(iter(_lines(_git(root, "rev-parse", "HEAD", seconds=5))), None)


def is_clean_at(root: str, commit: str | None) -> bool:
    """Whether the root is at this commit without any change, so that no file needs a look."""
    if not commit or head(root) != commit:
        return False
    status = _git(root, "status", "--porcelain", seconds=5)
    return status is not None and status.returncode == 0 and not status.stdout.strip()


def changed_since(root: str, ref: str) -> set[str]:
    """Tracked paths that differ from a revision, and untracked ones that aren't ignored; none where git can't tell."""
    return {*_lines(_git(root, "diff", "--name-only", ref)), *_lines(_git(root, "ls-files", "--others", "--exclude-standard"))}


def check_ref(ref: str) -> str:
    """ref, if it can be a revision and no option."""
    if not ref or ref.startswith("-") or "\0" in ref:
        raise ValueError(f"{ref!r} is no revision")
    return ref


def diff_targets(root: str, ref: str = "HEAD", own_folder: str | None = None) -> tuple[str, list[str]]:
    """(commit, paths changed since then): in git's order, once each, without those of the index's own folder."""
    verified = _git(root, "rev-parse", "--verify", "--end-of-options", f"{check_ref(ref)}^{{commit}}", seconds=10)
    if verified is None or verified.returncode:
        raise ValueError(f"{ref!r} names no commit")
    commit = verified.stdout.strip()
    done = _git(root, "diff", "--name-only", "--diff-filter=ACDMR", commit, "--")
    if done is None or done.returncode:
        raise RuntimeError(f"git can't compare with {commit}")
    paths = dict.fromkeys(x.strip().replace("\\", "/") for x in _lines(done))
    own = own_folder.strip("/") if own_folder else None
    return commit, [p for p in paths if p and not (own and (p == own or p.startswith(f"{own}/")))]
