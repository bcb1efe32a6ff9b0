"""What git knows of a folder; runs on the driver, the results are small lists of paths."""

from __future__ import annotations

import subprocess


def _git(folder: str, *args: str) -> str | None:
    done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True)
    return done.stdout.strip() if done.returncode == 0 else None


def head(folder: str) -> str | None:
    """The current commit, None outside a repository."""
    return _git(folder, "rev-parse", "HEAD")


def commit_time(folder: str, commit: str = "HEAD") -> int | None:
    """Seconds since the epoch at which a commit was made."""
    out = _git(folder, "log", "-1", "--format=%ct", commit)
    return int(out) if out else None


def tracked(folder: str, pattern: str = "*.py") -> list[str]:
    return (_git(folder, "ls-files", pattern) or "").splitlines()


def changed(folder: str, since: str, pattern: str = "*.py") -> list[str]:
    """Tracked files that differ from a commit, uncommitted changes included."""
    out = _git(folder, "diff", "--name-only", "--relative", since, "--", pattern)
    return sorted(set((out or "").splitlines()) & set(tracked(folder, pattern)))
