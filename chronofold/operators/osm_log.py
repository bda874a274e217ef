"""What a repository remembers of map imports: a log, and the filters and mappings used."""

from __future__ import annotations

import json
import os

from ..repo import Repo
from .osm import Rule


def folder(repo: Repo, *parts: str) -> str:
    """The folder of map files of a repository, or a place below it."""
    at = os.path.join(repo.path, "osm", *parts)
    os.makedirs(os.path.dirname(at) if parts else at, exist_ok=True)
    return at


def logfile(repo: Repo) -> str:
    return folder(repo, "log.jsonl")


def add_entry(repo: Repo, tree: str, changeset: int | None, timestamp: str | None) -> dict:
    """Remember an import: the tree it made and the newest changeset and time in it."""
    entry = {"tree": tree, "changeset": changeset, "timestamp": timestamp}
    with open(logfile(repo), "a") as f:
        f.write(json.dumps(entry) + "\n")
    return entry


def entries(repo: Repo) -> list[dict]:
    """All imports, oldest first."""
    try:
        with open(logfile(repo)) as f:
            return [json.loads(x) for x in f]
    except FileNotFoundError:
        return []


def write_filter(repo: Repo, entry: dict, text: str) -> None:
    """Keep the filter an import was made with."""
    with open(folder(repo, "filters", entry["tree"]), "w") as f:
        f.write(text)


def read_filter(repo: Repo, entry: dict) -> str | None:
    try:
        with open(folder(repo, "filters", entry["tree"])) as f:
            return f.read()
    except FileNotFoundError:
        return None


def write_mapping(repo: Repo, path: str, text: str, tree: str) -> None:
    """Keep the mapping that made the features of ``path``, and the raw data's tree it was applied to."""
    with open(folder(repo, "mappings", path.replace("/", "%2F")), "w") as f:
        json.dump({"tree": tree, "mapping": text}, f)


def read_mapping_entry(repo: Repo, path: str) -> dict | None:
    """``tree`` and ``mapping`` that were kept for a path."""
    try:
        with open(folder(repo, "mappings", path.replace("/", "%2F"))) as f:
            return json.load(f)
    except FileNotFoundError:
        return None


def read_mapping(repo: Repo, path: str) -> list[Rule] | None:
    entry = read_mapping_entry(repo, path)
    return entry and Rule.all_of(entry["mapping"])
