"""Which project a reference means.  The list of projects is configuration: a few rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple


class Project(NamedTuple):
    project_id: str
    name: str
    guid: str | None = None


def by_reference(projects: Sequence[Project], reference: str | None) -> Project:
    """By short id, then by GUID, then by display name in any case; the first one that fits."""
    wanted = (reference or "").strip()
    if not wanted:
        raise ValueError("a project is required")
    tests: tuple[Callable[[Project], bool], ...] = (lambda p: p.project_id == wanted, lambda p: p.guid == wanted, lambda p: p.name.lower() == wanted.lower())
    for fits in tests:
        for p in projects:
            if fits(p):
                return p
    raise LookupError(f"no project {wanted!r} among {[p.project_id for p in projects]}")


def by_name(projects: Sequence[Project], project_id: str | None = None, name: str | None = None) -> Project:
    """By id in any case; or by the whole name, by the name in any case, by a part of it, the first of these that one project alone fits; with neither, the only project there is."""
    if project_id:
        found = [p for p in projects if p.project_id.lower() == project_id.lower()]
        if found:
            return found[0]
        raise LookupError(f"no project has the id {project_id!r}")
    if name:
        low = name.lower()
        tests: tuple[Callable[[Project], bool], ...] = (lambda p: p.name == name, lambda p: p.name.lower() == low, lambda p: low in p.name.lower())
    else:
        tests = (lambda p: True,)
    for fits in tests:
        found = [p for p in projects if fits(p)]
        if len(found) == 1:
            return found[0]
    raise LookupError(f"{name or 'no name'!r} does not name one project of {[(p.name, p.project_id) for p in projects]}")
