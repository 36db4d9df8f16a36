"""The engine: a current catalog, serialised updates, rollbacks and hooks."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from .operators.diff import field_changes
from .snapshots import GenerationStore, Manifest

Relations = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Publication:
    generation_id: str
    sequence: int
    published: bool


class GenerationCache:
    """Results by generation: what was kept for an older sequence is dropped as soon as a newer one is seen, and everything after a while."""

    def __init__(self, seconds: float = 900.0, clock: Callable[[], float] = time.monotonic):
        self._seconds, self._clock = seconds, clock
        self._lock = threading.Lock()
        self._at: tuple[int, str] | None = None
        self._kept: dict[str, tuple[float, object]] = {}

    def advance(self, sequence: int, generation_id: str) -> bool:
        """Serve a generation from now on; False for one that isn't newer."""
        with self._lock:
            if self._at and sequence <= self._at[0]:
                return False
            self._at, self._kept = (sequence, generation_id), {}
            return True

    def get(self, sequence: int, generation_id: str, key: str) -> object | None:
        with self._lock:
            made, value = self._kept.get(key, (0.0, None))
            if self._at != (sequence, generation_id) or value is None or self._clock() - made >= self._seconds:
                return None
            return value

    def put(self, sequence: int, generation_id: str, key: str, value: object) -> None:
        """Keep a result, unless its generation isn't the one that is served."""
        with self._lock:
            if self._at == (sequence, generation_id):
                self._kept[key] = (self._clock(), value)


class Engine:
    """Serves one generation at a time; every update is one transaction on the store."""

    def __init__(self, store: GenerationStore, seed: Relations | None = None, *, seed_id: str = "seed", verify: Callable[[Manifest, Relations], str | None] | None = None):
        """`verify` looks at a generation made elsewhere and returns what speaks against it."""
        self.store = store
        self._verify = verify
        self.sequence = 1
        self._lock = threading.Lock()
        self._hooks: list[Callable[[Publication], None]] = []
        self._row_hooks: list[tuple[str, tuple[str, ...], Callable[[DataFrame], None]]] = []
        if store.current_id() is None and seed is not None:
            store.commit(seed_id, _now(), seed, None)

    def catalog(self) -> dict[str, DataFrame]:
        """The relations of the current generation."""
        current = self.store.current_id()
        return {} if current is None else {n: self.store.read(n, current) for n in self.store.manifest(current).checksums}

    def on_published(self, hook: Callable[[Publication], None]) -> None:
        self._hooks.append(hook)

    def on_changes(self, relation: str, keys: tuple[str, ...], hook: Callable[[DataFrame], None]) -> None:
        """Call `hook` with the changed rows of a relation after each publication."""
        self._row_hooks.append((relation, keys, hook))

    def update(self, generation_id: str, build: Callable[[Relations], Relations], *, generated_at: str | None = None) -> Publication:
        """Build a candidate from the current relations, commit it and tell the hooks."""
        with self._lock:
            before = self.store.current_id()
            old = self.catalog()
            self.store.commit(generation_id, generated_at or _now(), build(old), before)
            return self._announce(generation_id, before, old)

    def planned(self, build: Callable[[Relations], Relations], keys: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
        """What an update would change, relation by relation, without a commit; relations that are new or gone have all their rows."""
        old = self.catalog()
        new = build(old)
        changes = {}
        for name, by in keys.items():
            sides = [side[name] if name in side else None for side in (old, new)]
            if any(s is not None for s in sides):
                before, after = (s if s is not None else next(x for x in sides if x is not None).limit(0) for s in sides)
                fields = [c for c in after.columns if c not in by and c in before.columns]
                changes[name] = field_changes(before, after, list(by), fields)
        return changes

    def activate(self, manifest: Manifest, relations: Relations) -> Publication:
        """Take over a generation made elsewhere, unless it is older than the current one."""
        problem = self._verify(manifest, relations) if self._verify else None
        if problem:
            raise ValueError(f"{manifest.generation_id} is refused: {problem}")
        with self._lock:
            before = self.store.current_id()
            if before and manifest.generation_id != before and manifest.generated_at < self.store.manifest(before).generated_at:
                return Publication(before, self.sequence, False)
            old = self.catalog()
            self.store.commit(manifest.generation_id, manifest.generated_at, relations, before)
            return self._announce(manifest.generation_id, before, old)

    def rollback(self, generation_id: str) -> Publication:
        """Serve a retained generation again; doing so twice changes nothing."""
        with self._lock:
            before, old = self.store.current_id(), self.catalog()
            self.store.activate(generation_id)
            return self._announce(generation_id, before, old)

    def _announce(self, generation_id: str, before: str | None, old: Relations) -> Publication:
        changed = generation_id != before
        self.sequence += changed
        publication = Publication(generation_id, self.sequence, changed)
        if changed:
            for hook in self._hooks:
                hook(publication)
            new = self.catalog()
            for name, keys, hook in self._row_hooks:
                if name in old and name in new:
                    fields = [c for c in new[name].columns if c not in keys and c in old[name].columns]
                    hook(field_changes(old[name], new[name], keys, fields))
        return publication

    def readiness(self, *, most_age_days: float = 7.0, least_rows: Mapping[str, int] | None = None) -> list[str]:
        """What speaks against serving the current generation."""
        current = self.store.current_id()
        if current is None:
            return ["empty"]
        kept = self.store.manifest(current)
        age = datetime.now(timezone.utc) - datetime.fromisoformat(kept.generated_at)
        problems = ["stale"] if age.total_seconds() > most_age_days * 86_400 else []
        return problems + [f"few {n}" for n, least in (least_rows or {}).items() if kept.rows.get(n, 0) < least]


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()
