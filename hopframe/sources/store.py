"""Stored mappings: several by id, one active, kept as JSON files."""

from __future__ import annotations

import json
import re
import time
import uuid
from pathlib import Path

from hopframe.errors import QueryError
from hopframe.plans.mapping import GraphMapping


class MappingStore:
    """Mappings by id. With a folder, each is a file ``<id>.json`` and ``.active-mapping`` names the active one."""

    def __init__(self, folder: str | Path | None = None):
        self.folder, self.items, self.active_id = Path(folder) if folder else None, {}, None
        if self.folder:
            self.folder.mkdir(parents=True, exist_ok=True)
            for f in sorted(self.folder.glob("*.json"), key=lambda p: p.stat().st_mtime):
                d = json.loads(f.read_text())
                self.items[d["id"]] = d
            mark = self.folder / ".active-mapping"
            self.active_id = mark.read_text().strip() if mark.exists() else None
            if self.active_id not in self.items:
                self.active_id = next(reversed(self.items), None)

    def put(self, told: str | dict, id: str | None = None, name: str | None = None, activate: bool = True) -> str:
        """Validate and keep a mapping; returns its id."""
        mapping = GraphMapping.parse(told)
        id = id or uuid.uuid4().hex[:12]
        if not re.fullmatch(r"[\w.-]{1,100}", id) or id.startswith("."):
            raise QueryError("a mapping's id has letters, digits, - _ and . only")
        self.items.pop(id, None)
        self.items[id] = {"id": id, "name": name or id, "created": time.time(), "mapping": dict(mapping.source)}
        if self.folder:
            (self.folder / f"{id}.json").write_text(json.dumps(self.items[id], indent=1))
        if activate or self.active_id is None:
            self.set_active(id)
        return id

    def set_active(self, id: str) -> None:
        if id not in self.items:
            raise QueryError(f"no mapping {id!r} is stored")
        self._activate(id)

    def _activate(self, id: str | None) -> None:
        self.active_id = id
        if self.folder:
            mark = self.folder / ".active-mapping"
            mark.write_text(id) if id else mark.unlink(missing_ok=True)

    def delete(self, id: str) -> None:
        """Remove a mapping; if it was active, the newest one left becomes so."""
        if self.items.pop(id, None) is None:
            raise QueryError(f"no mapping {id!r} is stored")
        if self.folder:
            (self.folder / f"{id}.json").unlink(missing_ok=True)
        if self.active_id == id:
            self._activate(next(reversed(self.items), None))

    def get(self, id: str | None = None) -> GraphMapping:
        id = id or self.active_id
        if id not in self.items:
            raise QueryError("no mapping is active" if id is None else f"no mapping {id!r} is stored")
        return GraphMapping.parse(self.items[id]["mapping"])

    def list(self) -> list[dict]:
        return [{k: d[k] for k in ("id", "name", "created")} | {"active": i == self.active_id} for i, d in self.items.items()]

    def status(self) -> dict:
        return {"active": self.active_id, "stored": len(self.items)}
