"""Roles, audit trail and column masking."""

from __future__ import annotations

import datetime as dt
import json
from collections import Counter
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERMISSIONS = ("view", "edit", "approve", "deploy", "manage_users", "view_sensitive")
#: Role -> permissions (fixed values).
ROLES = {
    "viewer": {"view"},
    "editor": {"view", "edit"},
    "approver": {"view", "edit", "approve", "view_sensitive"},
    "deployer": {"view", "deploy"},
    "admin": {"view", "edit", "approve", "deploy", "manage_users", "view_sensitive"},
}


class AccessDenied(PermissionError):
    pass


@dataclass
class AuditEvent:
    actor: str
    role: str
    action: str
    resource: str = ""
    change_detail: dict[str, str] = field(default_factory=dict)
    success: bool = True
    denial_reason: str | None = None
    timestamp: str = field(default_factory=lambda: dt.datetime.now(dt.timezone.utc).isoformat())


class AuditLog:
    """Events in memory and, with a path, appended to a file of one JSON object per line."""

    def __init__(self, path: str | None = None):
        self.path, self.events = Path(path) if path else None, []
        if self.path and self.path.exists():
            for line in self.path.read_text(encoding="utf-8").splitlines():
                try:
                    self.events.append(AuditEvent(**json.loads(line)))
                except (ValueError, TypeError):
                    continue

    def log(self, actor: str, role: str, action: str, resource: str = "", success: bool = True, denial_reason: str | None = None, **detail) -> AuditEvent:
        e = AuditEvent(actor, role, action, resource, {k: str(v) for k, v in detail.items()}, success, denial_reason)
        self.events.append(e)
        if self.path:
            self.path.parent.mkdir(parents=True, exist_ok=True)
            with self.path.open("a", encoding="utf-8") as f:
                f.write(json.dumps(asdict(e)) + "\n")
        return e

    def find(self, actor: str | None = None, action: str | None = None, success: bool | None = None) -> list[AuditEvent]:
        return [e for e in self.events if actor in (None, e.actor) and action in (None, e.action) and success in (None, e.success)]

    def summary(self) -> dict:
        return {"total": len(self.events), "by_action": dict(Counter(e.action for e in self.events)), "failed": sum(not e.success for e in self.events), "actors": len({e.actor for e in self.events})}


def audit_summary(events: DataFrame) -> DataFrame:
    """action, n_events, n_failed, n_actors of an audit table."""
    return events.groupBy("action").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(~F.col("success")).alias("n_failed"), F.count_distinct("actor").alias("n_actors"))


class AccessControl:
    """Users' roles. The first administrator is given when it's made; every denial is logged."""

    def __init__(self, admin: str, audit: AuditLog | None = None, path: str | None = None):
        self._roles = {admin: "admin"}
        self.audit = audit or AuditLog()
        self.path = Path(path) if path else None
        if self.path and self.path.exists():
            self._roles = json.loads(self.path.read_text(encoding="utf-8"))

    def role(self, user: str) -> str:
        return self._roles.get(user, "viewer")

    def can(self, user: str, permission: str) -> bool:
        if permission not in PERMISSIONS:
            raise ValueError(f"no permission {permission!r}")
        return permission in ROLES[self.role(user)]

    def require(self, user: str, permission: str, resource: str = "") -> None:
        if not self.can(user, permission):
            reason = f"{user} ({self.role(user)}) lacks {permission}"
            self.audit.log(user, self.role(user), "access_denied", resource, False, reason, permission=permission)
            raise AccessDenied(reason)

    def assign(self, by: str, user: str, role: str) -> None:
        self.require(by, "manage_users", f"user:{user}")
        if role not in ROLES:
            raise ValueError(f"no role {role!r}; known are {sorted(ROLES)}")
        admins = [u for u, r in self._roles.items() if r == "admin"]
        if admins == [user] and role != "admin":
            raise ValueError("the last administrator stays one")
        self._roles[user] = role
        if self.path:
            self.path.parent.mkdir(parents=True, exist_ok=True)
            self.path.write_text(json.dumps(self._roles, indent=1), encoding="utf-8")
        self.audit.log(by, self.role(by), "assign_role", f"user:{user}", new_role=role)

    def summary(self) -> dict:
        return {"users": dict(sorted(self._roles.items())), "roles": {r: sorted(p) for r, p in ROLES.items()}}


class ColumnSecurity:
    """Which fields are sensitive, and frames without them for those who may not see them.

    Who may is who has the permission `view_sensitive`, or with `roles` whose role is among these.
    """

    def __init__(self, access: AccessControl, sensitive: dict[str, set[str]] | None = None, roles: set[str] | None = None, path: str | None = None):
        self.access, self._marked, self.roles = access, {k: set(v) for k, v in (sensitive or {}).items()}, roles
        self.path = Path(path) if path else None
        if self.path and self.path.exists():
            self._marked = {k: set(v) for k, v in json.loads(self.path.read_text(encoding="utf-8")).items()}

    def mark(self, by: str, schema: str, name: str, sensitive: bool = True) -> None:
        self.access.require(by, "manage_users", f"{schema}.{name}")
        marked = self._marked.setdefault(schema, set())
        (marked.add if sensitive else marked.discard)(name)
        if self.path:
            self.path.parent.mkdir(parents=True, exist_ok=True)
            self.path.write_text(json.dumps(self.summary(), indent=1), encoding="utf-8")

    def hidden(self, user: str, schema: str) -> list[str]:
        may = self.access.can(user, "view_sensitive") if self.roles is None else self.access.role(user) in self.roles
        return [] if may else sorted(self._marked.get(schema, ()))

    def visibility(self, user: str, schema: str, fields: list[str]) -> dict[str, bool]:
        hidden = self.hidden(user, schema)
        return {f: f not in hidden for f in fields}

    def view(self, df: DataFrame, user: str, schema: str, remove: bool = False) -> DataFrame:
        """`df` with hidden fields null, or without them; who sees sensitive ones is logged."""
        hidden = [c for c in self.hidden(user, schema) if c in df.columns]
        if not hidden and self._marked.get(schema):
            self.access.audit.log(user, self.access.role(user), "view_sensitive", schema)
        return remove_columns(df, hidden) if remove else nullify_columns(df, hidden)

    def summary(self) -> dict[str, list[str]]:
        return {k: sorted(v) for k, v in sorted(self._marked.items()) if v}


def nullify_columns(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in columns if c in df.columns}) if columns else df


def remove_columns(df: DataFrame, columns) -> DataFrame:
    return df.drop(*columns)
