"""Settings of an application, credentials by reference, default names."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any

_secrets: dict[str, Any] = {}


@dataclass(frozen=True)
class AuthEntryReference:
    """Stands for a credential wherever a spec is stored; the credential itself stays in this process."""

    key: str

    def get(self) -> Any:
        return _secrets[self.key]


def add_auth_entry(key: str, value: Any) -> AuthEntryReference:
    if key in _secrets:
        raise KeyError(f"auth entry {key!r} exists")
    _secrets[key] = value
    return AuthEntryReference(key)


def add_transient_auth_entry(value: Any) -> AuthEntryReference:
    key = f"__transient_{len(_secrets)}"
    _secrets[key] = value
    return AuthEntryReference(key)


def ref_auth_entry(key: str) -> AuthEntryReference:
    if key not in _secrets:
        raise KeyError(key)
    return AuthEntryReference(key)


@dataclass(frozen=True)
class Settings:
    """store: the folder of tracking and targets. app_namespace: stands before the names of flows and targets."""

    store: str | None = None
    app_namespace: str = ""
    max_inflight_rows: int | None = 1024
    spark_conf: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_env(cls, prefix: str = "RILLSPARK_") -> Settings:
        rows = os.environ.get(f"{prefix}SOURCE_MAX_INFLIGHT_ROWS")
        return cls(os.environ.get(f"{prefix}STORE"), os.environ.get(f"{prefix}APP_NAMESPACE", ""), int(rows) if rows else 1024)


def full_name(settings: Settings, flow: str) -> str:
    return f"{settings.app_namespace}.{flow}" if settings.app_namespace else flow


def target_name(settings: Settings, flow: str, target: str, between: str = "__") -> str:
    return between.join(filter(None, [settings.app_namespace, flow, target]))
