"""What each role may see and filter on."""

from __future__ import annotations

from forecourt import schema


def resolve_role(role: str) -> str:
    """Declared spelling of a role, whatever the case; an unknown role is an error, never "no filter"."""
    for known in schema.ROLES:
        if role and role.strip().lower() == known.lower():
            return known
    raise ValueError(f"unknown role: {role!r}")


def may_filter_by_vin(role: str) -> bool:
    return resolve_role(role) != "Public"


def may_filter_by_status(role: str) -> bool:
    return resolve_role(role) in ("Manager", "Owner")


def sees_only_sellable(role: str) -> bool:
    return resolve_role(role) in ("Public", "Salesperson")
