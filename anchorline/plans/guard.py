"""Who may run which pipeline. Guards fail closed."""

from __future__ import annotations

import os
from collections.abc import Callable


class AccessDeniedError(PermissionError):
    def __init__(self, pipeline_name: str, action: str = "execute", reason: str = ""):
        self.pipeline_name, self.action, self.reason = pipeline_name, action, reason
        super().__init__(f"Access denied: {action} {pipeline_name!r}" + (f" ({reason})" if reason else ""))


class PipelineGuard:
    """Allows what `role_checker(pipeline, action)` says is true; an error in it denies."""

    def __init__(self, role_checker: Callable[[str, str], bool] | None = None):
        self.role_checker = role_checker

    def allows(self, pipeline: str, action: str) -> tuple[bool, str]:
        if self.role_checker is None:
            return False, "no role checker"
        return bool(self.role_checker(pipeline, action)), "role checker refused"

    def check(self, pipeline: str, action: str = "execute") -> None:
        try:
            ok, reason = self.allows(pipeline, action)
        except Exception as e:
            raise AccessDeniedError(pipeline, action, f"guard raised {type(e).__name__}: {e}") from e
        if not ok:
            raise AccessDeniedError(pipeline, action, reason)


class AllowAllGuard(PipelineGuard):
    def allows(self, pipeline: str, action: str) -> tuple[bool, str]:
        return True, ""


class EnvRoleGuard(PipelineGuard):
    """Allows a role (from one variable) that is in a comma-separated list (from another); denies if either is unset."""

    def __init__(self, allowed_roles_env: str = "PIPELINE_ALLOWED_ROLES", user_role_env: str = "PIPELINE_USER_ROLE"):
        super().__init__()
        self.allowed_roles_env, self.user_role_env = allowed_roles_env, user_role_env

    def allows(self, pipeline: str, action: str) -> tuple[bool, str]:
        allowed = {r.strip() for r in os.environ.get(self.allowed_roles_env, "").split(",") if r.strip()}
        role = os.environ.get(self.user_role_env, "").strip()
        if not allowed or not role:
            return False, f"{self.allowed_roles_env} or {self.user_role_env} is not set"
        return role in allowed, f"role {role!r} is not allowed"
