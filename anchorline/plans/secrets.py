"""Tokens ${NAME} and ${env:NAME} in configurations, filled from the environment."""

from __future__ import annotations

import os
import re

TOKEN = re.compile(r"\$\{(?:env:)?([A-Za-z_]\w*)\}")


class SecretResolutionError(ValueError):
    """A token names a variable that is not set."""

    def __init__(self, var_name: str):
        self.var_name = var_name
        super().__init__(f"Environment variable {var_name!r} is not set")


def resolve_secrets(value: object) -> object:
    """`value` with all tokens in its texts filled, through dicts and lists; other values pass."""
    if isinstance(value, str):

        def fill(m: re.Match) -> str:
            if m[1] not in os.environ:
                raise SecretResolutionError(m[1])
            return os.environ[m[1]]

        return TOKEN.sub(fill, value)
    if isinstance(value, dict):
        return {k: resolve_secrets(v) for k, v in value.items()}
    if isinstance(value, list):
        return [resolve_secrets(v) for v in value]
    return value


def has_unresolved_tokens(value: object) -> bool:
    """Whether any text in `value` holds a token."""
    if isinstance(value, str):
        return TOKEN.search(value) is not None
    if isinstance(value, dict):
        return any(has_unresolved_tokens(v) for v in value.values())
    return isinstance(value, list) and any(has_unresolved_tokens(v) for v in value)
