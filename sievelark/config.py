"""Settings of a digest: defaults, a mapping, then the environment, each overriding the one before."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

#: Texts that mean no.
NO = {"false", "0", "no", "off"}
PREFIX = "SIEVELARK_"


@dataclass(frozen=True)
class Settings:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    coarse_threshold: int = 50
    coarse_keep: int = 20
    keep: int = 5
    batch_rows: int = 10
    memory_ttl_days: int = 30
    memory_cap: int = 5000
    blog_days: int = 7
    posts_per_feed: int = 5
    lookup_budget: int = 25
    with_papers: bool = True
    with_blogs: bool = True
    feedback_base: str = ""
    secret: str = field(default="", repr=False)


def coerced(kind: str, text: str, old: object) -> object:
    """A text as the kind of a field; a number that is none leaves the old value."""
    if kind == "bool":
        return text.strip().lower() not in NO
    if kind == "int":
        try:
            return int(text)
        except ValueError:
            return old
    if kind.startswith("tuple"):
        return tuple(x.strip() for x in text.split(",") if x.strip())
    return text


def load(values: Mapping[str, object] | None = None, env: Mapping[str, str] | None = None) -> Settings:
    """Settings from a mapping (unknown names are ignored) and SIEVELARK_<NAME> variables."""
    env = os.environ if env is None else env
    out = Settings()
    known = {f.name: str(f.type) for f in fields(Settings)}
    given = {k: (tuple(v) if isinstance(v, list) else v) for k, v in (values or {}).items() if k in known}
    out = replace(out, **given)
    named = {k: coerced(t, env[PREFIX + k.upper()], getattr(out, k)) for k, t in known.items() if PREFIX + k.upper() in env}
    return replace(out, **named)
