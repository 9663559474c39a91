"""References to agents: scheme:target[@base-url]. One reference belongs to a run, so reading one is plain Python; a table of
them is read in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame

from plumbline import errors

#: The closed set of schemes, the ports that go without saying, and what a scheme's target is.
SCHEMES = ("openai", "anthropic", "fake", "exec", "tuned")
PORTS = {"http": 80, "https": 443}
TARGETS = {"exec": "command", "tuned": "job"}

_BASE = re.compile(r"@(?=https?://)", re.IGNORECASE)
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


@dataclass(frozen=True)
class AgentRef:
    scheme: str
    target: str
    base_url: str = ""

    def __str__(self) -> str:
        return f"{self.scheme}:{self.target}" + (f"@{self.base_url}" if self.base_url else "")


def redacted(text: str) -> str:
    return re.sub(r"([A-Za-z][A-Za-z0-9+.-]*:/+).*@", r"\1[redacted]@", text)


def _refuse(text: str, why: str) -> errors.Actionable:
    return errors.INVALID_INPUT(f"agent reference {redacted(text)!r}: {why}", "write scheme:target or scheme:target@base-url")


def parse(text: str) -> AgentRef:
    ref = text.strip()
    if not ref:
        raise _refuse(text, "empty")
    if _CONTROL.search(ref):
        raise _refuse(text, "control characters")
    if re.match(r"https?:/", ref, re.IGNORECASE):
        raise _refuse(text, "a bare URL names no model")
    scheme, colon, rest = ref.partition(":")
    if not colon:
        raise _refuse(text, "no scheme")
    scheme = scheme.strip().lower()
    if scheme not in SCHEMES:
        raise _refuse(text, f"unknown scheme; known are {', '.join(sorted(SCHEMES))}")
    parts = _BASE.split(rest, maxsplit=1)
    target, base = parts[0].strip(), parts[1].strip() if len(parts) > 1 else ""
    if not target and scheme != "fake":
        raise _refuse(text, f"no {TARGETS.get(scheme, 'model')}")
    if ":/" in target or target.count("@") > 1:
        raise _refuse(text, "the target looks like a URL")
    return AgentRef(scheme, target, canonical_url(base, text) if len(parts) > 1 else "")


def canonical_url(url: str, whole: str = "") -> str:
    """Lower case for scheme and host, no default port, no slash at the end; the same again if given again."""
    try:
        parts = urlsplit(url)
        port = parts.port
    except ValueError as error:
        raise _refuse(whole or url, "the base URL cannot be read") from error
    if not parts.hostname:
        raise _refuse(whole or url, "the base URL has no host")
    if parts.username is not None or parts.password is not None or "@" in parts.netloc:
        raise _refuse(whole or url, "the base URL carries credentials")
    if "?" in url or "#" in url:
        raise _refuse(whole or url, "the base URL has a query or fragment")
    host = f"[{parts.hostname}]" if ":" in parts.hostname else parts.hostname
    shown = f":{port}" if port is not None and port != PORTS[parts.scheme.lower()] else ""
    return f"{parts.scheme.lower()}://{host.lower()}{shown}{parts.path.rstrip('/')}"


def parse_all(rows: DataFrame, key: str, ref: Column) -> DataFrame:
    """key, scheme, target, base_url and refused for each row; a null reference is an empty one. What is refused has no parts."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch["ref"]:
                try:
                    x = parse(text or "")
                    found.append((x.scheme, x.target, x.base_url, False))
                except errors.Actionable:
                    found.append((None, None, None, True))
            yield pd.DataFrame(found, columns=["scheme", "target", "base_url", "refused"]).assign(**{key: batch[key]})[[key, "scheme", "target", "base_url", "refused"]]

    given = rows.select(key, ref.alias("ref"))
    return given.mapInPandas(read, f"`{key}` {given.schema[key].dataType.simpleString()}, scheme string, target string, base_url string, refused boolean")
