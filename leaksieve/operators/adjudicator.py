"""A chat service that is asked whether ambiguous findings are leaks: addresses, the notice, and requests from tasks.

At most three findings of a unit are asked about. Requests go out from the tasks that hold them, some at a time,
each with a time limit; one that fails in any way is no answer, and a task whose service doesn't answer again
and again stops asking. So a dead service costs time in bounds, and no job. The answers are staged before
anything uses them: a lost executor doesn't ask twice.
"""

from __future__ import annotations

import ipaddress
import json
import os
import time
import urllib.request
import warnings
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .detect import MATCH_ORD
from .route import KEY, routed, to_adjudicate

# The route that chat services answer at, and an older one that may stand in its place.
ROUTE, OLD_ROUTE = "/v1/chat/completions", "/completion"
ROLE = "You judge whether a piece of code gives away a secret or confidential content. Answer with one word, leak or clean."
LABELS = f"unit_id string, file string, line_no int, rule_id string, phase int, match_ord {MATCH_ORD}, label string"
_told: set[str] = set()


def completions_url(endpoint: str) -> str:
    """Where requests go: a full address as it is; else the route behind what is given, less slashes and the old route at its end."""
    if endpoint.endswith(ROUTE):
        return endpoint
    base = endpoint.rstrip("/")
    while base.endswith(OLD_ROUTE):
        base = base.removesuffix(OLD_ROUTE)
    return base + ROUTE


def completions_url_of(endpoint: Column) -> Column:
    """The same of a column."""
    base = F.regexp_replace(F.regexp_replace(endpoint, "/+$", ""), f"(?:{OLD_ROUTE})+$", "")
    return F.when(endpoint.endswith(ROUTE), endpoint).otherwise(F.concat(base, F.lit(ROUTE)))


def host_of(endpoint: str) -> str:
    """An address's host; one in brackets stays in them."""
    host = endpoint.partition("://")[2] or endpoint
    host = host.replace("?", "/").partition("/")[0].rpartition("@")[2]
    return host[: host.index("]") + 1] if "]" in host else host.rpartition(":")[0] or host


def is_remote(endpoint: str) -> bool:
    host = host_of(endpoint).strip().lstrip("[").rstrip("]")
    try:
        return not ipaddress.ip_address(host).is_loopback
    except ValueError:
        return host.lower() != "localhost"


@dataclass(frozen=True)
class Service:
    """A chat service. The key is taken from the environment of the driver by its name, never from a file."""

    endpoint: str
    timeout: float = 2.0
    model: str = ""
    key_name: str = ""
    #: Requests of a task that are under way at once, and failures in a row after which a task stops asking.
    at_once: int = 4
    patience: int = 20

    def key(self) -> str:
        return os.environ.get(self.key_name.strip(), "").strip() if self.key_name.strip() else ""

    def notice(self) -> str | None:
        """What a user is told before snippets leave this machine."""
        return f"code snippets are sent to {host_of(self.endpoint)}: this is no local scan" if is_remote(self.endpoint) else None


def tell_once(service: Service) -> None:
    """The notice, once for each host while the driver lives."""
    text = service.notice()
    if text and text not in _told:
        _told.add(text)
        warnings.warn(text, stacklevel=3)


def label_of(answer: str) -> str | None:
    low = answer.strip().lower()
    return "leak" if low.startswith("leak") else "clean" if low.startswith("clean") else None


def ask(service: Service, key: str, snippet: str) -> str | None:
    """The service's label of a snippet; None where it gives none in time."""
    body = {"messages": [{"role": "system", "content": ROLE}, {"role": "user", "content": f"Judge this:\n```\n{snippet}\n```"}], "temperature": 0.0, "max_tokens": 500}
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(completions_url(service.endpoint), json.dumps(body | ({"model": service.model.strip()} if service.model.strip() else {})).encode(), headers)
    opener = urllib.request.build_opener(*([] if is_remote(service.endpoint) else [urllib.request.ProxyHandler({})]))
    ends = time.monotonic() + service.timeout
    try:
        with opener.open(request, timeout=service.timeout) as reply:
            data = b""
            while part := reply.read1(1 << 16):
                data += part
                if time.monotonic() > ends or len(data) > 1 << 22:
                    return None
        return label_of(json.loads(data)["choices"][0]["message"]["content"])
    except (OSError, ValueError, LookupError, TypeError, AttributeError):  # unreachable, late, or something else than an answer
        return None


def labels_of(findings: DataFrame, service: Service) -> DataFrame:
    """KEY and label of the findings that are to be adjudicated; a null label is no answer."""
    tell_once(service)
    key = service.key()

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = 0
        with ThreadPoolExecutor(service.at_once) as pool:
            for pdf in batches:
                snippets = pdf["snippet"].fillna("").tolist()
                answers: list[str | None] = []
                for k in range(0, len(snippets), service.at_once):
                    some = snippets[k : k + service.at_once]
                    got = list(pool.map(lambda s: ask(service, key, s), some)) if failed < service.patience else [None] * len(some)
                    answers += got
                    failed = 0 if any(got) else failed + len(got)
                yield pdf[list(KEY)].assign(label=pd.Series(answers, dtype=object, index=pdf.index))

    return to_adjudicate(findings).select(*KEY, "snippet").mapInPandas(label, LABELS)


def adjudicated(findings: DataFrame, service: Service, fallback: str = "report") -> DataFrame:
    """The findings to report, with the service's answers."""
    return routed(findings, staged(labels_of(findings, service), "labels"), fallback)
