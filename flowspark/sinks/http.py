"""Sending messages to an HTTP endpoint that options describe."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable

from .deliver import Send

Opener = Callable[..., object]

# What an HTTP output without these options does.
METHOD, TIMEOUT, TRIES = "POST", 30, 1


def http_sender(url: str, *, method: str = METHOD, timeout: float = TIMEOUT, opener: Opener | None = None) -> Send:
    """A ``send(body, headers) -> status`` for ``deliver``. A status that means failure is returned, not raised; what keeps a
    request from being answered is raised. ``opener(request, timeout=...)`` stands for ``urllib.request.urlopen``."""
    def send(body: bytes, headers: dict[str, str]) -> int:
        request = urllib.request.Request(url, data=body, headers=headers, method=method)
        try:
            with (opener or urllib.request.urlopen)(request, timeout=timeout) as answer:
                return answer.status
        except urllib.error.HTTPError as refused:
            return refused.code

    return send


def http_options(options: dict) -> dict:
    """Arguments of ``deliver`` from the options ``url``, ``method``, ``timeout`` (seconds), ``retries`` (tries of one delivery)
    and ``headers`` of an HTTP output; ``opener`` replaces the way requests are opened."""
    if not options.get("url"):
        raise ValueError("missing option: url")
    timeout, tries = options.get("timeout", TIMEOUT), options.get("retries", TRIES)
    if not timeout > 0 or not tries >= 1:
        raise ValueError("timeout and retries must be positive")
    return {"send": http_sender(options["url"], method=options.get("method") or METHOD, timeout=timeout,
                                opener=options.get("opener")),
            "attempts": int(tries), "headers": dict(options.get("headers") or {})}
