"""What a handed-in client answers: get(path, params) gives (status, headers, body text)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

Get = Callable[[str, dict], tuple[int, dict, str]]


class Failed(Exception):
    """A request failed; the message shows the status and the start of the body."""


class Snooze(Exception):
    """The service wants fewer requests: try the job again after `seconds`."""

    def __init__(self, seconds: int):
        super().__init__(f"rate limited, again in {seconds} s")
        self.seconds = seconds


def text(answer: tuple[int, dict, str]) -> str:
    """The body of a good answer; Snooze for 429, Failed for all else."""
    status, headers, body_ = answer
    if status == 429:
        after = {k.lower(): v for k, v in headers.items()}.get("retry-after")
        raise Snooze(int(after) if after is not None and re.fullmatch(r"\+?0*[1-9]\d*", str(after).strip()) else 60)
    if not 200 <= status < 300:
        raise Failed(f"{status}: {(body_ or '')[:200]}")
    return body_


def body(answer: tuple[int, dict, str]) -> dict:
    """The JSON object of a good answer."""
    try:
        out = json.loads(text(answer))
    except ValueError:
        raise Failed("the answer isn't JSON") from None
    if not isinstance(out, dict):
        raise Failed("the answer isn't an object")
    return out
