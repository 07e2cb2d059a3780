"""A polite HTTP client for the portal connector: throttle, timeouts, retries, cookies, addresses."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from http.cookiejar import CookieJar
from urllib.parse import urlencode

from tendril.functions.fixed import AGENT, SITE_INDEX


@dataclass(frozen=True)
class Reply:
    """What a server sent: final address, headers in lower case, body."""

    url: str
    headers: dict[str, str]
    body: bytes

    @property
    def text(self) -> str:
        return self.body.decode("utf-8", "replace")


class Client:
    """Requests of one task to one site, at least `pause` seconds apart."""

    def __init__(self, pause: float = 2.0, agent: str = AGENT, sleep: Callable[[float], None] = time.sleep):
        self.pause, self.sleep, self.last = pause, sleep, -1e9
        self.opener = urllib.request.build_opener(urllib.request.HTTPCookieProcessor(CookieJar()))
        self.opener.addheaders = [("User-Agent", agent)]

    def turn(self) -> None:
        """Waits until the next request may go."""
        left = self.last + self.pause - time.monotonic()
        if left > 0:
            self.sleep(left)
        self.last = time.monotonic()

    def send(self, url: str, data: bytes | None, timeout: float) -> Reply:
        with self.opener.open(urllib.request.Request(url, data), timeout=timeout) as got:
            return Reply(got.geturl(), {k.lower(): v for k, v in got.headers.items()}, got.read())

    def get(self, url: str, tries: int = 3, timeout: float = 30) -> Reply:
        """Waits its turn once, then tries; failures and error statuses wait 2 ** n seconds, the last one raises."""
        self.turn()
        return patient(lambda: self.send(url, None, timeout), tries, self.sleep)

    def post(self, url: str, form: dict[str, str], tries: int = 4, timeout: float = 120) -> Reply:
        """Like get, but every try waits its turn: postbacks are dear to the server."""
        data = urlencode(form).encode()

        def once() -> Reply:
            self.turn()
            return self.send(url, data, timeout)

        return patient(once, tries, self.sleep)


def patient(call, tries: int = 3, sleep: Callable[[float], None] = time.sleep):
    """The call's result; the n-th failure waits 2 ** n seconds, and the last one raises."""
    for n in range(1, tries + 1):
        try:
            return call()
        except OSError:  # errors of the network and of HTTP statuses are of this kind
            if n == tries:
                raise
            sleep(2.0**n)


def page_url(page: str, flags: list[str] | None = None, **params: str) -> str:
    """The address of a portal page: encoded parameters, then bare flags."""
    return "&".join([f"{SITE_INDEX}?{urlencode({'page': page, **params})}", *(flags or [])])
