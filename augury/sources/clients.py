"""HTTP and JSON-RPC clients for the paged sources; all addresses are given by the caller."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

from augury.sources.paged import Retry, TooLarge, with_retries

# Fixed value: seconds that one request may take.
TIMEOUT = 30.0


def request(url: str, body: bytes | None = None, headers: Mapping[str, str] | None = None, timeout: float = TIMEOUT) -> Any:
    """The JSON of one reply.  No connection, a time-out and any status but success raise :class:`Retry`, which knows the status."""
    call = urllib.request.Request(url, data=body, headers={"Accept": "application/json", **(headers or {})})
    try:
        with urllib.request.urlopen(call, timeout=timeout) as reply:  # noqa: S310
            return json.loads(reply.read())
    except urllib.error.HTTPError as e:
        raise Retry(f"{url}: {e.code}", e.code) from e
    except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
        raise Retry(f"{url}: {e}") from e


@dataclass(frozen=True)
class Rest:
    """A REST endpoint with retries; safe to send to tasks."""

    base: str
    timeout: float = TIMEOUT

    def get(self, path: str, **params: Any) -> Any:
        """Parameters that are None are left out."""
        asked = urllib.parse.urlencode({k: v for k, v in params.items() if v is not None})
        return with_retries(lambda: request(f"{self.base.rstrip('/')}/{path.lstrip('/')}{'?' + asked if asked else ''}", timeout=self.timeout))

    def cursor_pages(self, path: str, field_name: str, limit: int, cursor: str | None = None, **params: Any) -> Iterator[tuple[list[dict], str | None]]:
        """Pages of ``field_name`` with the cursor after each, from ``cursor`` on; ends where no cursor comes."""
        while True:
            reply = self.get(path, limit=limit, cursor=cursor, **params)
            cursor = reply.get("cursor") or None
            yield reply.get(field_name) or [], cursor
            if cursor is None:
                return

    def markets(self, limit: int = 1000, cursor: str | None = None, min_close: int | None = None, max_close: int | None = None) -> Iterator[tuple[list[dict], str | None]]:
        """Pages of markets that close between two Unix times."""
        return self.cursor_pages("markets", "markets", limit, cursor, min_close_ts=min_close, max_close_ts=max_close)

    def market(self, ticker: str) -> dict:
        return self.get(f"markets/{urllib.parse.quote(ticker, safe='')}")["market"]

    def trades(self, ticker: str, limit: int = 1000, since: int | None = None, until: int | None = None) -> Iterator[dict]:
        """All trades of a ticker between two Unix times."""
        for page, _ in self.cursor_pages("markets/trades", "trades", limit, ticker=ticker, min_ts=since, max_ts=until):
            yield from page

    def recent_trades(self, limit: int = 100) -> list[dict]:
        return self.get("markets/trades", limit=limit).get("trades") or []

    def offset_page(self, path: str, offset: int, limit: int = 500, field_name: str = "data", **params: Any) -> list[dict]:
        """One page by offset; the reply is a list or an object that holds one."""
        reply = self.get(path, limit=limit, offset=offset, **params)
        return reply if isinstance(reply, list) else list(reply.get(field_name) or [])


@dataclass(frozen=True)
class Rpc:
    """A JSON-RPC node; safe to send to tasks."""

    url: str
    timeout: float = TIMEOUT
    #: Words in an error that say that a range holds too many events.
    too_large: tuple[str, ...] = field(default=("too large", "more than", "limit exceeded", "range"))

    def call(self, method: str, *params: Any) -> Any:
        body = json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": list(params)}).encode()
        reply = with_retries(lambda: request(self.url, body, {"Content-Type": "application/json"}, self.timeout))
        if "error" in reply:
            text = str(reply["error"].get("message", reply["error"])) if isinstance(reply["error"], dict) else str(reply["error"])
            raise TooLarge(text) if any(w in text.lower() for w in self.too_large) else RuntimeError(text)
        return reply["result"]

    def head(self) -> int:
        return int(self.call("eth_blockNumber"), 16)

    def block_time(self, block: int) -> int:
        return int(self.call("eth_getBlockByNumber", hex(block), False)["timestamp"], 16)

    def logs(self, low: int, high: int, topics: list[Any], address: str | None = None) -> list[tuple]:
        """Raw logs of a range as rows of ``decode.LOG``; a list inside ``topics`` means any of them."""
        asked = {"fromBlock": hex(low), "toBlock": hex(high), "topics": topics, **({"address": address} if address else {})}
        return [
            (int(x["blockNumber"], 16), x["transactionHash"], int(x["logIndex"], 16), x["address"], list(x["topics"]), x["data"])
            for x in self.call("eth_getLogs", asked)
        ]
