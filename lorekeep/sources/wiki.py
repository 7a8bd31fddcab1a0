"""A wiki's web interface as a source; the transport is injected, so tests need no network."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from lorekeep.config import Settings

#: get(params) -> (status, headers, body)
Transport = Callable[[dict], tuple[int, dict, dict]]
LONGEST_WAIT_S = 30.0


class WikiClient:
    """Serial requests with spacing and retries. One client is one source partition: crawling in parallel is impolite."""

    def __init__(self, transport: Transport, base_url: str, settings: Settings = Settings(), sleep: Callable[[float], None] = time.sleep):
        self.transport, self.base_url, self.settings, self.sleep = transport, base_url, settings, sleep
        self.last = float("-inf")

    def get(self, **params) -> dict:
        wait = 1.0
        for attempt in range(self.settings.request_attempts):
            gap = self.settings.request_spacing_s - (time.monotonic() - self.last)
            if gap > 0:
                self.sleep(gap)
            self.last = time.monotonic()
            try:
                status, headers, body = self.transport({"format": "json", "formatversion": 2, "maxlag": self.settings.request_maxlag, **params})
            except OSError:  # the network failed: as if the server were busy
                status, headers, body = 503, {}, {}
            error = body.get("error", {}).get("code") if status == 200 else None
            if status == 200 and error is None:
                return body
            if error not in (None, "maxlag"):
                raise RuntimeError(f"the wiki refused the request: {error}")
            if status not in (200, 429, 500, 502, 503, 504):
                raise RuntimeError(f"the wiki answered with status {status}")
            if attempt + 1 < self.settings.request_attempts:
                self.sleep(min(LONGEST_WAIT_S, float(headers.get("Retry-After", wait))))
                wait *= 2
        raise RuntimeError("the wiki did not answer in time")

    def paged(self, **params) -> Iterator[dict]:
        more: dict = {}
        while True:
            body = self.get(**params, **more)
            yield body
            if not (more := body.get("continue", {})):
                return

    def list_pages(self, ns: int) -> list[dict]:
        return [p for b in self.paged(action="query", list="allpages", apnamespace=ns, apfilterredir="nonredirects", aplimit="max") for p in b["query"]["allpages"]]

    def fetch(self, titles: list[str]) -> Iterator[dict]:
        """Raw pages, in requests of so many titles; missing and empty pages are left out."""
        n = self.settings.titles_per_request
        for i in range(0, len(titles), n):
            body = self.get(action="query", titles="|".join(titles[i : i + n]), prop="revisions|categories|info", rvprop="ids|timestamp|content", rvslots="main", clshow="!hidden", cllimit="max", inprop="url")
            for p in body.get("query", {}).get("pages", []):
                rev = (p.get("revisions") or [{}])[0]
                text = rev.get("slots", {}).get("main", {}).get("content", "")
                if not p.get("missing") and text:
                    url = p.get("fullurl") or f"{self.base_url}/{p['title'].replace(' ', '_')}"
                    yield {"pageid": p["pageid"], "ns": p["ns"], "title": p["title"], "url": url, "revid": rev.get("revid"), "timestamp": rev.get("timestamp"), "categories": [c["title"] for c in p.get("categories", [])], "wikitext": text}

    def redirects(self, ns: int = 0) -> dict[str, str]:
        """alias -> target, for redirects with exactly one link."""
        pages = (p for b in self.paged(action="query", generator="allpages", gapnamespace=ns, gapfilterredir="redirects", gaplimit="max", prop="links", pllimit="max") for p in b.get("query", {}).get("pages", []))
        return {p["title"]: p["links"][0]["title"] for p in pages if len(p.get("links", [])) == 1}
