"""What stands before the files: whether a remote one is new, pages of an API, deltas, links of a page, dates in free text."""

from __future__ import annotations

import datetime
import json
import os
import re
import time
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

# Names of months by their first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def is_stale(known: dict[str, str], headers: dict[str, str]) -> bool:
    """Whether a remote file must be fetched again, by the headers of a HEAD request against those of the last fetch.

    The first of ETag, Last-Modified and Content-Length that both have decides; a file
    of which nothing can be compared is stale.
    """
    old, new = ({k.lower(): v for k, v in h.items()} for h in (known, headers))
    for name in ("etag", "last-modified", "content-length"):
        if old.get(name) and new.get(name):
            return old[name] != new[name]
    return True


def land_pages(get: Callable[[dict], tuple[int, dict]], folder: str, first: dict | None = None, tries: int = 5, wait: Callable[[float], None] = time.sleep) -> int:
    """Writes the pages of an API into folder as JSON files and returns how many; a later call goes on behind the last page.

    get sends a query and gives (status, body); the body's pagination.last_indexes are
    the next query (keyset pagination), and a page without results or indexes is the
    last. A 429 is tried again after 1, 2, 4 ... seconds. The place is kept in a file
    beside the pages, which is replaced after each of them.
    """
    os.makedirs(folder, exist_ok=True)
    at = os.path.join(folder, "_place.json")
    place = {"page": 0, "query": first or {}}
    if os.path.exists(at):
        with open(at) as f:
            place = json.load(f)
    landed = 0
    while place["query"] is not None:
        for i in range(tries):
            status, body = get(place["query"])
            if status != 429:
                break
            wait(2.0**i)
        if status != 200:
            raise RuntimeError(f"the API answered {status}")
        more = (body.get("pagination") or {}).get("last_indexes")
        if body.get("results"):
            with open(os.path.join(folder, f"page-{place['page']:06d}.json"), "w") as f:
                json.dump(body, f)
            landed += 1
        place = {"page": place["page"] + 1, "query": {**(first or {}), **more} if more and body.get("results") else None}
        with open(at + ".new", "w") as f:
            json.dump(place, f)
        os.replace(at + ".new", at)
    return landed


def delta_files(names: Iterable[str]) -> dict[str, list[str]]:
    """{"insert": [...], "delete": [...]}: the files of a listing that are deltas, in order of their names."""
    found: dict[str, list[str]] = {"insert": [], "delete": []}
    for n in sorted(names):
        m = re.search(r"(?:^|[/_.-])(insert|delete)s?(?:[_.-]|$)", n.lower())
        if m:
            found[m.group(1)].append(n)
    return found


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[tuple[str, str]] = []
        self._href: str | None = None
        self._text: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self._href, self._text = dict(attrs).get("href"), []

    def handle_data(self, data: str) -> None:
        if self._href is not None:
            self._text.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self._href is not None:
            self.found.append((self._href, " ".join(" ".join(self._text).split())))
            self._href = None


def page_links(html: str, base: str, wanted: str = "") -> list[tuple[str, str]]:
    """(address, text) of a page's links whose address or text matches the pattern, each address once."""
    parser = _Links()
    parser.feed(html)
    found: dict[str, str] = {}
    for href, text in parser.found:
        if re.search(wanted, f"{href} {text}", re.I):
            found.setdefault(urljoin(base, href), text)
    return list(found.items())


def dates_in(text: str) -> Iterator[datetime.date]:
    """The dates of a text, in order: "March 3rd, 2026", "3 March 2026", "the 3rd of March, 2026", 3/31/2026 and 2026-03-31."""
    month = r"(?P<{0}>[A-Za-z]{{3,9}})\.?"
    day = r"(?P<{0}>[0-9]{{1,2}})(?:st|nd|rd|th)?"
    forms = "|".join([
        rf"{month.format('m1')}\s+{day.format('d1')},?\s+(?P<y1>[0-9]{{4}})", rf"{day.format('d2')}\s+(?:of\s+)?{month.format('m2')},?\s+(?P<y2>[0-9]{{4}})",
        r"(?P<m3>[0-9]{1,2})/(?P<d3>[0-9]{1,2})/(?P<y3>[0-9]{4})", r"(?P<y4>[0-9]{4})-(?P<m4>[0-9]{2})-(?P<d4>[0-9]{2})",
    ])
    for hit in re.finditer(rf"\b(?:{forms})\b", text):
        i = next(i for i in "1234" if hit[f"y{i}"])
        name = hit[f"m{i}"]
        number = int(name) if name.isdigit() else MONTHS.index(name[:3].lower()) + 1 if name[:3].lower() in MONTHS else 0
        try:
            yield datetime.date(int(hit[f"y{i}"]), number, int(hit[f"d{i}"]))
        except ValueError:
            continue


def first_kind(text: str, kinds: dict[str, tuple[str, ...]], otherwise: str | None = None) -> str | None:
    """The first kind one of whose key words stands in the text, whatever the case."""
    low = text.lower()
    return next((k for k, words in kinds.items() if any(w in low for w in words)), otherwise)
