"""List parameters from query strings and back, and the cursor of the delta feeds."""

from __future__ import annotations

import base64
import binascii
import json
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from urllib.parse import urlencode

PAGE_SIZE, MOST_ROWS = 25, 100
KNOWN = ("q", "page", "pageSize", "sort", "dir")


@dataclass(frozen=True)
class ListParams:
    q: str = ""
    page: int = 1
    page_size: int = PAGE_SIZE
    sort: str | None = None
    descending: bool = True
    filters: dict[str, str] = field(default_factory=dict)

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.page_size


def _whole(raw: str | None, fallback: int, low: int, high: int) -> int:
    try:
        return min(max(int(raw or ""), low), high)
    except ValueError:
        return fallback


def parse(query: dict[str, str]) -> ListParams:
    """Pages count from 1; sizes are 1 to 100, 25 by default; unknown keys are filters."""
    return ListParams(
        q=query.get("q", "").strip(), page=_whole(query.get("page"), 1, 1, 1 << 31), page_size=_whole(query.get("pageSize"), PAGE_SIZE, 1, MOST_ROWS),
        sort=query.get("sort") or None, descending=query.get("dir") != "asc", filters={k: v for k, v in query.items() if k not in KNOWN and v},
    )


def change(params: ListParams, **changes) -> ListParams:
    """Changed parameters; the page starts anew if what is listed changes."""
    listed = {"q", "page_size", "filters"} & changes.keys()
    return replace(params, **({"page": 1} if listed and "page" not in changes else {}), **changes)


def to_query(params: ListParams) -> str:
    """Query string without what is default."""
    known = {"q": params.q, "page": params.page if params.page > 1 else "", "pageSize": params.page_size if params.page_size != PAGE_SIZE else "", "sort": params.sort, "dir": "" if params.descending else "asc"}
    return urlencode({k: v for k, v in (known | params.filters).items() if v})


@dataclass(frozen=True)
class Mark:
    """A place in one stream: epoch second and id."""

    at: int = 0
    id: int = 0

    @property
    def time(self) -> datetime:
        return datetime.fromtimestamp(self.at, UTC).replace(tzinfo=None)


@dataclass(frozen=True)
class Cursor:
    """Places in the three streams of a delta feed."""

    new: Mark = Mark()
    updated: Mark = Mark()
    removed: Mark = Mark()

    @property
    def is_zero(self) -> bool:
        return self == Cursor()

    def encode(self) -> str:
        raw = json.dumps({k: [m.at, m.id] for k, m in vars(self).items()}, separators=(",", ":"))
        return base64.urlsafe_b64encode(raw.encode()).decode().rstrip("=")

    @staticmethod
    def decode(raw: str | None) -> Cursor:
        """Anything that is no cursor is the zero cursor."""
        try:
            got = json.loads(base64.urlsafe_b64decode((raw or "") + "=" * (-len(raw or "") % 4)))
            return Cursor(**{k: Mark(int(got[k][0]), int(got[k][1])) for k in ("new", "updated", "removed")})
        except (ValueError, KeyError, TypeError, IndexError, binascii.Error):
            return Cursor()
