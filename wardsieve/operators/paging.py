"""Pages: opaque cursors, keyset pages, offset pages, search-engine helpers."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT, MAX_LIMIT = 10, 100
ASC, DESC = "ASC", "DESC"
_ZERO = datetime(1, 1, 1, tzinfo=UTC)


class InvalidCursor(ValueError):
    pass


@dataclass(frozen=True)
class Cursor:
    id: str = ""
    created_at: datetime = _ZERO
    updated_at: datetime = _ZERO
    sort_value: Any = None

    def encode(self) -> str:
        """URL-safe base64 of JSON."""
        body: dict[str, Any] = {"id": self.id} if self.id else {}
        body |= {k: v.isoformat().replace("+00:00", "Z") for k, v in (("created_at", self.created_at), ("updated_at", self.updated_at))}
        if self.sort_value is not None:
            body["sort_value"] = self.sort_value
        return base64.urlsafe_b64encode(json.dumps(body, separators=(",", ":")).encode()).decode()

    @classmethod
    def decode(cls, text: str) -> Cursor | None:
        if not text:
            return None
        try:
            body = json.loads(base64.b64decode(text.encode(), altchars=b"-_", validate=True))
            at = lambda k: datetime.fromisoformat(body[k]) if k in body else _ZERO
            return cls(body.get("id", ""), at("created_at"), at("updated_at"), body.get("sort_value"))
        except (ValueError, TypeError, AttributeError, KeyError) as e:
            raise InvalidCursor(text) from e


def encode_cursor(cursor: Cursor | None) -> str:
    return cursor.encode() if cursor else ""


def cursor_column(**parts: Column) -> Column:
    """The same encoding for a column of structs."""
    return F.translate(F.base64(F.encode(F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()])), "UTF-8")), "+/\r\n", "-_")


def limit_of(limit: int) -> int:
    """Out of range means the default, not the nearest bound."""
    return limit if 0 < limit <= MAX_LIMIT else DEFAULT_LIMIT


def offset_of(page: int, size: int) -> tuple[int, int, int]:
    """(page, size, offset)."""
    page, size = max(page, 1), limit_of(size)
    return page, size, (page - 1) * size


def keyset_condition(field: str, order: str = DESC) -> str:
    return f"({field}, id) {'>' if order == ASC else '<'} ($1, $2)"


def keyset_order(field: str, order: str = DESC) -> str:
    return f"{field} {order}, id {order}"


@dataclass
class KeysetPage:
    rows: DataFrame
    has_more: bool
    next_cursor: str


def keyset_rows(table: DataFrame, field: str, key: str, *, after: tuple[Any, Any] | None = None, order: str = DESC, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """limit+1 rows after the cursor values; ``field`` must be a column of the table."""
    if field not in table.columns or key not in table.columns:
        raise ValueError(f"no such column: {field}, {key}")
    rows = table
    if after is not None:
        here, there = F.struct(F.col(field).alias("f"), F.col(key).alias("k")), F.struct(F.lit(after[0]).cast(table.schema[field].dataType).alias("f"), F.lit(after[1]).cast(table.schema[key].dataType).alias("k"))
        rows = rows.where(here > there if order == ASC else here < there)
    by = (F.asc, F.asc) if order == ASC else (F.desc, F.desc)
    return rows.orderBy(by[0](field), by[1](key)).limit(limit_of(limit) + 1)


def keyset_page(table: DataFrame, field: str, key: str, **options: Any) -> KeysetPage:
    """A page and the cursor of the next one, which only exists if there are more rows."""
    n = limit_of(options.get("limit", DEFAULT_LIMIT))
    got = keyset_rows(table, field, key, **options).collect()
    more = len(got) > n
    page = table.sparkSession.createDataFrame(got[:n], table.schema)
    last = got[n - 1] if more else None
    value = last[field] if last else None
    cursor = Cursor(id=str(last[key]), sort_value=value.isoformat() if isinstance(value, datetime) else value) if last else None
    return KeysetPage(page, more, encode_cursor(cursor))


def offset_page(table: DataFrame, order: list[Column | str], page: int = 1, size: int = DEFAULT_LIMIT) -> DataFrame:
    _, size, skip = offset_of(page, size)
    return table.orderBy(*order).offset(skip).limit(size)


def page_info(total: int, page: int, size: int) -> dict[str, Any]:
    page, size, _ = offset_of(page, size)
    pages = -(-total // size)
    return {"page": page, "page_size": size, "total_items": total, "total_pages": pages, "has_next": page < pages, "has_prev": page > 1}


def search_after(cursor: Cursor | None) -> list[Any] | None:
    """Values for a search engine's ``search_after``: milliseconds, sort value, id, as present."""
    if cursor is None:
        return None
    made = [int(cursor.created_at.timestamp() * 1000)] if cursor.created_at != _ZERO else []
    return made + ([cursor.sort_value] if cursor.sort_value is not None else []) + ([cursor.id] if cursor.id else [])


def from_size(page: int, size: int) -> tuple[int, int]:
    _, size, skip = offset_of(page, size)
    return skip, size


def sort_fields(field: str, order: str = DESC) -> list[dict[str, dict[str, str]]]:
    return [{f: {"order": order.lower()}} for f in (field, "_id")]
