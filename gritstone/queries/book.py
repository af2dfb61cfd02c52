"""A module's queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from gritstone.catalog import with_views


class Book:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, views: tuple[str, ...] | str = ()) -> Callable:
        """Register the function under its name; views are the catalogue relations that sql reads."""

        def register(f):
            self.queries[f.__name__] = f
            if sql:
                names = (views,) if isinstance(views, str) else views
                self.sql[f.__name__] = with_views(sql, *names) if names else sql
            return f

        return register
