"""What the plans share: registering queries, and SQL twins of common expressions."""

from __future__ import annotations

SPACES_SQL = r"'[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'"


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, {SPACES_SQL}, ' ', 'g'))"


def name_key(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]', '', 'g')"


def slug(x: str, sep: str = "_") -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '{sep}', 'g'), '{sep}')"


class Plan:
    """Queries and their SQL, by name."""

    def __init__(self):
        self.QUERIES, self.SQL = {}, {}

    def query(self, name: str, sql: str | None = None):
        def add(f):
            self.QUERIES[name] = f
            if sql:
                self.SQL[name] = sql
            return f

        return add


def reader(name: str):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")
