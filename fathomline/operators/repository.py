"""Read-only queries over stored events and processes: filter, search, sort, page, distinct, summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_SIZES, DEFAULT_PAGE = (25, 50, 100), 50


def _priority() -> Column:
    return F.when(F.col("event_priority") == "high", 3).when(F.col("event_priority") == "normal", 2).otherwise(1)


@dataclass(frozen=True)
class Key:
    """A value to sort by; null is the smallest."""

    value: Column
    descending: bool = False

    @property
    def column(self) -> Column:
        return self.value.desc_nulls_last() if self.descending else self.value.asc_nulls_first()

    def behind(self, bound: object) -> Column:
        """Whether a row's value comes after one that a row had."""
        if bound is None:
            return F.lit(False) if self.descending else self.value.isNotNull()
        return self.value.isNull() | (self.value < F.lit(bound)) if self.descending else F.coalesce(self.value > F.lit(bound), F.lit(False))


def event_order(name: str) -> list[Key]:
    """Total orders by name; an unknown name is timestamp_desc."""
    last = [Key(F.col("us"), True), Key(F.col("event_id"), True)]
    return {"ransomware_desc": [Key(F.col("probability"), True), *last], "priority_desc": [Key(_priority(), True), *last], "path_asc": [Key(F.lower("file_path")), *last]}.get(name, last)


def process_order(name: str) -> list[Key]:
    key = Key(F.col("process_key"))
    seen = Key(F.col("last_seen"), True)
    by_name = Key(F.lower("process_name"))
    return {
        "last_seen_desc": [seen, by_name, key], "name_asc": [by_name, seen, key],
        "ransomware_desc": [Key(F.col("ransomware_encrypted_count"), True), Key(F.col("max_ransomware_probability"), True), seen, key],
    }.get(name, [Key(F.col("suspicion_score"), True), seen, key])


#: The letters whose case a search doesn't look at: the stored tables' NOCASE knows ASCII only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def matches(query: str | None, *columns: str) -> Column:
    """Substring search in any of the columns that takes ASCII letters of either case for equal, and wildcards literally; an empty query matches."""
    if not query:
        return F.lit(True)
    wanted = query.translate(str.maketrans(UPPER, LOWER))
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.translate(F.col(c).cast("string"), UPPER, LOWER), F.lit(wanted))
    return F.coalesce(out, F.lit(False))


def among(column: str, values: list | tuple | None) -> Column:
    """IN a list; an empty list is no filter."""
    return F.col(column).isin(*values) if values else F.lit(True)


@dataclass(frozen=True)
class Page:
    items: DataFrame
    total: int
    page: int
    pages: int


def behind(order: list[Key], bounds: list | tuple, itself: bool = False) -> Column:
    """Whether a row comes after the one with these values of the order's keys; itself: or has the same."""
    out = F.lit(itself)
    for k, bound in zip(reversed(order), reversed(bounds), strict=True):
        out = k.behind(bound) | k.value.eqNullSafe(F.lit(bound)) & out
    return out


class Pages:
    """The pages of a sorted table, without sorting it.

    One pass samples bounds of ranges of the order, a second counts the rows of each range; these
    counts say in which range a page begins, and only rows from that range's bound on, up to the range
    that the page ends in, are sorted. Both are made once for any number of pages. From a row on,
    following() reads the next ones by its keys alone. The order has to be total.
    """

    #: Rows of a range, about; ranges at most.
    ROWS, RANGES = 2_000, 128

    def __init__(self, df: DataFrame, order: list[Key]):
        self.df, self.order = df, order
        self.total = df.count()
        wanted = min(self.RANGES, self.total // self.ROWS)
        self.bounds: list[tuple] = []
        if wanted > 1:
            keys = df.select(*(k.value.alias(str(i)) for i, k in enumerate(order)))
            # some 20 rows a range, whatever the table's size
            drawn = keys.sample(min(1.0, 20 * wanted / self.total), seed=1).orderBy(*(Key(F.col(str(i)), k.descending).column for i, k in enumerate(order))).limit(40 * wanted).collect()
            self.bounds = list(dict.fromkeys(tuple(drawn[i * len(drawn) // wanted]) for i in range(1, wanted) if drawn))
        number = sum((F.when(behind(order, b, itself=True), 1).otherwise(0) for b in self.bounds), F.lit(0))
        counts = {r["r"]: r["count"] for r in df.groupBy(number.alias("r")).count().collect()} if self.bounds else {0: self.total}  # a row a range
        self.sizes = [counts.get(r, 0) for r in range(len(self.bounds) + 1)]

    def rows(self, start: int, size: int) -> DataFrame:
        """The rows at places start to start + size - 1 of the order."""
        first = before = 0
        while first < len(self.sizes) - 1 and before + self.sizes[first] <= start:
            before += self.sizes[first]
            first += 1
        last, upto = first, before + self.sizes[first]
        while last < len(self.sizes) - 1 and upto < start + size:
            last += 1
            upto += self.sizes[last]
        df = self.df
        if first:
            df = df.filter(behind(self.order, self.bounds[first - 1], itself=True))
        if last < len(self.bounds):
            df = df.filter(~behind(self.order, self.bounds[last], itself=True))
        return df.orderBy(*(k.column for k in self.order)).offset(start - before).limit(size)

    def page(self, number: int, size: int) -> Page:
        """Sizes other than the known ones are 50, the number is clamped to what there is."""
        size = size if size in PAGE_SIZES else DEFAULT_PAGE
        pages = max(1, -(-self.total // size))
        number = min(max(1, number), pages)
        return Page(self.rows((number - 1) * size, size), self.total, number, pages)

    def following(self, bounds: list | tuple, size: int) -> DataFrame:
        """The next rows after the one with these values of the order's keys."""
        return self.df.filter(behind(self.order, bounds)).orderBy(*(k.column for k in self.order)).limit(size)


def page(df: DataFrame, order: list[Key], number: int, size: int) -> Page:
    """One page of a sorted table; who turns pages keeps the Pages."""
    return Pages(df, order).page(number, size)


def lookup(df: DataFrame, key: str, value: object) -> dict | None:
    """The row of a primary key as a dictionary, None if there is none. The filter reaches the scan."""
    row = df.filter(F.col(key) == F.lit(value)).limit(1).collect()
    return row[0].asDict(recursive=True) if row else None


def distinct_values(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """The column's values that aren't blank, sorted; only of allowed columns."""
    if column not in allowed:
        raise ValueError(f"distinct values of {column} are not offered")
    return df.select(F.col(column).alias("value")).filter(F.col("value").isNotNull() & (F.trim(F.col("value").cast("string")) != "")).distinct().orderBy("value")


def summary(events: DataFrame) -> DataFrame:
    """One pass for all counts."""
    return events.agg(F.count("*").alias("events"), F.count_if(F.col("predicted_class") == "ransomware-encrypted").alias("positives"),
                      F.count_if(F.col("event_priority") == "high").alias("high_priority"), F.count_if(F.col("predicted_class").isNull()).alias("unclassified"))
