"""Right-censoring, train and test sets with a purge, and forward-chaining folds."""

from __future__ import annotations

from datetime import date, timedelta
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dnf
from ..schemas import BINS, FOLDS, LABELS, NOT_FEATURES

TEST_START, CENSOR = date(2023, 6, 1), date(2023, 6, 30)
#: First and last day of each fold's validation range.
FOLD_RANGES = [(date(2023, 3, 16), date(2023, 3, 31)), (date(2023, 4, 16), date(2023, 4, 30)), (date(2023, 5, 16), date(2023, 5, 31))]
PURGE = 15

# The segments that have a model of their own, as (price, coupon, expiry) bins; the other 13 share one.
SEGMENTS = {"seg_001": [(0, 0, 1)], "seg_011_and_021": [(0, 1, 1), (0, 2, 1)], "seg_010": [(0, 1, 0)], "seg_000": [(0, 0, 0)]}
OTHERS = "oth_segs"


def censor(trainable: DataFrame, cutoff: date | None = CENSOR) -> DataFrame:
    """Only receipts whose coupon has ended by the cutoff; all of them for None."""
    return trainable if cutoff is None else trainable.where(F.col("End_date") <= F.lit(cutoff))


def _before(kind: str, start: date, purge: int) -> Column:
    """Known before ``start``: for the policy model the coupon has ended, for ROI it was received ``purge`` days earlier."""
    return F.col("End_date") < F.lit(start) if kind == "policy" else F.col("Receive_date") < F.lit(start - timedelta(days=purge))


def fold_marker(kind: str, first: date, last: date, purge: int = PURGE) -> Column:
    """2 in the validation range, 1 in the training part before it, else 0."""
    return F.when(F.col("Receive_date").between(F.lit(first), F.lit(last)), 2).when(_before(kind, first, purge), 1).otherwise(0)


def split(kind: str, trainable: DataFrame, test_start: date = TEST_START, cutoff: date | None = CENSOR, folds: list[tuple[date, date]] | None = None, purge: int = PURGE) -> tuple[DataFrame, DataFrame]:
    """(train, test) for "policy" or "roi"; train has a marker for each of ``folds``, which may be empty."""
    if kind not in ("policy", "roi"):
        raise ValueError("kind must be 'policy' or 'roi'")
    rows = censor(trainable, cutoff)
    train = rows.where(_before(kind, test_start, purge))
    ranges = FOLD_RANGES if folds is None else folds
    train = train.withColumns({f"fold_{i}_marker": fold_marker(kind, a, b, purge) for i, (a, b) in enumerate(ranges, 1)}) if ranges else train
    return train, rows.where(F.col("Receive_date") >= F.lit(test_start))


def segment_filter(price=2, coupon=0, expiry=0) -> list[list[tuple]]:
    """DNF for one segment, or for several given as lists of equal length."""
    given = (price, coupon, expiry)
    lists = [isinstance(x, list) for x in given]
    if not any(lists):
        given = tuple([x] for x in given)
    elif not all(lists):
        raise TypeError("segment identifiers must be all lists or all numbers")
    if len({len(x) for x in given}) != 1:
        raise ValueError("segment identifiers differ in length")
    return [[(c, "==", v) for c, v in zip(BINS, triple, strict=True)] for triple in zip(*given, strict=True)]


def segment_triples(name: str) -> list[tuple[int, int, int]]:
    """The bins of a named segment; for ``OTHERS``, all that no name has."""
    named = [t for ts in SEGMENTS.values() for t in ts]
    return [t for t in product(range(3), range(3), range(2)) if t not in named] if name == OTHERS else SEGMENTS[name]


def named_segment(name: str) -> list[list[tuple]]:
    """DNF for a named segment."""
    return segment_filter(*map(list, zip(*segment_triples(name), strict=True)))


def segment_id() -> Column:
    """Name of the row's segment; null if the expiry bin is unknown (-1), which no segment has."""
    names = {t: n for n in (*SEGMENTS, OTHERS) for t in segment_triples(n)}
    table = F.create_map(*[x for t, n in names.items() for x in (F.lit("/".join(map(str, t))), F.lit(n))])
    return F.element_at(table, F.concat_ws("/", *BINS))


def dataset(df: DataFrame, label: str, filters: list | None = None, drop_bins: bool = False) -> DataFrame:
    """Features and one label: without keys, dates, markers and the other labels. ROI labels are learned on valid receipts, which ``filters`` says."""
    if label not in LABELS:
        raise ValueError(f"label must be one of {LABELS}")
    keep = dnf(filters or [])
    df = df if keep is None else df.where(keep)
    return df.drop(*[c for c in (*NOT_FEATURES, *LABELS, *(BINS if drop_bins else [])) if c != label])


def folds_of(df: DataFrame, label: str, filters: list | None = None, validation_only: bool = True) -> list[tuple[DataFrame, DataFrame]]:
    """(train, validation) of each fold marker in the table. Validation is the range itself; False takes all that is not trained on."""
    out = []
    for marker in [c for c in FOLDS if c in df.columns]:
        train, other = F.col(marker) == 1, F.col(marker) == 2 if validation_only else F.col(marker) != 1
        out.append((dataset(df.where(train), label, filters), dataset(df.where(other), label, filters)))
    return out


def x_y(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Features and label. Rows keep no order in Spark: use both columns together where they must match."""
    if label not in df.columns:
        raise ValueError(f"{label} is no column")
    return df.drop(label), df.select(label)
