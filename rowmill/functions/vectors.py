"""Row-wise vector functions as Spark Columns (JVM-side, no Python).

Dense vectors are ``array<double>`` columns. When the dimension ``d`` is
known and small, functions expand to plain arithmetic on ``a[i]`` so they
stay inside whole-stage codegen; otherwise they use the array
higher-order functions (``zip_with``/``aggregate``), which run in the JVM
but are interpreted.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Above this many scalar terms an expanded expression is replaced by the
# array higher-order form (keeps generated methods under the JVM limit).
EXPAND_LIMIT = 256


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def required(value: Column, ok: Column | None, message: str) -> Column:
    """``value`` where ``ok`` holds and it is not null; any other row fails the
    query. Every row function goes through this on both sides of its size
    switch, so a null row, a null element and a row of another length have one
    outcome. NaN and infinity are values and pass."""
    return F.coalesce(value if ok is None else F.when(ok, value), F.raise_error(F.lit(message)))


def is_row(a, d: int) -> Column:
    """True for a row of length ``d`` without null elements."""
    a = _c(a)
    return F.coalesce((F.size(a) == d) & ~F.exists(a, lambda v: v.isNull()), F.lit(False))


def _ragged(d) -> str:
    return f"row is null, has a null element or is not of length {d}"


def sum_columns(terms: list[Column]) -> Column:
    if not terms:
        return F.lit(0.0)
    acc = terms[0]
    for t in terms[1:]:
        acc = acc + t
    return acc


def dot(a, b, d: int | None = None) -> Column:
    """Inner product of two array<double> columns."""
    a, b = _c(a), _c(b)
    same = (F.size(a) == F.size(b)) & (F.size(a) == (F.size(b) if d is None else d))
    if d is not None and d <= EXPAND_LIMIT:
        return required(sum_columns([a[i] * b[i] for i in range(d)]), same, _ragged(d))
    return required(F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0),
                                lambda acc, v: acc + v), same, _ragged(d or "the other"))


def dot_const(a, w: Sequence[float]) -> Column:
    """x . w for a model vector w known on the driver (linear score)."""
    a = _c(a)
    w = [float(v) for v in w]
    if len(w) <= EXPAND_LIMIT:
        return required(sum_columns([a[i] * F.lit(wi) for i, wi in enumerate(w)]),
                        F.size(a) == len(w), _ragged(len(w)))
    return dot(a, F.array(*[F.lit(v) for v in w]), len(w))


def norm_sq(a, d: int | None = None) -> Column:
    """Squared L2 norm of a row."""
    a = _c(a)
    if d is not None and d <= EXPAND_LIMIT:
        return required(sum_columns([a[i] * a[i] for i in range(d)]), F.size(a) == d, _ragged(d))
    return required(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v),
                    None if d is None else F.size(a) == d, _ragged(d or "any"))


def sqdist(a, b, d: int | None = None) -> Column:
    """Squared Euclidean distance of two array columns."""
    a, b = _c(a), _c(b)
    same = (F.size(a) == F.size(b)) & (F.size(a) == (F.size(b) if d is None else d))
    if d is not None and d <= EXPAND_LIMIT:
        return required(sum_columns([(a[i] - b[i]) * (a[i] - b[i]) for i in range(d)]), same, _ragged(d))
    return required(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)),
                                F.lit(0.0), lambda acc, v: acc + v), same, _ragged(d or "the other"))


def sqdist_const(a, c: Sequence[float]) -> Column:
    a = _c(a)
    c = [float(v) for v in c]
    if len(c) <= EXPAND_LIMIT:
        return required(sum_columns([(a[i] - F.lit(ci)) * (a[i] - F.lit(ci)) for i, ci in enumerate(c)]),
                        F.size(a) == len(c), _ragged(len(c)))
    return sqdist(a, F.array(*[F.lit(v) for v in c]), len(c))


def scale_by(a, divisors: Sequence[float]) -> Column:
    """Element-wise x_j / m_j; a zero divisor maps the element to 0.0
    (an all-zero column stays zero instead of becoming NaN). A row of another
    length or with a null fails the query; it is never cut."""
    a = _c(a)
    m = F.array(*[F.lit(float(v)) for v in divisors])
    return required(F.zip_with(a, m, lambda x, v: F.when(v == 0, F.lit(0.0)).otherwise(x / v)),
                    is_row(a, len(divisors)), _ragged(len(divisors)))


def argmax(a) -> Column:
    """0-based index of the first maximum."""
    a = _c(a)
    at = (F.array_position(a, F.array_max(a)) - 1).cast("int")
    return required(at, ~F.exists(a, lambda v: v.isNull()), "argmax of a null row or of null elements")


def one_hot(label, k: int) -> Column:
    """Class id in [0, k) -> k-vector of doubles; an id out of range fails
    the query with a clear message instead of an index error."""
    lab = _c(label).cast("int")
    checked = F.when((lab >= 0) & (lab < k), lab).otherwise(
        F.raise_error(F.concat(F.lit(f"class id out of range [0,{k}): "),
                               lab.cast("string"))))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                       lambda i: (i == checked).cast("double"))


def label_cast(col, to: str = "int", via_float: bool = True) -> Column:
    """Text/numeric label -> int or double. ``via_float`` reproduces the
    float hop (float rounding above 2^24); ``int`` truncates toward zero."""
    c = _c(col)
    if via_float:
        c = c.cast("float")
    return c.cast(to)


def class_shift(col) -> Column:
    """1-based class label -> 0-based id."""
    return (_c(col).cast("int") - 1).cast("int")


def densify_map(m, d: int) -> Column:
    """map<int,double> sparse row -> dense array<double> of length d. A key
    outside [0, d), a null value or a null row fails the query."""
    m = _c(m)
    dense = F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                        lambda j: F.coalesce(F.try_element_at(m, j), F.lit(0.0)))
    ok = F.forall(F.map_entries(m), lambda e: (e["key"] >= 0) & (e["key"] < d) & e["value"].isNotNull())
    return required(dense, ok, f"sparse row is null, has a null value or an index outside [0, {d})")


def format_pair(label, pred) -> Column:
    """"label pred" text line."""
    return F.concat_ws(" ", _c(label).cast("string"), _c(pred).cast("string"))

