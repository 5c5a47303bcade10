"""Column functions: Spark's own where the meaning is the same, thin compositions where it isn't.

Everything stays a JVM expression.  Three meanings differ from plain Spark on
purpose: ``concat`` skips NULLs, ``round`` takes halves to even, and ``asc`` and
``desc`` put NULLs last and first.  ``log`` is the natural logarithm.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str | int | float | bool


def _c(x: ColumnLike) -> Column:
    """A name is a column, a Column itself, anything else a literal."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def _v(x: Any) -> Column:
    """A Column itself, anything else (also text) a literal."""
    return x if isinstance(x, Column) else F.lit(x)


#: Functions of columns only whose meaning is Spark's.
_SAME = """
    coalesce ifnull nullif nvl nvl2 nanvl greatest least isnull isnotnull isnan
    avg mean sum min max first last median stddev stddev_samp stddev_pop var_samp var_pop corr covar_samp covar_pop
    approx_count_distinct array_agg collect_list collect_set bit_and bit_or bit_xor bool_and bool_or
    upper lower length char_length octet_length bit_length trim ltrim rtrim ascii initcap reverse
    abs sqrt cbrt exp ln log2 log10 signum sign factorial sin cos tan asin acos atan atan2 sinh cosh tanh cot degrees radians
    year month dayofmonth hour minute second quarter to_date to_timestamp
    array array_distinct array_union array_intersect array_except flatten explode explode_outer posexplode posexplode_outer md5
    power pow crc32 json_array_length cardinality grouping grouping_id xxhash64 map_keys map_values
""".split()

for _name in _SAME:

    def _wrap(f: Callable) -> Callable:
        def call(*columns: ColumnLike) -> Column:
            return f(*[_c(x) for x in columns])

        call.__name__ = call.__qualname__ = f.__name__
        call.__doc__ = f"Spark's ``{f.__name__}``."
        return call

    globals()[_name] = _wrap(getattr(F, _name))

col = column = F.col
lit, expr, call_function, when, pi, rand, uuid = F.lit, F.expr, F.call_function, F.when, F.pi, F.rand, F.uuid
current_date, current_timestamp, now = F.current_date, F.current_timestamp, F.now
row_number, rank, dense_rank, percent_rank, cume_dist, ntile = F.row_number, F.rank, F.dense_rank, F.percent_rank, F.cume_dist, F.ntile
variance = globals()["var_samp"]
day = globals()["dayofmonth"]


def function(name: str, *args: ColumnLike) -> Column:
    """Any registered function by name."""
    return F.call_function(name, *[_c(a) for a in args])


def asc(x: ColumnLike) -> Column:
    """Ascending, NULLs last."""
    return _c(x).asc_nulls_last()


def desc(x: ColumnLike) -> Column:
    """Descending, NULLs first."""
    return _c(x).desc_nulls_first()


def cast(x: ColumnLike, data_type: str) -> Column:
    return _c(x).cast(data_type)


def try_cast(x: ColumnLike, data_type: str) -> Column:
    """NULL where the cast fails."""
    return _c(x).try_cast(data_type)


# aggregates


def count(x: ColumnLike = "*") -> Column:
    return F.count(F.lit(1)) if isinstance(x, str) and x == "*" else F.count(_c(x))


def count_all() -> Column:
    return F.count(F.lit(1))


def count_distinct(*columns: ColumnLike) -> Column:
    return F.count_distinct(*[_c(x) for x in columns])


def sum_distinct(x: ColumnLike) -> Column:
    return F.sum_distinct(_c(x))


# text


def concat(*columns: ColumnLike) -> Column:
    """Concatenation in which a NULL counts as empty."""
    return F.concat(*[F.coalesce(_c(x).cast("string"), F.lit("")) for x in columns])


def concat_ws(sep: str, *columns: ColumnLike) -> Column:
    return F.concat_ws(sep, *[_c(x) for x in columns])


def chr(x: ColumnLike) -> Column:  # noqa: A001
    return F.char(_c(x))


def btrim(x: ColumnLike, characters: str | None = None) -> Column:
    return F.btrim(_c(x)) if characters is None else F.btrim(_c(x), F.lit(characters))


def repeat(x: ColumnLike, n: int | Column) -> Column:
    return F.repeat(_c(x), _v(n))


def instr(x: ColumnLike, substr: str | Column) -> Column:
    """1-based place of the first occurrence; 0 if there is none."""
    return F.instr(_c(x), _v(substr))


def locate(substr: str | Column, x: ColumnLike, pos: int = 1) -> Column:
    """1-based place, in the whole text, of the first occurrence at ``pos`` or later."""
    return F.call_function("locate", _v(substr), _c(x), F.lit(pos))


def lpad(x: ColumnLike, length: int | Column, pad: str = " ") -> Column:
    return F.lpad(_c(x), length, pad)


def rpad(x: ColumnLike, length: int | Column, pad: str = " ") -> Column:
    return F.rpad(_c(x), length, pad)


def left(x: ColumnLike, n: int | Column) -> Column:
    return F.left(_c(x), _v(n))


def right(x: ColumnLike, n: int | Column) -> Column:
    return F.right(_c(x), _v(n))


def substr(x: ColumnLike, pos: int | Column, length: int | Column | None = None) -> Column:
    return F.substr(_c(x), _v(pos)) if length is None else F.substr(_c(x), _v(pos), _v(length))


substring = substr


def split_part(x: ColumnLike, delimiter: str | Column, part: int | Column) -> Column:
    return F.split_part(_c(x), _v(delimiter), _v(part))


def substring_index(x: ColumnLike, delimiter: str, n: int) -> Column:
    return F.substring_index(_c(x), delimiter, n)


def translate(x: ColumnLike, matching: str, replacing: str) -> Column:
    return F.translate(_c(x), matching, replacing)


def starts_with(x: ColumnLike, prefix: str | Column) -> Column:
    return F.startswith(_c(x), _v(prefix))


def ends_with(x: ColumnLike, suffix: str | Column) -> Column:
    return F.endswith(_c(x), _v(suffix))


def contains(x: ColumnLike, part: str | Column) -> Column:
    return F.contains(_c(x), _v(part))


def regexp_replace(x: ColumnLike, pattern: str, replacement: str, flags: str = "g") -> Column:
    """Replaces all matches, or with ``flags`` lacking ``g`` the first one only.  Java's regular expressions."""
    if "g" in flags:
        return F.regexp_replace(_c(x), pattern, replacement)
    return F.regexp_replace(_c(x), f"(?s)\\A(.*?)(?:{pattern})", f"$1{replacement}")


def regexp_like(x: ColumnLike, pattern: str | Column) -> Column:
    return F.regexp_like(_c(x), _v(pattern))


def get_json_object(x: ColumnLike, path: str) -> Column:
    return F.get_json_object(_c(x), path)


def date_format(x: ColumnLike, pattern: str) -> Column:
    return F.date_format(_c(x), pattern)


def sha256(x: ColumnLike) -> Column:
    return F.sha2(_c(x), 256)


def sha512(x: ColumnLike) -> Column:
    return F.sha2(_c(x), 512)


# numbers


def round(x: ColumnLike, scale: int | None = None) -> Column:  # noqa: A001
    """Halves go to the even neighbour."""
    return F.bround(_c(x), scale or 0)


def ceil(x: ColumnLike) -> Column:
    return F.ceil(_c(x))


def floor(x: ColumnLike) -> Column:
    return F.floor(_c(x))


def log(x: ColumnLike) -> Column:
    """Natural logarithm."""
    return F.ln(_c(x))


def gcd(a: ColumnLike, b: ColumnLike) -> Column:
    """Greatest common divisor, never negative; Euclid's algorithm as a fold of 92 steps, enough for any two longs."""
    x, y = F.abs(_c(a).cast("long")), F.abs(_c(b).cast("long"))
    start = F.struct(x.alias("x"), y.alias("y"))
    step = lambda acc, _: F.struct(
        F.when(acc["y"] == 0, acc["x"]).otherwise(acc["y"]).alias("x"),
        F.when(acc["y"] == 0, F.lit(0).cast("long")).otherwise(acc["x"] % acc["y"]).alias("y"),
    )
    out = F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda acc: acc["x"])
    return F.when(_c(a).isNotNull() & _c(b).isNotNull(), out)


def lcm(a: ColumnLike, b: ColumnLike) -> Column:
    """Least common multiple; 0 if either is 0."""
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0).cast("long")).otherwise((F.abs(_c(a).cast("long")) / g).cast("long") * F.abs(_c(b).cast("long")))


def date_trunc(unit: str, x: ColumnLike) -> Column:
    return F.date_trunc(unit, _c(x))


# arrays


def array_contains(x: ColumnLike, value: Any) -> Column:
    return F.array_contains(_c(x), value)


def array_position(x: ColumnLike, value: Any) -> Column:
    """1-based; NULL where the value is absent."""
    return F.nullif(F.array_position(_c(x), value), F.lit(0).cast("long"))


def array_remove(x: ColumnLike, value: Any) -> Column:
    """Removes every occurrence."""
    return F.array_remove(_c(x), value)


def array_append(x: ColumnLike, value: Any) -> Column:
    return F.array_append(_c(x), value)


def array_prepend(value: Any, x: ColumnLike) -> Column:
    return F.array_prepend(_c(x), value)


def array_length(x: ColumnLike) -> Column:
    """NULL for NULL."""
    return F.array_size(_c(x))


def transform(x: ColumnLike, f: Callable) -> Column:
    return F.transform(_c(x), f)


def filter(x: ColumnLike, f: Callable) -> Column:  # noqa: A001
    return F.filter(_c(x), f)


def exists(x: ColumnLike, f: Callable) -> Column:
    return F.exists(_c(x), f)


any_match = exists


def forall(x: ColumnLike, f: Callable) -> Column:
    return F.forall(_c(x), f)


def zip_with(a: ColumnLike, b: ColumnLike, f: Callable) -> Column:
    return F.zip_with(_c(a), _c(b), f)


def aggregate(x: ColumnLike, initial: Any, merge: Callable, finish: Callable | None = None) -> Column:
    return F.aggregate(_c(x), _v(initial), merge, finish) if finish else F.aggregate(_c(x), _v(initial), merge)


reduce = aggregate


# analytic functions


def lag(x: ColumnLike, offset: int = 1, default: Any = None) -> Column:
    return F.lag(_c(x), offset, default)


def lead(x: ColumnLike, offset: int = 1, default: Any = None) -> Column:
    return F.lead(_c(x), offset, default)


def first_value(x: ColumnLike) -> Column:
    return F.first_value(_c(x))


def last_value(x: ColumnLike) -> Column:
    return F.last_value(_c(x))


def nth_value(x: ColumnLike, n: int) -> Column:
    return F.nth_value(_c(x), n)


# windows over epoch milliseconds, one slot for each event


def tumble_start(ts: ColumnLike, size: int | Column) -> Column:
    """Start of the slot that holds ``ts``; ``ts`` itself for size 0."""
    size = _v(size)
    return F.when(size == 0, _c(ts)).otherwise(_c(ts) - F.pmod(_c(ts), F.nullif(size, F.lit(0))))


def tumble_end(ts: ColumnLike, size: int | Column) -> Column:
    return tumble_start(ts, size) + _v(size)


def hop_start(ts: ColumnLike, slide: int | Column, size: int | Column) -> Column:
    """Start of the latest slot that holds ``ts``."""
    return tumble_start(ts, slide)


def hop_end(ts: ColumnLike, slide: int | Column, size: int | Column) -> Column:
    return tumble_start(ts, slide) + _v(size)


def session_start(ts: ColumnLike, gap: int | Column) -> Column:
    """The event's own provisional session; merged sessions are an operator."""
    return _c(ts)


def session_end(ts: ColumnLike, gap: int | Column) -> Column:
    return _c(ts) + _v(gap)
