"""The function library: scalar, aggregate and window functions by name.

Names follow the language; each entry builds a Column from Columns. Where
engines differ, results are those of DuckDB (see README).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Builder = Callable[..., Column]


def _any_null(args: tuple[Column, ...]) -> Column:
    out = args[0].isNull()
    for a in args[1:]:
        out = out | a.isNull()
    return out


def _guarded(fn: Builder) -> Builder:
    """greatest and least are null as soon as one argument is."""
    return lambda *a: a[0] if len(a) == 1 else F.when(~_any_null(a), fn(*a))


def _div(a: Column, b: Column) -> Column:
    q = F.try_divide(a.cast("double"), b.cast("double"))
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("bigint")


def _trunc(x: Column, n: Column | None = None) -> Column:
    scale = F.pow(F.lit(10.0), n) if n is not None else F.lit(1.0)
    y = x * scale
    return (F.when(y < 0, F.ceil(y)).otherwise(F.floor(y)) / scale).cast("double")


def _backrefs(c: Column) -> Column:
    r"""\1 of the language's replacements is $1 in Java."""
    return F.regexp_replace(c, r"\\(\d)", r"\$$1")


def _combinations(x: Column, n: Column) -> Column:
    """Combinations of n elements, in order of places."""
    grow = lambda acc, _: F.flatten(F.transform(acc, lambda c: F.transform(F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.coalesce(i > F.try_element_at(c, F.lit(-1)), F.lit(True))), lambda i: F.concat(c, F.array(i)))))
    seeds = F.array(F.array().cast("array<int>"))
    places = F.when((n >= 1) & (n <= F.size(x)), F.aggregate(F.sequence(F.lit(1), n), seeds, grow)).when(n < 1, seeds).otherwise(F.array().cast("array<array<int>>"))
    return F.transform(places, lambda c: F.transform(c, lambda i: F.get(x, i)))


# MySQL's date patterns and those of Java.
_JAVA_DATE = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%i": "mm", "%s": "ss", "%S": "ss", "%b": "MMM", "%M": "MMMM", "%a": "EEE", "%W": "EEEE", "%y": "yy", "%p": "a", "%T": "HH:mm:ss", "%f": "SSSSSS",
    "%c": "M", "%e": "d", "%k": "H", "%l": "h", "%h": "hh", "%I": "hh", "%j": "DDD", "%r": "hh:mm:ss a", "%%": "%",
}


def java_pattern(text: str) -> str:
    """The Java pattern of one of MySQL's; other letters stand for themselves."""
    out = ""
    for part in re.findall(r"%.|[A-Za-z']+|[^%A-Za-z']+", text):
        if part[0] == "%" and part not in _JAVA_DATE:
            raise ValueError(f"date pattern {part} is not supported")
        out += _JAVA_DATE.get(part) or ("'" + part.replace("'", "''") + "'" if part[0].isalpha() or part[0] == "'" else part)
    return out


def _pattern(c: Column) -> Column:
    """A pattern that is not known before the query runs."""
    for old, new in _JAVA_DATE.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


# Quantile digests stand for T-digests: JSON texts of up to CENTROIDS means and
# weights, besides least and greatest value, sum and count.
CENTROIDS = 100
_DIGEST = "struct<centroid_means: array<double>, centroid_weights: array<double>, min_value: double, max_value: double, sum_value: double, count_value: double>"
_MAKE = ("centroid_means", "centroid_weights", "min_value", "max_value", "sum_value", "count_value")


def _opened(d: Column) -> Column:
    return F.from_json(d, _DIGEST)


def _closed(*parts: Column) -> Column:
    return F.to_json(F.struct(*(p.alias(n) for p, n in zip(parts, _MAKE, strict=True))))


def _bound(c: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(c), with c in the plan once however often fn uses it."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def _total(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)


def _placed(pairs: Column) -> Column:
    """(c: weight of all, a: pairs (m, w) with r, the weight reached with them)."""
    start = F.struct(F.lit(0.0).alias("c"), F.array().cast("array<struct<m: double, w: double, r: double>>").alias("a"))
    return F.aggregate(pairs, start, lambda s, x: F.struct((s["c"] + x["w"]).alias("c"), F.concat(s["a"], F.array(F.struct(x["m"].alias("m"), x["w"].alias("w"), (s["c"] + x["w"]).alias("r")))).alias("a")))


def _centroids(s: Column) -> Column:
    return F.arrays_zip(s["centroid_means"].alias("m"), s["centroid_weights"].alias("w"))


def _near_count(x: Column) -> Column:
    """Distinct values by a sketch of 2 ** 14 registers: a standard error of 0.8 %, and little room for few values."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.when(x.isNotNull(), F.xxhash64(x)), 14))


def _digest_of(x: Column) -> Column:
    """A digest of a group's values: quantiles of Spark's KLL sketch as equal centroids."""
    sketch, n = F.kll_sketch_agg_double(x.cast("double")), F.count(x).cast("double")
    at = F.array(*(F.lit((i + 0.5) / CENTROIDS) for i in range(CENTROIDS)))
    means = F.kll_sketch_get_quantile_double(sketch, at)
    return F.when(n > 0, _closed(means, F.transform(at, lambda _: n / CENTROIDS), F.min(x).cast("double"), F.max(x).cast("double"), F.sum(x.cast("double")), n))


def _merged(digests: Column) -> Column:
    """One digest of an array of them: centroids in order, cut into CENTROIDS parts of equal weight."""

    def cut(p: Column) -> Column:
        part = lambda x: F.least(F.floor((x["r"] - x["w"] / 2) * CENTROIDS / p["c"]), F.lit(CENTROIDS - 1))
        parts = F.transform(F.sequence(F.lit(0), F.lit(CENTROIDS - 1)), lambda i: F.filter(p["a"], lambda x: part(x) == i))
        sums = F.transform(F.filter(parts, lambda x: F.size(x) > 0), lambda x: F.aggregate(x, F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("s")), lambda a, y: F.struct((a["w"] + y["w"]).alias("w"), (a["s"] + y["m"] * y["w"]).alias("s"))))
        return F.transform(sums, lambda x: F.struct((x["s"] / x["w"]).alias("m"), x["w"].alias("w")))

    def of(all_of: Column) -> Column:
        pairs = F.array_sort(F.flatten(F.transform(all_of, _centroids)))
        return _bound(_bound(_placed(pairs), cut), lambda c: _closed(c["m"], c["w"], F.array_min(all_of["min_value"]), F.array_max(all_of["max_value"]), _total(all_of["sum_value"]), _total(all_of["count_value"])))

    return F.when(F.size(digests) > 0, _bound(F.transform(digests, _opened), of))


def _value_at(d: Column, q: Column) -> Column:
    def of(s: Column) -> Column:
        found = _bound(_placed(_centroids(s)), lambda p: F.get(F.filter(p["a"], lambda x: x["r"] >= q * p["c"]), F.lit(0))["m"])
        return F.when(q <= 0, s["min_value"]).when(q >= 1, s["max_value"]).otherwise(found)

    return _bound(_opened(d), of)


def _quantile_at(d: Column, v: Column) -> Column:
    def of(s: Column) -> Column:
        below = F.aggregate(_centroids(s), F.lit(0.0), lambda a, x: a + F.when(x["m"] <= v, x["w"]).otherwise(0.0))
        return F.when(v < s["min_value"], 0.0).when(v >= s["max_value"], 1.0).otherwise(below / _total(s["centroid_weights"]))

    return _bound(_opened(d), of)


def _trimmed_mean(d: Column, low: Column, high: Column) -> Column:
    def of(p: Column) -> Column:
        part = lambda x: F.greatest(F.lit(0.0), F.least(x["r"], high * p["c"]) - F.greatest(x["r"] - x["w"], low * p["c"]))
        sums = F.aggregate(p["a"], F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("s")), lambda a, x: F.struct((a["w"] + part(x)).alias("w"), (a["s"] + x["m"] * part(x)).alias("s")))
        return _bound(sums, lambda x: F.try_divide(x["s"], x["w"]))

    return _bound(_placed(_centroids(_opened(d))), of)


def _scaled(d: Column, by: Column) -> Column:
    k = by.cast("double")
    return _bound(_opened(d), lambda s: _closed(s["centroid_means"], F.transform(s["centroid_weights"], lambda w: w * k), s["min_value"], s["max_value"], s["sum_value"] * k, s["count_value"] * k))


def _date_part(part: Column, n: Column) -> Column:
    """A part of the interval that to_seconds() makes, with its sign: hours and below."""
    p = F.regexp_replace(F.lower(part), "s$", "")
    whole = F.abs(n.cast("double"))
    of = lambda size, most: F.floor(whole / size) % most if most else F.floor(whole / size)
    out = F.when(p.isin("second", "sec"), of(1, 60)).when(p.isin("minute", "min"), of(60, 60)).when(p.isin("hour", "hr"), of(3600, 0))
    out = out.when(p.isin("millisecond", "msec"), F.floor(whole % 60 * 1000)).when(p.isin("microsecond", "usec"), F.floor(whole % 60 * 1000000))
    known = out.when(p == "epoch", whole).when(p.isin("day", "week", "month", "year"), F.lit(0))
    return F.signum(n.cast("double")) * known.otherwise(F.raise_error(F.concat(F.lit("date_part of "), part)).cast("double"))


def _least_frequent(x: Column, n: Column | None = None) -> Column:
    kept = F.array_compact(x)
    counted = F.transform(F.array_distinct(kept), lambda v: F.struct(F.size(F.filter(kept, lambda w: w == v)).alias("n"), v.alias("v")))
    order = F.transform(F.array_sort(counted), lambda s: s["v"])
    if n is None:
        low = F.array_min(F.transform(counted, lambda s: s["n"]))
        return F.array_sort(F.transform(F.filter(counted, lambda s: s["n"] == low), lambda s: s["v"]))
    return F.slice(order, 1, n)


def _sum_of(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + F.coalesce(v.cast("double"), F.lit(0.0)))


SCALAR: dict[str, Builder] = {
    # numbers
    "abs": F.abs, "acos": F.acos, "asin": F.asin, "atan": F.atan, "cos": F.cos, "sin": F.sin, "tan": F.tan, "atan2": F.atan2,
    "ceil": lambda x: F.ceil(x).cast("bigint"), "floor": lambda x: F.floor(x).cast("bigint"), "div": _div, "exp": F.exp, "ln": F.ln,
    "log": lambda x, b: F.ln(x) / F.ln(b), "pi": F.pi, "rand": lambda: F.rand(), "pow": F.pow, "sqrt": F.sqrt, "sign": lambda x: F.signum(x).cast("int"),
    "round": lambda x, n=None: F.round(x) if n is None else F.round(x, n), "trunc": _trunc,
    "is_inf": lambda x: F.coalesce(F.abs(x.cast("double")) == F.lit(float("inf")), F.lit(False)), "is_nan": lambda x: F.coalesce(F.isnan(x), F.lit(False)),
    "greatest": _guarded(F.greatest), "least": _guarded(F.least), "bitwise_and": lambda a, b: a.bitwiseAND(b), "bitwise_or": lambda a, b: a.bitwiseOR(b),
    # nulls
    "coalesce": F.coalesce, "ifnull": lambda a, b: F.coalesce(a, b), "nullif": F.nullif,
    # strings
    "ascii": lambda s: F.ascii(s), "unicode": lambda s: F.ascii(s), "chr": lambda n: F.when(n == 0, F.lit("")).otherwise(F.char(n)), "byte_length": F.octet_length, "length": F.length,
    "concat": lambda *a: F.concat_ws("", *(x.cast("string") for x in a)), "lower": F.lower, "upper": F.upper,
    "trim": lambda s, c=None: F.trim(s) if c is None else F.btrim(s, c), "ltrim": lambda s, c=None: F.ltrim(s) if c is None else F.ltrim(s, c), "rtrim": lambda s, c=None: F.rtrim(s) if c is None else F.rtrim(s, c),
    "replace": lambda s, a, b: F.when(a == "", s).otherwise(F.replace(s, a, b)), "replace_regex": lambda s, a, b: F.regexp_replace(s, a, _backrefs(b)),
    "regexp_extract": lambda s, r, g=None: F.regexp_substr(s, r) if g is None else F.call_function("regexp_extract", s, r, g.cast("int")), "regexp_like": lambda s, r: F.rlike(s, r), "regexp_replace": lambda s, r, b=None: F.regexp_replace(s, r, F.lit("") if b is None else b),
    "starts_with": lambda s, p: F.coalesce(F.startswith(s, p), F.lit(False)), "ends_with": lambda s, p: F.coalesce(F.endswith(s, p), F.lit(False)),
    "string_repeat": F.repeat, "repeat": F.repeat, "reverse": F.reverse, "strpos": lambda h, n: F.instr(h, n), "substr": lambda s, p, n=None: F.substr(s, p) if n is None else F.substr(s, p, n), "split": lambda s, d: F.split(s, F.concat(F.lit("\\Q"), d, F.lit("\\E"))), "split_part": F.split_part,
    # time
    "dayname": lambda d: F.date_format(d, "EEEE"), "to_seconds": lambda n: n, "date_part": _date_part, "to_timestamp": lambda n: F.timestamp_seconds(n).cast("timestamp_ntz"), "date_from_unix_date": F.date_from_unix_date,
    "from_unixtime": lambda n: F.timestamp_seconds(n).cast("timestamp_ntz"), "to_unixtime": lambda t: (F.unix_micros(t.cast("timestamp")) / 1e6), "date_format": lambda t, p: F.date_format(t, _pattern(p)), "date_parse": lambda s, p: F.to_timestamp(s, _pattern(p)).cast("timestamp_ntz"),
    # JSON and URLs
    "json_extract_scalar": lambda s, p: F.call_function("get_json_object", s, p),
    "url_extract_fragment": lambda u: F.try_parse_url(u, F.lit("REF")), "url_extract_host": lambda u: F.try_parse_url(u, F.lit("HOST")), "url_extract_path": lambda u: F.try_parse_url(u, F.lit("PATH")), "url_extract_protocol": lambda u: F.try_parse_url(u, F.lit("PROTOCOL")), "url_extract_query": lambda u: F.try_parse_url(u, F.lit("QUERY")),
    "url_extract_parameter": lambda u, p: F.try_parse_url(u, F.lit("QUERY"), p), "url_extract_port": lambda u: F.nullif(F.regexp_extract(u, r"^[a-z]+://[^/?#]*:(\d+)", 1), F.lit("")).cast("bigint"),
    # arrays
    "list_extract": lambda a, i: F.try_element_at(a, i.cast("int")), "element_at": lambda a, i: F.try_element_at(a, i.cast("int")), "array_join": lambda a, d, n=None: F.array_join(a, d) if n is None else F.expr("1"), "sequence": F.sequence,
    "array_distinct": F.array_distinct, "array_except": F.array_except, "array_intersect": lambda a, b=None: F.array_intersect(a, b) if b is not None else F.aggregate(a, F.get(a, F.lit(0)), F.array_intersect), "array_union": F.array_union, "array_remove": lambda a, v: F.filter(a, lambda x: x != v), "array_sort": F.array_sort,
    "array_max": F.array_max, "array_min": F.array_min, "arrays_overlap": F.arrays_overlap, "cardinality": F.size, "contains": lambda a, v: F.exists(a, lambda x: x == v), "flatten": F.flatten, "slice": F.slice, "shuffle": F.shuffle, "array_repeat": F.array_repeat,
    "array_normalize": lambda x, p: F.transform(x, lambda v: v / F.pow(F.aggregate(x, F.lit(0.0), lambda a, w: a + F.pow(F.abs(w.cast("double")), p)), F.lit(1.0) / p)),
    "combinations": _combinations, "ngrams": lambda x, n: F.when(F.size(x) <= n, F.array(x)).otherwise(F.transform(F.sequence(F.lit(1), F.size(x) - n + 1), lambda i: F.slice(x, i, n))), "trim_array": lambda x, n: F.slice(x, F.lit(1), F.size(x) - n),
    "array_split_into_chunks": lambda x, n: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / n).cast("int")), lambda i: F.slice(x, i * n + 1, n)),
    "array_least_frequent": _least_frequent, "array_position": lambda a, v, k=None: F.array_position(a, v) if k is None else F.coalesce(F.get(F.filter(F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: F.when(F.get(a, i - 1) == v, i)), lambda i: i.isNotNull()), k - 1), F.lit(0)),
    "array_average": lambda x: _sum_of(x) / F.nullif(F.size(F.array_compact(x)), F.lit(0)), "array_has_duplicates": lambda x: F.size(F.array_distinct(x)) < F.size(x), "array_sum": _sum_of,
    "array_cum_sum": lambda x: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.aggregate(F.slice(x, F.lit(1), i), F.lit(0.0), lambda a, v: a + v.cast("double"))),
    "array_duplicates": lambda x: F.array_sort(F.filter(F.array_distinct(x), lambda v: F.size(F.filter(x, lambda w: w == v)) > 1)), "array_sort_desc": lambda x: F.sort_array(x, asc=False), "remove_nulls": F.array_compact, "array_top_n": lambda x, n: F.slice(F.sort_array(x, asc=False), 1, n),
    # sketches
    "hll_estimate": F.hll_sketch_estimate, "hll_export": lambda s: s, "hll_import": lambda s: s, "value_at_quantile": _value_at, "quantile_at_value": _quantile_at, "values_at_quantiles": lambda d, qs: F.transform(qs, lambda q: _value_at(d, q)), "trimmed_mean": _trimmed_mean, "scale_tdigest": _scaled,
    "merge_tdigest_array": _merged, "destructure_tdigest": _opened, "construct_tdigest": lambda m, w, lo, hi, s, n, compression=None: _closed(m.cast("array<double>"), w.cast("array<double>"), lo.cast("double"), hi.cast("double"), s.cast("double"), n.cast("double")),
}

#: Result kinds that matter to time arithmetic.
RETURNS = {"to_timestamp": "timestamp", "from_unixtime": "timestamp", "date_parse": "timestamp", "date_from_unix_date": "date"}
#: Functions whose result has the kind of their first argument.
SAME = {"coalesce", "ifnull", "nullif", "greatest", "least"}

# Aggregates besides count, sum, avg, min and max: builder of the argument Columns.
AGGREGATE: dict[str, Builder] = {
    "stddev": F.stddev_samp, "variance": F.var_samp, "count_approx": _near_count, "approx_percentile": lambda x, p: F.percentile_approx(x, p), "arbitrary": F.any_value, "any_value": F.any_value,
    "bitwise_and_agg": F.bit_and, "bitwise_or_agg": F.bit_or, "bitwise_xor_agg": F.bit_xor, "bool_and": F.bool_and, "bool_or": F.bool_or, "corr": lambda y, x: F.corr(y, x), "max_by": F.max_by, "min_by": F.min_by,
    "array_agg": F.collect_list, "array_agg_distinct": lambda x: F.array_sort(F.collect_set(x)), "set_agg": lambda x: F.array_sort(F.collect_set(x)), "set_union": lambda x: F.array_sort(F.array_distinct(F.flatten(F.collect_list(x)))),
    "hll_accumulate": lambda x: F.hll_sketch_agg(x), "hll_combine": lambda x: F.hll_union_agg(x), "tdigest_agg": _digest_of, "merge_tdigest": lambda d: _merged(F.collect_list(d)),
    "string_agg": lambda x, s=None: F.listagg(x.cast("string"), F.lit(",") if s is None else s), "string_agg_distinct": lambda x, s=None: F.when(F.count(x) > 0, F.call_function("array_join", F.array_sort(F.collect_set(x.cast("string"))), F.lit(",") if s is None else s)),
}

#: Aggregates whose state is a sketch, which is dear to make for each value of a distinct count.
SKETCHES = {AGGREGATE[name] for name in ("count_approx", "approx_percentile", "hll_accumulate", "hll_combine", "tdigest_agg")}

#: Window functions: (builder, needs an order, frame); a frame of None is Spark's default for the order.
ALL_ROWS = (-(1 << 63), (1 << 63) - 1)
WINDOW: dict[str, tuple[Builder, bool, tuple[int, int] | None]] = {
    "row_number": (lambda: F.row_number(), True, None), "rank": (lambda: F.rank(), True, None), "dense_rank": (lambda: F.dense_rank(), True, None), "percent_rank": (lambda: F.percent_rank(), True, None),
    "lag": (lambda x, n=1, d=None: F.lag(x, n) if d is None else F.lag(x, n, d), True, None), "lead": (lambda x, n=1, d=None: F.lead(x, n) if d is None else F.lead(x, n, d), True, None),
    "first_value": (lambda x: F.first(x), True, None), "last_value": (lambda x: F.last(x), True, ALL_ROWS),
    "sum_cumulative": (F.sum, True, None), "min_cumulative": (F.min, True, None), "max_cumulative": (F.max, True, None),
    "sum_window": (F.sum, False, None), "min_window": (F.min, False, None), "max_window": (F.max, False, None),
}
MOVING: dict[str, Builder] = {"avg_moving": F.avg, "sum_moving": F.sum, "hll_accumulate_moving": lambda x: F.hll_sketch_agg(x), "hll_combine_moving": lambda x: F.hll_union_agg(x)}


def register(name: str, builder: Builder, aggregate: bool = False) -> None:
    """Add a function of one's own; a pandas or SQL UDF will do as builder."""
    (AGGREGATE if aggregate else SCALAR)[name.lower()] = builder
