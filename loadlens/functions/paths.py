"""Call paths: ARRAY<STRUCT<module, off>>, innermost frame first, null for none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_PATH = "null_callpath"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def frame_text(frame: Column) -> Column:
    return F.concat(frame["module"], F.lit("(0x"), F.lower(F.hex(frame["off"])), F.lit(")"))


def path_text(path) -> Column:
    """Outermost frame first, joined by ' : '."""
    path = _c(path)
    return F.coalesce(F.array_join(F.transform(F.reverse(path), frame_text), " : "), F.lit(NULL_PATH))


def make_path(text) -> Column:
    """Parse module(0xoff) : module(0xoff), outermost first, modules optional."""
    parts = F.filter(F.split(_c(text), ":"), lambda x: F.trim(x) != "")
    pattern = r"^\s*([^()]*?)\s*\(0x([0-9a-fA-F]+)\)\s*$"
    frame = lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("module"), F.conv(F.regexp_extract(x, pattern, 2), 16, 10).cast("long").alias("off"))
    return F.reverse(F.transform(parts, frame))


def slice_path(path, start: int, end: int | None = None) -> Column:
    """Frames from start up to but not including end."""
    path = _c(path)
    last = F.size(path) if end is None else F.least(F.lit(end), F.size(path))
    return F.slice(path, start + 1, F.greatest(last - start, F.lit(0)))


def has_prefix(path, other) -> Column:
    """Whether other's frames are the outermost ones of path."""
    path, other = _c(path), _c(other)
    n, m = F.size(other), F.size(path)
    return F.coalesce((m >= n) & (F.slice(path, F.greatest(m - n + 1, F.lit(1)), n) == other), F.lit(False))


def chop_at(path, module: str) -> Column:
    """Frames inside the first one of a module, without it."""
    path = _c(path)
    at = F.array_position(F.transform(path, lambda f: f["module"] == module), True)
    return F.when(at > 0, F.slice(path, 1, (at - 1).cast("int"))).otherwise(path)


def trim_wrappers(path, is_wrapper) -> Column:
    """path without the leading frames that is_wrapper holds for."""
    path = _c(path)
    at = F.array_position(F.transform(path, lambda f: ~is_wrapper(f)), True)
    return F.when(at > 0, F.slice(path, at.cast("int"), F.size(path))).otherwise(F.slice(path, 1, 0))


def is_comm(start, end) -> Column:
    return _c(start).isNull() & _c(end).isNull()


def key_text(metric, kind, start, end) -> Column:
    return F.concat(F.lit("["), _c(metric), F.lit(" "), _c(kind).cast("string"), F.lit(" "), path_text(start), F.lit(" => "), path_text(end), F.lit("]"))


def parse_keys(text) -> Column:
    """Comma list of start=>end or of single paths to an array of keys of metric time and type 0."""
    parts = F.filter(F.split(_c(text), ","), lambda x: F.trim(x) != "")
    sides = F.transform(parts, lambda x: F.split(x, "=>"))
    return F.transform(sides, lambda x: F.struct(F.lit("time").alias("metric"), F.lit(0).alias("type"), make_path(x[0]).alias("start"), make_path(F.element_at(x, -1)).alias("end")))


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key: a table of a few row groups is as few tasks, however many cores parse its texts."""
    return df.repartition(key)


def each(df: DataFrame, array: str, place: str, name: str) -> DataFrame:
    """df with a row for each element of an array that is costly to make: place from 0, and the element; none for an empty array or null.

    From an inner posexplode the optimizer infers that the array has elements, and would make it a second time to filter by that.
    """
    kept = [c for c in df.columns if c != array]
    return df.select(*kept, F.posexplode_outer(array).alias(place, name)).where(F.col(place).isNotNull())


def _text(path: Column) -> Column:
    return F.to_json(F.struct(path.alias("g")))


def _prefixes(path: Column) -> Column:
    """Texts of a path's outermost 0, 1, ... frames."""
    return F.transform(F.sequence(F.lit(0), F.size(path)), lambda n: _text(F.slice(path, F.size(path) - n + 1, n)))


def keep_guided(keys: DataFrame, guides: DataFrame | None, paths: dict[str, str] | None = None) -> DataFrame:
    """Keys all of whose paths begin with a guide's frames; all without guides. Equal keys stay, null paths match none.

    paths names the column of guides that each path column must begin with. Prefixes meet by
    equality: every distinct path lists its outer prefixes, the empty one as well, so the joins are equi-joins
    and need no pairing of keys with guides.
    """
    if guides is None:
        return keys
    paths = paths or {"path": "guide"}
    tried = keys.select(*[_text(F.col(p)).alias(f"_{p}") for p in paths], *paths).distinct()
    for p in paths:
        tried = tried.where(F.col(p).isNotNull()).withColumn(f"_of_{p}", F.explode(_prefixes(F.col(p))))
    wanted = guides.select(*[_text(F.col(g)).alias(f"_of_{p}") for p, g in paths.items()]).distinct()
    found = tried.join(wanted, [f"_of_{p}" for p in paths], "left_semi").select(*[f"_{p}" for p in paths]).distinct()
    marked = keys.withColumns({f"_{p}": _text(F.col(p)) for p in paths})
    return marked.join(found, [f"_{p}" for p in paths], "left_semi").select(*keys.columns)


def symbolize(frames: DataFrame, symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """frames(module, off, ...) with file, line and symbol; missing ones are empty.

    Modules are resolved by alias first. Both joins are left equi-joins; the
    planner broadcasts symbol tables that it knows to be small.
    """
    named = frames.join(aliases, frames["module"] == aliases["alias"], "left").withColumn("module", F.coalesce("target", "module")).drop("alias", "target")
    return named.join(symbols, ["module", "off"], "left").withColumns({"file": F.coalesce("file", F.lit("??")), "line": F.coalesce("line", F.lit(0)), "symbol": F.coalesce("symbol", F.lit("??"))})


def location_text(file, line, symbol, module) -> Column:
    """symbol(file:line), the module's base name where there is no symbol."""
    file, line, symbol, module = map(_c, (file, line, symbol, module))
    known = F.concat(symbol, F.lit("("), F.element_at(F.split(file, "/"), -1), F.lit(":"), line.cast("string"), F.lit(")"))
    return F.when(module.isNull(), "none").when(symbol.isNull() | (symbol == "??"), F.concat(F.lit("unknown in "), F.element_at(F.split(module, "/"), -1))).otherwise(known)


def frame_info_text(file, line, symbol, module, off) -> Column:
    return F.concat(F.coalesce(_c(file), F.lit("??")), F.lit(":"), F.coalesce(_c(line).cast("string"), F.lit("??")), F.lit(" "), F.coalesce(_c(symbol), F.lit("??")), F.lit(" "), _c(module), F.lit("(0x"), F.lower(F.hex(_c(off))), F.lit(")"))


RANGE_BITS = 16  # addresses of a range


def nearest_symbol(offsets: DataFrame, table: DataFrame) -> DataFrame:
    """offsets(module, off) with the symbol of the greatest address not above, by sorted passes over ranges of addresses.

    Both sides are unioned and the last symbol is carried on, so no pairs are
    made however many symbols a module has, and a module is as many tasks as it has ranges in use.
    """
    from pyspark.sql import Window

    none = F.lit(None).cast("string")
    both = table.select("module", F.col("addr").alias("off"), "symbol", F.lit(0).alias("kind"), F.col("addr").alias("addr_of"))
    asked = offsets.select("module", "off", none.alias("symbol"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("addr_of"))
    every = both.unionByName(asked).withColumn("_range", F.shiftright("off", RANGE_BITS))
    # What a range begins with: the last symbol of those before it, carried over the ranges that are in use.
    ends = every.groupBy("module", "_range").agg(F.max(F.when(F.col("kind") == 0, F.struct("off", "symbol"))).alias("_end"))
    earlier = Window.partitionBy("module").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.select(F.col("module").alias("_m"), F.col("_range").alias("_r"), F.last("_end", True).over(earlier).alias("_begin"))
    w = Window.partitionBy("module", "_range").orderBy("off", "kind").rowsBetween(Window.unboundedPreceding, 0)
    joined = every.join(begins, (F.col("module") == F.col("_m")) & (F.col("_range") == F.col("_r")))
    carried = joined.withColumns({"symbol": F.coalesce(F.last("symbol", True).over(w), F.col("_begin.symbol")), "addr": F.coalesce(F.last("addr_of", True).over(w), F.col("_begin.off"))})
    return carried.where("kind = 1").select("module", "off", "symbol", "addr")
