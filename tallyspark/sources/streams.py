"""Event streams in (gzipped) JSON: one file of windows, or a folder with a file per window.

    {"0": {"0": ["a", ["b", 3]], "1": [["a", 2]]}, "1": {"0": ["d"]}}     a file of windows
    {"0": ["a", ["b", 3]], "1": {"a": 2}}                                 window_000007.json.gz

An element is a key (weight 1) or a pair of key and whole weight; others are
skipped. A partition may also be an object of key and weight.
"""

from __future__ import annotations

import gzip
import io
import pickle
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.windows import ordered_counts

EVENT = "window long, part int, pos long, key string, weight long"


def _numbered(df: DataFrame, label: str, name: str) -> DataFrame:
    """Labels of digits are their numbers; others follow the largest of these, by text, each its own."""
    digits = F.col(label).rlike("^[0-9]{1,18}$")
    labels = df.select(label).distinct()
    last = F.coalesce(F.max(F.when(digits, F.col(label).cast("long"))).over(Window.partitionBy()), F.lit(-1))
    place = F.row_number().over(Window.partitionBy(digits).orderBy(label))
    to = labels.select(label, F.when(digits, F.col(label).cast("long")).otherwise(last + place).alias(name))
    return df.join(to, label)


def _elements(df: DataFrame, value: str, keep: list[str]) -> DataFrame:
    """Rows of keep, pos, key, weight from a variant column of a partition's value."""
    v = F.col(value)
    is_array = F.schema_of_variant(v).startswith("ARRAY")
    items = df.select(*keep, F.expr(f"try_variant_get({value}, '$', 'array<variant>')").alias("list"), F.expr(f"try_variant_get({value}, '$', 'map<string,variant>')").alias("map"), is_array.alias("is_array"))
    listed = items.filter("is_array").select(*keep, F.posexplode("list").alias("pos", "e"))
    kind = F.schema_of_variant(F.col("e"))
    pair = F.expr("try_variant_get(e, '$', 'array<variant>')")
    key0, weight1 = F.expr("try_variant_get(e, '$[0]', 'string')"), F.expr("try_variant_get(e, '$[1]', 'bigint')")
    good = kind.startswith("ARRAY") & (F.size(pair) == 2) & F.expr("schema_of_variant(variant_get(e, '$[0]', 'variant')) = 'STRING'") & F.expr("schema_of_variant(variant_get(e, '$[1]', 'variant')) = 'BIGINT'")
    key = F.when(kind == "STRING", F.expr("try_variant_get(e, '$', 'string')")).when(good, key0)
    weight = F.when(kind == "STRING", F.lit(1).cast("long")).when(good, weight1)
    a = listed.select(*keep, F.col("pos").cast("long").alias("pos"), key.alias("key"), weight.alias("weight"))
    mapped = items.filter(~F.col("is_array") & F.col("map").isNotNull()).select(*keep, F.explode("map").alias("key", "e"))
    numbered = mapped.select(*keep, (F.row_number().over(Window.partitionBy(*keep).orderBy("key")) - 1).cast("long").alias("pos"), "key", F.expr("try_variant_get(e, '$', 'bigint')").alias("weight"))
    return a.unionByName(numbered).filter(F.col("key").isNotNull() & F.col("weight").isNotNull())


def _entries(df: DataFrame, value: str, keep: list[str], label: str, name: str) -> DataFrame:
    as_map = F.expr(f"try_variant_get({value}, '$', 'map<string,variant>')")
    return df.select(*keep, F.explode(as_map).alias(label, name))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("file"), F.expr("try_parse_json(value)").alias("body"))


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """EVENT rows of one file of windows. Windows that aren't objects are skipped."""
    windows = _entries(_files(spark, path), "body", [], "w", "body")
    parts = _entries(windows.filter(F.expr("schema_of_variant(body)").startswith("OBJECT")), "body", ["w"], "p", "value")
    return _events(_elements(parts, "value", ["w", "p"]))


def _events(rows: DataFrame) -> DataFrame:
    out = _numbered(_numbered(rows, "w", "window"), "p", "part_no")
    return out.select("window", F.col("part_no").cast("int").alias("part"), "pos", "key", "weight")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """EVENT rows of a folder of window files. The window is the number in window_N, else the file's place by name.

    A file that nests a single window is read by its file name too. A folder
    without .json or .json.gz files raises.
    """
    files = _files(spark, path).filter(F.col("file").rlike(r"\.json(\.gz)?$"))
    names = files.select("file").distinct()
    named = F.regexp_extract("file", r"window_(\d+)[^/]*$", 1)
    place = (F.row_number().over(Window.orderBy("file")) - 1).cast("long")
    labels = names.select("file", F.when(named != "", named.cast("long")).otherwise(place).alias("window"))
    if not labels.limit(1).count():
        raise FileNotFoundError(f"no .json.gz files in {path}")
    inner = _entries(files, "body", ["file", "body"], "p", "value")
    kinds = inner.withColumn("array", F.schema_of_variant("value").startswith("ARRAY"))
    nested = kinds.groupBy("file").agg(F.count("*").alias("n"), F.bool_or("array").alias("some"), F.bool_and(F.schema_of_variant("value").startswith("OBJECT<") & F.expr("exists(map_values(try_variant_get(value, '$', 'map<string,variant>')), x -> schema_of_variant(x) LIKE 'ARRAY%' OR schema_of_variant(x) LIKE 'OBJECT%')")).alias("deep")).filter("not some and deep and n = 1").select("file")
    flat = inner.join(nested, "file", "left_anti").select("file", "p", "value")
    deep = _entries(inner.join(nested, "file", "left_semi").select("file", F.col("value").alias("v")), "v", ["file"], "p", "value")
    rows = _elements(flat.unionByName(deep), "value", ["file", "p"]).join(labels, "file")
    return _numbered(rows, "p", "part_no").select("window", F.col("part_no").cast("int").alias("part"), "pos", "key", "weight")


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place, jvm.org.apache.hadoop.fs.Path


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """EVENT rows of a file of windows, or of a folder of window files."""
    fs, place, _ = _hadoop(spark, path)
    return read_folder(spark, path) if fs.getFileStatus(place).isDirectory() else read_nested(spark, path)


def emitted(events: DataFrame) -> int:
    """How many events a trace gives."""
    return events.count()


def read_window(spark: SparkSession, path: str, window: int) -> DataFrame:
    """EVENT rows of one window: of a folder its file alone is read, of a file of windows that window alone is taken apart."""
    fs, place, hadoop = _hadoop(spark, path)
    if fs.getFileStatus(place).isDirectory():
        found = [str(x.getPath().toString()) for x in fs.globStatus(hadoop(f"{path}/window_*.json*"))]
        named = [x for x in found if re.fullmatch(rf"window_0*{window}\D.*", x.rsplit("/", 1)[-1])]
        if not named:
            raise FileNotFoundError(f"no window {window} in {path}")
        return read_folder(spark, named[0])
    one = _files(spark, path).select(F.expr(f"try_variant_get(body, '$[\"{window}\"]', 'variant')").alias("body"))
    rows = _numbered(_elements(_entries(one, "body", [], "p", "value"), "value", ["p"]), "p", "part_no")
    return rows.select(F.lit(window).cast("long").alias("window"), F.col("part_no").cast("int").alias("part"), "pos", "key", "weight")


class _Plain(pickle.Unpickler):
    """Unpickles containers, numbers and text only: a trace needs no more, and anything else could run code."""

    def find_class(self, module: str, name: str):
        if (module, name) in {("collections", "Counter"), ("collections", "defaultdict"), ("collections", "OrderedDict"), ("builtins", "int"), ("builtins", "dict"), ("builtins", "list")}:
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed in a trace")


def read_pickle_counts(spark: SparkSession, path: str) -> DataFrame:
    """(window, key, cnt) of (gzipped) pickles of {window: {key: count}}; a file is one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                for window, counts in _Plain(io.BytesIO(raw)).load().items():
                    yield pd.DataFrame({"window": int(window), "key": [*map(str, counts)], "cnt": [*map(int, counts.values())]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "window long, key string, cnt long").filter("cnt > 0")


def write_pickle_counts(counts: DataFrame, folder: str) -> None:
    """A gzipped pickle of {window: {key: count}} for each window: counts-N.pkl.gz. Written where the tasks run, so the folder must be shared."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, dict[str, int]] = {}
        for frame in frames:
            for window, key, cnt in frame.itertuples(index=False):
                held.setdefault(int(window), {})[key] = int(cnt)
        for window, one in held.items():
            with gzip.open(f"{folder}/counts-{window}.pkl.gz", "wb") as f:
                pickle.dump({window: one}, f, 4)
            yield pd.DataFrame({"window": [window]})

    Path(folder).mkdir(parents=True, exist_ok=True)
    counts.filter("cnt > 0").select("window", "key", "cnt").repartition("window").mapInPandas(run, "window long").count()


def route(events: DataFrame, m: int) -> DataFrame:
    """Partitions onto m physical ones."""
    return events.withColumn("part", F.pmod(F.col("part"), F.lit(m)).cast("int"))


# Count traces


def _counted(df: DataFrame, window: Column) -> DataFrame:
    return df.select(window.cast("long").alias("window"), F.explode("counts").alias("key", "cnt")).filter("cnt > 0")


def read_counts_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(window, key, cnt) of lines {"window": w, "counts": {key: count}}; w defaults to the line's number, and counts must be there."""
    text = spark.read.text(path)
    lines = text.select(F.monotonically_increasing_id().alias("_at"), "value").filter(F.trim("value") != "")
    body = F.from_json("value", "window long, counts map<string,long>")
    rows = lines.select("_at", body.alias("b")).select("_at", "b.window", "b.counts")
    if rows.filter("counts is null").limit(1).count():
        raise ValueError("a line has no counts")
    if not rows.filter("window is null").limit(1).count():
        return _counted(rows, F.col("window"))
    # lines before each input partition, and within it by themselves: counts don't move
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.select("_part", before.alias("_begin"))
    place = rows.select("_at", part.alias("_part")).withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy("_at")) - 1)
    numbered = place.join(begins, "_part").select("_at", (F.col("_begin") + F.col("_nth")).alias("_place"))
    return _counted(rows.join(numbered, "_at"), F.coalesce("window", "_place"))


def read_counts_folder(spark: SparkSession, path: str) -> DataFrame:
    """(window, key, cnt) of files window_N.json with such a body; the window from the body, else from the name."""
    files = spark.read.option("pathGlobFilter", "window_*.json*").text(path, wholetext=True)
    body = F.from_json("value", "window long, counts map<string,long>")
    rows = files.select(F.regexp_extract(F.input_file_name(), r"window_(\d+)", 1).cast("long").alias("named"), body.alias("b"))
    return _counted(rows.select("named", "b.window", "b.counts"), F.coalesce("window", "named"))


def read_counts_csv(spark: SparkSession, path: str, key: str = "src_ip", count: str = "packet_count") -> DataFrame:
    """(window, key, cnt) of a long table with a header; repeated keys add up."""
    rows = spark.read.option("header", "true").csv(path)
    missing = {"window", key, count} - set(rows.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")
    return rows.groupBy(F.col("window").cast("long").alias("window"), F.col(key).alias("key")).agg(F.sum(F.col(count).cast("long")).alias("cnt")).filter("cnt > 0")


# Hashtag events in blocks of triples


def read_hashtag_blocks(spark: SparkSession, path: str, created: str = r'"([0-9][^"]*T[^"]*)"\^\^', node: str = r"(_:[A-Za-z0-9]+)", tag: str = r'hasTag>?\s+"([^"]+)"') -> DataFrame:
    """(created, tag) events of blank-line separated records of triples.

    A record's mentions of nodes join the nodes' labels in the same record; the
    first time of a record is its own. Prefix lines are skipped.
    """
    blocks = spark.read.option("lineSep", "\n\n").text(path).select(F.monotonically_increasing_id().alias("record"), "value")
    lines = blocks.select("record", F.posexplode(F.split("value", "\n")).alias("i", "line")).filter(~F.col("line").startswith("@prefix"))
    time = lines.select("record", "i", F.regexp_extract("line", created, 1).alias("created")).filter("created <> ''").groupBy("record").agg(F.min_by("created", "i").alias("created"))
    labels = lines.select("record", F.regexp_extract("line", rf"^\s*{node}", 1).alias("node"), F.regexp_extract("line", tag, 1).alias("tag")).filter("node <> '' and tag <> ''")
    mentions = lines.filter(F.col("line").contains("mentions")).select("record", F.explode(F.regexp_extract_all("line", F.lit(node), 1)).alias("node"))
    return mentions.join(labels, ["record", "node"]).join(time, "record").select("created", "tag")


# Writers

#: Elements of a line that a writer makes; a window's file has as many lines as it needs.
LINE = 1000


def _json_text(column: str) -> Column:
    """A text as JSON."""
    listed = F.to_json(F.array(column))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def _lines(elements: DataFrame) -> DataFrame:
    """The lines of each window's object {part: [elements]}, in order of (window, part, kind, line), from (window, part, pos, element).

    No row has more than LINE elements, however large a window is.
    """
    chunks = elements.groupBy("window", "part", F.floor(F.col("pos") / LINE).alias("line")).agg(F.sort_array(F.collect_list(F.struct("pos", "element"))).alias("some"))
    comma = lambda first: F.when(first, F.lit("")).otherwise(F.lit(","))
    inner = chunks.select("window", "part", F.lit(1).alias("kind"), "line", F.concat(comma(F.col("line") == 0), F.array_join(F.transform("some", lambda x: x["element"]), ",")).alias("value"))
    parts = elements.select("window", "part").distinct()
    first = parts.groupBy("window").agg(F.min("part").alias("first"), F.max("part").alias("last"))
    ends = parts.join(first, "window")
    opened = ends.select("window", "part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("line"), F.concat(F.when(F.col("part") == F.col("first"), F.lit("{")).otherwise(F.lit(",")), F.lit('"'), F.col("part").cast("string"), F.lit('":[')).alias("value"))
    closed = ends.select("window", "part", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("line"), F.when(F.col("part") == F.col("last"), F.lit("]}")).otherwise(F.lit("]")).alias("value"))
    return opened.unionByName(inner).unionByName(closed)


def _write_windows(lines: DataFrame, path: str) -> None:
    """path/window_000007.json.gz for each window, as read_folder reads them. A window is written by one task, line by line."""
    spark = lines.sparkSession
    rows = lines.repartition("window").sortWithinPartitions("window", "part", "kind", "line")
    rows.select("window", "value").write.partitionBy("window").option("compression", "gzip").mode("overwrite").text(path)
    fs, _, hadoop = _hadoop(spark, path)
    for status in fs.globStatus(hadoop(f"{path}/window=*")):  # names only
        folder = status.getPath()
        number = int(folder.getName().split("=")[1])
        files = fs.globStatus(hadoop(f"{folder.toString()}/part-*"))
        if len(files) != 1:
            raise RuntimeError(f"window {number} is in {len(files)} files")
        fs.rename(files[0].getPath(), hadoop(f"{path}/window_{number:06d}.json.gz"))
        fs.delete(folder, True)


def write_compact(placed: DataFrame, path: str) -> None:
    """A gzipped file per window of {part: [[key, count], ...]}, partitions by number and keys sorted."""
    order = Window.partitionBy("window", "part").orderBy("key")
    pair = F.concat(F.lit("["), _json_text("key"), F.lit(","), F.col("cnt").cast("string"), F.lit("]"))
    _write_windows(_lines(placed.filter("cnt > 0").select("window", "part", (F.row_number().over(order) - 1).alias("pos"), pair.alias("element"))), path)


def write_expanded(placed: DataFrame, path: str, seed: int = 0, form: str = "json") -> None:
    """Events in a seeded shuffle: "json", a gzipped file per window of {part: [key, ...]}; "parquet", EVENT's columns by window."""
    events = expand(placed, seed)
    if form == "parquet":
        events.write.partitionBy("window").mode("overwrite").parquet(path)
    elif form == "json":
        _write_windows(_lines(events.select("window", "part", "pos", _json_text("key").alias("element"))), path)
    else:
        raise ValueError(f"unknown form {form}")


def write_stream(placed: DataFrame, path: str, seed: int = 0) -> None:
    """All windows in one gzipped file {window: {part: [key, ...]}}, as read_nested reads it: one task writes it, line by line."""
    lines = _lines(expand(placed, seed).select("window", "part", "pos", _json_text("key").alias("element")))
    ends = lines.agg(F.min("window").alias("first"), F.max("window").alias("last")).first()
    opens, closes = (F.col("kind") == 0) & F.col("value").startswith("{"), (F.col("kind") == 2) & (F.col("value") == "]}")
    before = F.when(F.col("window") == F.lit(ends.first), F.lit("{")).otherwise(F.lit(","))
    value = F.when(opens, F.concat(before, F.lit('"'), F.col("window").cast("string"), F.lit('":'), "value")).when(closes & (F.col("window") == F.lit(ends.last)), F.lit("]}}")).otherwise(F.col("value"))
    rows = lines.select("window", "part", "kind", "line", value.alias("value"))
    rows.repartition(1).sortWithinPartitions("window", "part", "kind", "line").select("value").write.option("compression", "gzip").mode("overwrite").text(path)


#: Events that one row is turned into at most at a time; of a count over BLOCK squared the first level is longer.
BLOCK = 100_000


def expand(placed: DataFrame, seed: int = 0) -> DataFrame:
    """Each count as so many events, in a seeded order of each (window, part)."""
    # in two levels, so that no row holds an array of a whole count
    blocks = placed.filter("cnt > 0").select("window", "part", "key", "cnt", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("cnt") - 1) / BLOCK))).alias("block"))
    first = F.col("block") * BLOCK + 1
    each = blocks.select("window", "part", "key", F.explode(F.sequence(first, F.least("cnt", first + BLOCK - 1))).alias("i"))
    order = Window.partitionBy("window", "part").orderBy(F.xxhash64(F.lit(seed), "window", "part", "key", "i"), "key", "i")
    return each.select("window", "part", (F.row_number().over(order) - 1).cast("long").alias("pos"), "key", F.lit(1).cast("long").alias("weight"))


#: Keys of a line of counts; a window of more has several lines, which add up when they are read.
KEYS = 100_000


def write_counts_jsonl(counts: DataFrame, path: str) -> None:
    """Lines {"window": w, "counts": {key: count}} with positive counts, windows and keys in order."""
    order = Window.partitionBy("window").orderBy("key")
    rows = counts.filter("cnt > 0").withColumn("line", F.floor((F.row_number().over(order) - 1) / KEYS))
    entries = F.sort_array(F.collect_list(F.struct("key", "cnt")))
    rows.groupBy("window", "line").agg(F.map_from_entries(entries).alias("counts")).orderBy("window", "line").drop("line").write.mode("overwrite").json(path)


def write_tag_windows(tags: DataFrame, path: str, hours: float = 24.0) -> None:
    """(created, tag) events in windows of hours from UTC midnight of the first one: lines of counts in path/counts, with {} for empty windows, and path/metadata.json."""
    events = tags.select(F.to_timestamp("created").alias("ts"), F.col("tag").alias("key")).filter("ts is not null")
    counts = ordered_counts(events, "ts", "key", hours)
    order = Window.partitionBy("window").orderBy("key")
    rows = counts.withColumn("line", F.floor((F.row_number().over(order) - 1) / KEYS))
    entry = F.when(F.col("cnt") > 0, F.struct("key", "cnt"))
    rows.groupBy("window", "line").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("counts")).orderBy("window", "line").drop("line").write.mode("overwrite").json(f"{path}/counts")
    told = events.agg(F.min("ts").alias("first_event"), F.max("ts").alias("last_event"), F.count("*").alias("events"), F.count_distinct("key").alias("tags")).withColumn("window_hours", F.lit(float(hours)))
    told.coalesce(1).write.mode("overwrite").json(f"{path}/metadata.json")


def _digits(column: str) -> Column:
    """A number as text of ten significant digits; NaN and absent are empty."""
    return F.when(F.col(column).isNull() | F.isnan(column), F.lit(None).cast("string")).otherwise(F.format_string("%.9e", F.col(column)).cast("double").cast("string"))


def write_metrics(rows: DataFrame, path: str) -> None:
    """A table with a header: ten significant digits, absent values and NaN empty, quotes doubled."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = rows.select(*[(_digits(c) if k in ("double", "float") else F.col(f"`{c}`").cast("string")).alias(c) for c, k in kinds.items()])
    out.write.mode("overwrite").option("header", "true").option("emptyValue", "").option("nullValue", "").option("escape", '"').csv(path)


def report(run: DataFrame, most: int = 1000) -> str:
    """A run as text: a line for each window and method (the first `most`), and means of each method at the end."""
    numbers = [f.name for f in run.schema.fields if f.dataType.simpleString() in ("double", "int", "bigint", "boolean") and f.name != "window"]
    show = lambda x: "-" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x)
    out = []
    for r in run.orderBy("window", "method").limit(most).collect():
        out.append(f"[{r['method']}] window {r['window']}: " + " ".join(f"{c}={show(r[c])}" for c in numbers))
    means = run.groupBy("method").agg(F.count("*").alias("windows"), *[F.avg(F.col(c).cast("double")).alias(c) for c in numbers]).orderBy("method")
    width = max([6, *(len(c) for c in numbers)])
    for r in means.collect():  # a row a method
        out += [f"== {r['method']}: {r['windows']} windows"] + [f"   {c:<{width}} {show(r[c])}" for c in numbers]
    return "\n".join(out)
