"""Raw station text: scan (SRC1), header-driven parse (SRC2), positional parse (SRC3).

Files land as ``raw_data/<provider>/<station>/YYYY/MM/DD/HHMM.txt``. Each is read whole as
one row; the file path comes from the hidden ``_metadata`` column. ``parse_files`` resolves a
file's header inside its row with higher-order functions and then explodes the data lines with
the names beside them: no shuffle, no join, no Python, and the same on a stream. ``parse_header_text``
does the same for tables of lines, whose files are spread over rows: there the header is joined back on
the file path.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustframe.functions.timefn import parse_compact
from gustframe.operators.clean import coerce_measure
from gustframe.operators.frames import with_precipitation_type

# Header aliases and the measurement key lists (first present wins).
HEADER_ALIASES = {"yymmddhhmi": "tm", "tm": "tm", "stn": "stn", "ta": "ta", "hm": "hm", "rh": "hm",
                  "reh": "hm", "ws": "ws", "rn": "rn"}
TEMPERATURE_KEYS = ("ta", "temp", "temperature")
WIND_SPEED_KEYS = ("ws", "wind", "wind_speed")
PRECIP_KEYS = ("rn", "rn_1", "rn_2", "pr1", "precip", "precipitation")
HUMIDITY_KEYS = ("hm", "rh", "reh", "humidity")
HEADER_HINTS = ("tm", "ta", "ws", "rn", "hm", "reh")
FALLBACK_HEADER = ("stn", "stnnm", "tm", "ta", "hm", "ws", "wd", "rn")
MISSING_TOKENS = ("-9.0", "-9", "-")

LINE_END = r"\r?\n"
PATH_RE = r"/([^/]+)/([^/]+)/(\d{4})/(\d{2})/(\d{2})/(\d{4})\.[^/]*$"


def _prefixes(root: str, stations, days) -> str:
    """Path (glob) of the station and day folders under ``root``; ``root`` itself where neither is given."""
    if not stations and not days:
        return root
    one_of = lambda names: "{" + ",".join(names) + "}"
    station = one_of(map(str, stations)) if stations else "*"
    day = one_of(d.strftime("%Y/%m/%d") for d in days) if days else "*"
    return f"{root.rstrip('/')}/*/{station}/{day}"


def skipped_files(spark: SparkSession, lines: DataFrame, root: str, pattern: str = "*.txt", stations=None, days=None) -> DataFrame:
    """SRC1: paths of the landed files that gave no line to ``lines`` because they could not be read."""
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
              .load(_prefixes(root, stations, days)).select(F.col("path").alias("file_path")))
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731  listings differ in how they write a local scheme
    return (listed.withColumn("_p", bare("file_path"))
            .join(lines.select(bare("file_path").alias("_p")).distinct(), "_p", "left_anti").select("file_path"))


FILES = "file_path string, provider string, path_station string, value string"


def _with_path(files: DataFrame, *more: str) -> DataFrame:
    d = files.select(F.col("_metadata.file_path").alias("file_path"), "value", *more)
    return d.select("file_path", F.regexp_extract("file_path", PATH_RE, 1).alias("provider"),
                    F.regexp_extract("file_path", PATH_RE, 2).alias("path_station"), "value", *more)


def read_raw_files(spark: SparkSession, root: str, pattern: str = "*.txt", stations=None, days=None) -> DataFrame:
    """SRC1: every file under ``root`` as one row with its whole text.

    Landed payloads are small per-station/hour files, so a file is the unit of parallelism and its lines stay in order
    (a file beyond 2 GB, the limit of one value, is an error).
    ``stations`` and ``days`` (dates) name the folders to list: no other file is listed or read, and
    folders that are not there give no rows. ``ignoreCorruptFiles`` skips unreadable files;
    ``skipped_files`` names them.
    """
    reader = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
              .option("ignoreCorruptFiles", "true"))
    try:
        return _with_path(reader.text(_prefixes(root, stations, days), wholetext=True))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND" or not (stations or days):
            raise
        return spark.createDataFrame([], FILES)


def stream_raw_files(spark: SparkSession, root: str, pattern: str = "*.txt", max_files_per_trigger: int = 100) -> DataFrame:
    """STM1: new files under ``root`` as rows of whole texts, for ``parse_files``."""
    return _with_path(spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true")
                      .option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files_per_trigger).load(root))


def read_raw_lines(spark: SparkSession, root: str, pattern: str = "*.txt", stations=None, days=None) -> DataFrame:
    """SRC1: every line of every file of ``read_raw_files`` with file path and exact line number."""
    d = read_raw_files(spark, root, pattern, stations, days)
    return d.select("file_path", "provider", "path_station", F.posexplode(F.split("value", LINE_END)).alias("line_no", "value")).select(
        "file_path", "provider", "path_station", F.col("line_no").cast("bigint").alias("line_no"), "value")


def read_split_lines(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """SRC1 for files of any size: lines like those of ``read_raw_lines``, but a file is read in ranges by as many tasks as it
    needs and no value holds more than one line. ``line_no`` is the place of a line in its file: the start of its range and a
    number that grows inside it, a struct that compares like the line's number."""
    d = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n").text(root)
         .select(F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")).alias("line_no"),
                 "_metadata", F.regexp_replace("value", r"\r$", "").alias("value")))
    return _with_path(d, "line_no").select("file_path", "provider", "path_station", "line_no", "value")


def _tokens(c: Column) -> Column:
    return F.split(F.trim(c), r"\s+")


def _normalize_names(tokens: Column) -> Column:
    """STR2: lower-case, alias, then suffix repeats ``rn, rn_1, rn_2 ...``."""
    alias = F.create_map(*[F.lit(x) for kv in HEADER_ALIASES.items() for x in kv])
    keys = F.transform(tokens, lambda t: F.coalesce(F.element_at(alias, F.lower(t)), F.lower(t)))
    return F.transform(keys, lambda k, i: F.when(
        F.size(F.filter(F.slice(keys, 1, i), lambda p: p == k)) == 0, k)
        .otherwise(F.concat(k, F.lit("_"), F.size(F.filter(F.slice(keys, 1, i), lambda p: p == k)).cast("string"))))


def _fallback(width: Column) -> Column:
    base = F.array(*[F.lit(x) for x in FALLBACK_HEADER])
    extra = F.transform(F.sequence(F.lit(len(FALLBACK_HEADER)), F.greatest(width - 1, F.lit(len(FALLBACK_HEADER)))),
                        lambda i: F.concat(F.lit("col"), i.cast("string")))
    return F.slice(F.concat(base, extra), 1, width)


def _comment(v: Column) -> Column:
    return v.startswith("#")


def _uncommented(v: Column) -> Column:
    return F.trim(F.regexp_replace(v, r"^#+", ""))


def _is_header(v: Column) -> Column:
    plain = F.upper(_uncommented(v))
    return _comment(v) & plain.contains("YYMMDD") & plain.contains("STN")


def _header(header: Column, first_line: Column, first_no: Column) -> tuple[Column, Column]:
    """Names from the first header comment, else from the first data line if it looks like one (and the number of that
    line, which is then no data), else null."""
    first = _tokens(first_line)
    looks = F.exists(first, lambda t: F.lower(t).isin(*HEADER_HINTS))
    names = F.when(header.isNotNull(), _normalize_names(_tokens(_uncommented(header))))
    return (F.coalesce(names, F.when(looks, F.transform(first, lambda t: F.lower(t)))),
            F.when(header.isNull() & looks, first_no))


def _data_rows(rows: DataFrame, start, end) -> DataFrame:
    """Observations from data lines ``_v`` with their file's ``_names`` (null: fixed names) and ``_skip``."""
    rows = rows.where(F.col("_skip").isNull() | (F.col("line_no") != F.col("_skip")))
    tok = _tokens(F.col("_v"))
    names = F.coalesce(F.col("_names"), _fallback(F.size(tok)))
    n = F.least(F.size(names), F.size(tok))
    rows = rows.withColumn("fields", F.map_from_arrays(F.slice(names, 1, n), F.slice(tok, 1, n)))
    return _fields_to_observations(rows, start, end)


def parse_files(files: DataFrame, start=None, end=None) -> DataFrame:
    """SRC2 on whole files (``read_raw_files``, ``stream_raw_files``): header-driven parse into observation rows.

    Header = first ``#`` line holding YYMMDD and STN (aliased, de-duplicated); else the first data line when it looks like
    a header; else fixed names. Everything about a file is worked out in its row.
    """
    lines = F.filter(F.transform(F.split("value", LINE_END), lambda v, i: F.struct(i.cast("bigint").alias("line_no"), F.trim(v).alias("v"))),
                     lambda x: F.length(x["v"]) > 0)
    d = files.select("file_path", "path_station", lines.alias("_lines"))
    d = d.select("file_path", "path_station", F.filter("_lines", lambda x: ~_comment(x["v"])).alias("_data"),
                 F.get(F.filter("_lines", lambda x: _is_header(x["v"])), F.lit(0))["v"].alias("_h"))
    names, skip = _header(F.col("_h"), F.get("_data", F.lit(0))["v"], F.get("_data", F.lit(0))["line_no"])
    # names first: beside the explode they would be worked out for every line, from the whole file
    d = d.select("file_path", "path_station", names.alias("_names"), skip.alias("_skip"), "_data")
    d = d.select("file_path", "path_station", "_names", "_skip", F.explode("_data").alias("_line"))
    return _data_rows(d.select("file_path", "path_station", "_names", "_skip", F.col("_line.line_no").alias("line_no"),
                               F.col("_line.v").alias("_v")), start, end)


def parse_header_text(lines: DataFrame, start=None, end=None) -> DataFrame:
    """SRC2 on a table of lines (file_path, path_station, line_no, value), with the rules of ``parse_files``: files may have
    any size. ``line_no`` may be of any type that orders the lines of a file."""
    d = lines.withColumn("_v", F.trim("value")).where(F.length("_v") > 0)
    v = F.col("_v")
    # one aggregate per file: the comment header and the first data line
    per_file = d.groupBy("file_path").agg(
        F.min_by(v, F.when(_is_header(v), F.col("line_no"))).alias("_h"),
        F.min_by(v, F.when(~_comment(v), F.col("line_no"))).alias("_first_v"),
        F.min(F.when(~_comment(v), F.col("line_no"))).alias("_first_no"))
    names, skip = _header(F.col("_h"), F.col("_first_v"), F.col("_first_no"))
    hdr = per_file.select("file_path", names.alias("_names"), skip.alias("_skip"))
    return _data_rows(d.where(~_comment(v)).join(hdr, on="file_path", how="inner"), start, end)


def _get(keys: Sequence[str]) -> list[Column]:
    return [F.element_at(F.col("fields"), F.lit(k)) for k in keys]


def _fields_to_observations(rows: DataFrame, start, end) -> DataFrame:
    ts = parse_compact(F.element_at(F.col("fields"), F.lit("tm")))
    t = F.coalesce(*[coerce_measure(c) for c in _get(TEMPERATURE_KEYS)])
    w = F.coalesce(*[coerce_measure(c) for c in _get(WIND_SPEED_KEYS)])
    p = F.coalesce(*[coerce_measure(c) for c in _get(PRECIP_KEYS)])
    h = F.coalesce(*[coerce_measure(c) for c in _get(HUMIDITY_KEYS)])
    stn = F.coalesce(F.element_at(F.col("fields"), F.lit("stn")), F.col("path_station"))
    out = rows.select(
        stn.alias("station_id"), ts.alias("obs_ts"),
        F.coalesce(t, F.lit(0.0)).alias("temperature_c"), t.isNull().alias("temperature_missing"),
        F.coalesce(w, F.lit(0.0)).alias("wind_speed_ms"),
        F.when(p.isNull() | (p < 0), F.lit(0.0)).otherwise(p).alias("precipitation_mm"),
        F.when(h < 0, F.lit(None).cast("double")).otherwise(h).alias("relative_humidity"),
        "file_path", "line_no", t.alias("_t_raw"),
    ).where(F.col("obs_ts").isNotNull())
    if start is not None:
        out = out.where(F.col("obs_ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.where(F.col("obs_ts") <= F.lit(end).cast("timestamp_ntz"))
    # PRJ3 on the raw temperature (NULL temperature -> rain, as documented)
    out = with_precipitation_type(out, t="_t_raw")
    return out.drop("_t_raw")


def parse_positional_text(lines: DataFrame, rain_index: int = 15) -> DataFrame:
    """SRC3: positional parse -- >= 14 tokens, 12-char timestamp first; index 1 station,
    3 wind, 11 temperature, 13 humidity, ``rain_index`` precipitation (15 = RN in the
    documented layout; 14 reproduces the older reading). -9 / -9.0 / - are missing."""
    d = lines.where(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0))
    tok = _tokens(F.col("value"))
    d = d.withColumn("_tok", tok).where((F.size("_tok") >= 14) & (F.length(F.col("_tok")[0]) == 12))

    def val(i):
        x = F.get(F.col("_tok"), i)
        return F.when(x.isin(*MISSING_TOKENS), F.lit(None).cast("double")).otherwise(x.try_cast("double"))

    ts = F.try_to_timestamp(F.col("_tok")[0], F.lit("yyyyMMddHHmm")).cast("timestamp_ntz")
    p = F.coalesce(val(rain_index), F.lit(0.0))
    t = val(11)
    out = d.select(
        F.col("_tok")[1].alias("station_id"), ts.alias("obs_ts"),
        F.coalesce(t, F.lit(0.0)).alias("temperature_c"),
        F.coalesce(val(3), F.lit(0.0)).alias("wind_speed_ms"),
        F.when(p < 0, F.lit(0.0)).otherwise(p).alias("precipitation_mm"),
        val(13).alias("relative_humidity"), "file_path", "line_no", t.alias("_t_raw"),
    ).where(F.col("obs_ts").isNotNull())
    return with_precipitation_type(out, t="_t_raw").drop("_t_raw")


def render_compact_lines(obs: DataFrame) -> DataFrame:
    """Inverse of the compact layout ``# STN YYMMDDHHMI TA HM WS RN`` (for landing tests
    and for rendering a table as station text); one text line per observation."""
    fmt = lambda c: F.when(F.col(c).isNull(), F.lit("-9.0")).otherwise(F.format_number(F.col(c), 2))
    return obs.select(
        "station_id", "obs_ts",
        F.concat_ws(" ", F.col("station_id"), F.date_format("obs_ts", "yyyyMMddHHmm"),
                    F.regexp_replace(fmt("temperature_c"), ",", ""),
                    F.regexp_replace(fmt("relative_humidity"), ",", ""),
                    F.regexp_replace(fmt("wind_speed_ms"), ",", ""),
                    F.regexp_replace(fmt("precipitation_mm"), ",", "")).alias("value"))


def lines_from_observations(obs: DataFrame, layout: str = "compact") -> DataFrame:
    """Render a table as landed station text, one file per station-day, in the lines
    schema of ``read_raw_lines`` (used to run the parsers over whole tables).

    ``compact``: a ``# STN YYMMDDHHMI TA HM WS RN`` header line per file plus one data
    line per row; ``positional``: 16-token lines of the documented column layout.
    Missing humidity is written as the ``-9.0`` sentinel.
    """
    path = F.concat(F.lit("raw_data/asos/"), F.col("station_id"), F.lit("/"),
                    F.date_format("obs_ts", "yyyy/MM/dd"), F.lit("/0000.txt"))
    num = lambda c: F.format_string("%.6f", F.col(c))
    hum = F.when(F.col("relative_humidity").isNull(), F.lit("-9.0")).otherwise(num("relative_humidity"))
    tm = F.date_format("obs_ts", "yyyyMMddHHmm")
    base = obs.select(path.alias("file_path"), F.lit("asos").alias("provider"),
                      F.col("station_id").alias("path_station"), F.col("event_id").alias("line_no"),
                      F.col("station_id"), tm.alias("_tm"), num("temperature_c").alias("_t"), hum.alias("_h"),
                      num("wind_speed_ms").alias("_w"), num("precipitation_mm").alias("_p"))
    if layout == "compact":
        data = base.select("file_path", "provider", "path_station", "line_no",
                           F.concat_ws(" ", "station_id", "_tm", "_t", "_h", "_w", "_p").alias("value"))
        header = (base.select("file_path", "provider", "path_station").distinct()
                  .select("*", F.lit(-1).cast("bigint").alias("line_no"),
                          F.lit("# STN YYMMDDHHMI TA HM WS RN").alias("value")))
        return data.unionByName(header)
    filler = lambda s: F.lit(s)
    return base.select("file_path", "provider", "path_station", "line_no", F.concat_ws(
        " ", "_tm", "station_id", filler("-9"), "_w", filler("-9"), filler("-9.0"), filler("-9"),
        filler("1000.2"), filler("1010.2"), filler("-9"), filler("-9.0"), "_t", filler("-9.0"), "_h",
        filler("-9.0"), "_p").alias("value"))


def _uri(path: str) -> str:
    """A path or Hadoop path as a URI of the file system library."""
    if "://" in path:
        return path
    return "file://" + path.removeprefix("file:")


def _landed(root: str):
    """Writes the lines of each file, which come one after the other, and gives its path and number of lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(root)
        path, part, out, lines, done = None, None, None, 0, []

        def close() -> None:
            if out is not None:
                out.close()
                store.move(part, f"{base}/{path}")                   # a task that runs twice leaves one whole file
                done.append((path, lines))

        for batch in batches:
            for own, value in zip(batch.column("file_path").to_pylist(), batch.column("value").to_pylist()):
                if own != path:
                    close()
                    path, lines, part = own, 0, f"{base}/{own}.{uuid.uuid4().hex}.part"
                    store.create_dir(f"{base}/{own.rsplit('/', 1)[0]}", recursive=True)
                    out = store.open_output_stream(part)
                out.write(value.encode() + b"\n")
                lines += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())],
                                         ["file_path", "lines"])
    return run


def land_lines(lines: DataFrame, root: str) -> int:
    """Write a table of lines (file_path below ``root``, line_no, value) as text files in a store that all tasks share;
    returns the number of files. A file is written by one task, line by line."""
    spark = lines.sparkSession
    d = (lines.select("file_path", "line_no", "value").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file_path")
         .sortWithinPartitions("file_path", "line_no").select("file_path", "value"))
    return d.mapInArrow(_landed(_uri(root)), "file_path string, lines long").count()
