"""File scans: CSV/TSV/TXT, JSON and Parquet into one DataFrame.

All files of one call become a single lazy scan, or one scan for each distinct
set of columns, so Catalyst pushes filters and column pruning into the reader.  Options use the reference's names and are
translated to Spark reader options here.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardinal.functions.columns import qcol

# File extension -> reader format.
FORMATS = {
    "csv": "csv",
    "tsv": "csv",
    "txt": "csv",
    "json": "json",
    "parquet": "parquet",
}

# Delimited text has a comma by default, whatever its extension; ``delim`` says otherwise.
DELIMITED = ("csv", "tsv", "txt")

# strptime directive -> Spark datetime pattern letter(s).
_STRPTIME = {
    "%Y": "yyyy", "%y": "yy", "%m": "M", "%d": "d", "%H": "H", "%I": "h",
    "%M": "m", "%S": "s", "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM",
    "%a": "EEE", "%A": "EEEE", "%j": "D", "%z": "Z", "%Z": "z", "%%": "%",
}


def strptime_to_spark(fmt: str) -> str:
    """Translate a strptime format (``%m/%d/%Y``) into a Spark pattern (``M/d/yyyy``)."""
    out, i = [], 0
    while i < len(fmt):
        tok = fmt[i:i + 2]
        if tok in _STRPTIME:
            out.append(_STRPTIME[tok])
            i += 2
            continue
        ch = fmt[i]
        out.append(f"'{ch}'" if ch.isalpha() else ch)
        i += 1
    return "".join(out)


def extension(path: str) -> str:
    name = os.path.basename(path.rstrip("/"))
    for suffix in (".gz", ".zst", ".bz2", ".lz4", ".snappy"):
        if name.endswith(suffix):
            name = name[: -len(suffix)]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def infer_format(files: Sequence[str], format: str | None = None) -> str:
    """Explicit ``format`` wins, else the extension of the first file."""
    if format:
        return format
    if not files:
        raise ValueError("no files given")
    ext = extension(files[0])
    if ext not in FORMATS:
        raise ValueError(f"unsupported file extension {ext!r}; supported: {sorted(FORMATS)}")
    return ext


def list_files(spark: SparkSession, base: str, formats: Iterable[str] = tuple(FORMATS)) -> DataFrame:
    """Loadable files under ``base`` as ``(path, length)`` relative paths.

    Listing is done by Spark's file index (distributed for large trees); only
    metadata columns are read, never file contents.
    """
    exts = [e.lower() for e in formats]
    root = base if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", base) else os.path.abspath(base)
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length")
    )
    # Spark lists qualified paths: cut everything up to the base folder's own path.
    own = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/")
    rel = F.regexp_replace("path", r"^([A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?)?" + re.escape(own) + "/", "")
    ext = F.lower(F.regexp_extract(rel, r"\.([^./]+)$", 1))
    return listed.select(rel.alias("path"), "length").where(ext.isin(exts)).orderBy("path")


def _csv_options(ext: str, opts: Mapping[str, object]) -> tuple[dict, dict]:
    """Map reference CSV option names to Spark ones; return (reader, post-scan)."""
    reader: dict[str, object] = {
        "header": True,
        "sep": ",",
        "inferSchema": True,
        "ignoreLeadingWhiteSpace": True,
        "ignoreTrailingWhiteSpace": True,
        "mode": "PERMISSIVE",
    }
    post: dict[str, object] = {}
    for key, value in opts.items():
        if key == "header":
            reader["header"] = bool(value)
        elif key == "delim":
            reader["sep"] = value
        elif key == "quotestr":
            reader["quote"] = value
        elif key == "escape":
            reader["escape"] = value
        elif key == "nullstr":
            if isinstance(value, (list, tuple)):
                post["nullstr"] = list(value)
            else:
                reader["nullValue"] = value
        elif key == "dateformat":
            reader["dateFormat"] = strptime_to_spark(str(value))
        elif key == "timestampformat":
            reader["timestampNTZFormat"] = strptime_to_spark(str(value))
            reader["timestampFormat"] = strptime_to_spark(str(value))
        elif key == "encoding":
            reader["encoding"] = value
        elif key in ("auto_detect",):
            reader["inferSchema"] = bool(value)
        elif key == "sample_size":
            int(value)  # types are inferred from all rows, a superset of any sample
        elif key == "ignore_errors":
            reader["mode"] = "DROPMALFORMED" if value else "PERMISSIVE"
        elif key == "max_line_size":
            reader["maxCharsPerColumn"] = int(value)
        elif key == "new_line":
            reader["lineSep"] = value
        elif key in ("columns", "types", "names", "normalize_names", "force_not_null",
                     "decimal_separator", "skip"):
            post[key] = value
        elif key == "allow_quoted_nulls":
            if not value:
                raise ValueError("allow_quoted_nulls=False: Spark's reader does not tell quoted cells from others")
        elif key not in ("null_padding", "parallel", "compression"):  # these need nothing here
            raise ValueError(f"unknown CSV option {key!r}")
    return reader, post


_TYPE_NAMES = {
    "bool": "boolean", "boolean": "boolean", "int": "int", "integer": "int", "bigint": "bigint",
    "float": "float", "double": "double", "string": "string", "varchar": "string",
    "date": "date", "timestamp": "timestamp_ntz", "datetime": "timestamp_ntz",
}


def _schema_from(columns: Mapping[str, str]) -> T.StructType:
    return T.StructType([
        T.StructField(n, T._parse_datatype_string(_TYPE_NAMES.get(t.lower(), t))) for n, t in columns.items()
    ])


def _normalize(name: str) -> str:
    name = re.sub(r"[^0-9a-zA-Z_]+", "_", name.strip()).strip("_").lower()
    return "_" + name if name[:1].isdigit() else name


def _apply_post(df: DataFrame, post: Mapping[str, object]) -> DataFrame:
    if "names" in post:
        df = df.toDF(*post["names"])
    if post.get("normalize_names"):
        df = df.toDF(*[_normalize(c) for c in df.columns])
    if "nullstr" in post:
        nulls = post["nullstr"]
        df = df.select(*[
            (F.when(qcol(f.name).isin(nulls), None).otherwise(qcol(f.name)) if isinstance(f.dataType, T.StringType)
             else qcol(f.name)).alias(f.name)
            for f in df.schema.fields
        ])
    if "decimal_separator" in post:
        # numbers written with another decimal separator: replace it, then try the cast
        sep = post["decimal_separator"]
        df = df.select(*[
            (F.regexp_replace(qcol(f.name), re.escape(sep), ".").try_cast("double").alias(f.name)
             if isinstance(f.dataType, T.StringType) else qcol(f.name))
            for f in df.schema.fields
        ])
    if "force_not_null" in post:
        cols = set(post["force_not_null"])
        df = df.select(*[
            (F.coalesce(qcol(c), F.lit("")).alias(c) if c in cols else qcol(c)) for c in df.columns
        ])
    return df


def _file_stem():
    """File name without its extension, from the scan's metadata column."""
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


TIME_OF_DAY = r"^\s*\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*$"


def _retyped(schema: T.StructType, kinds: Mapping[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in schema.fields])


def _times_as_text(read, df: DataFrame) -> DataFrame:
    """Columns of bare times of day as text: inference would give them today's date.

    Only columns inferred as timestamps are looked at, in one more pass.
    """
    stamps = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    if not stamps:
        return df
    schema = _retyped(df.schema, dict.fromkeys(stamps, T.StringType()))
    text = read(schema)
    only = text.agg(*[F.every(qcol(c).rlike(TIME_OF_DAY)).alias(c) for c in stamps]).first()
    times = [c for c in stamps if only[c]]
    return read(_retyped(df.schema, dict.fromkeys(times, T.StringType()))) if times else df


def _hive_options(r, files: Sequence[str], hive: bool):
    """Partition columns from ``key=value`` folders, or none."""
    if not hive:
        return r.option("recursiveFileLookup", True)
    above = {re.split(r"/[^/=]+=[^/]*/", f, maxsplit=1)[0] for f in files if re.search(r"/[^/=]+=[^/]*/", f)}
    return r.option("basePath", above.pop()) if len(above) == 1 else r


def _check(opts: Mapping[str, object], known: Iterable[str], fmt: str) -> None:
    unknown = sorted(set(opts) - set(known))
    if unknown:
        raise ValueError(f"unknown {fmt} options: {unknown}")


def _read_one_scan(spark: SparkSession, files: Sequence[str], fmt: str, opts: Mapping[str, object],
                   schema: T.StructType | None) -> tuple[DataFrame, dict]:
    opts = dict(opts)
    hive = bool(opts.pop("hive_partitioning", fmt == "parquet"))
    if fmt in DELIMITED:
        reader_opts, post = _csv_options(fmt, opts)
        if "columns" in post:
            schema = _schema_from(post["columns"])

        def read(own: T.StructType | None) -> DataFrame:
            r = spark.read.options(**{**reader_opts, "inferSchema": reader_opts["inferSchema"] and own is None})
            r = _hive_options(r if own is None else r.schema(own), files, hive)
            if int(post.get("skip", 0)) > 0:
                return _csv_with_skip(spark, files, r, int(post["skip"]))
            return r.csv(list(files))

        df = read(schema)
        if schema is None and reader_opts["inferSchema"]:
            df = _times_as_text(read, df)
        types = post.get("types")
        if types:
            if not isinstance(types, Mapping):  # a list: by position
                types = dict(zip(df.columns, types))
            df = df.select(*[
                (qcol(c).cast(_TYPE_NAMES.get(str(types[c]).lower(), str(types[c]))).alias(c) if c in types else qcol(c))
                for c in df.columns
            ])
        return df, post
    r = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "json":
        _check(opts, ("format", "ignore_errors", "compression", "maximum_sample_files", "maximum_object_size"), fmt)
        if opts.get("format") == "array":
            r = r.option("multiLine", True)
        if opts.get("ignore_errors"):
            r = r.option("mode", "DROPMALFORMED")
        return _hive_options(r, files, hive).json(list(files)), {}
    if fmt == "parquet":
        _check(opts, ("binary_as_string", "file_row_number", "merge_schema"), fmt)
        if opts.get("merge_schema"):
            r = r.option("mergeSchema", True)
        df = _hive_options(r, files, hive).parquet(*files)
        if opts.get("file_row_number"):
            df = df.withColumn("file_row_number", F.col("_metadata.row_index"))
        if opts.get("binary_as_string"):
            df = df.withColumns({f.name: qcol(f.name).cast("string") for f in df.schema.fields
                                 if isinstance(f.dataType, T.BinaryType)})
        return df, {}
    raise ValueError(f"unsupported format {fmt!r}")


def _csv_with_skip(spark: SparkSession, files: Sequence[str], reader, skip: int) -> DataFrame:
    """``skip`` n leading lines of each file, then parse as CSV.

    The lines of a file's first block are counted as they stream by: a split's
    rows come in order, so no shuffle and no sort is needed.
    """
    raw = spark.read.text(list(files)).select(
        "value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))

    def beyond(batches):
        seen: dict[str, int] = {}
        for pdf in batches:
            head = pdf["b"].eq(0)
            place = pdf[head].groupby("f").cumcount() + pdf.loc[head, "f"].map(seen).fillna(0)
            drop = place[place < skip].index
            for f, n in pdf.loc[head, "f"].value_counts().items():
                seen[f] = seen.get(f, 0) + int(n)
            yield pdf.drop(index=drop)[["value"]]

    lines = raw.mapInPandas(beyond, "value string")
    text = getattr(lines._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(reader._jreader.csv(text), spark)


HEAD_JOBS = 16  # footers or header lines that are read at the same time


def _grouped(files: Sequence[str], head: Callable[[str], tuple]) -> list[list[str]]:
    """Files of equal heads together, in the order of their first file; a head is one small job."""
    with ThreadPoolExecutor(HEAD_JOBS) as pool:
        heads = list(pool.map(head, files))
    groups: dict[tuple, list[str]] = {}
    for f, h in zip(files, heads, strict=True):
        groups.setdefault(h, []).append(f)
    return list(groups.values())


def _merges(error: Exception) -> bool:
    """Whether Parquet schemas could not be merged (a column of two types)."""
    return "CANNOT_MERGE" in str(error)


def _parquet_groups(spark: SparkSession, files: Sequence[str], hive: bool, by_name: bool) -> list[list[str]]:
    """Files that one scan can read.

    One distributed job merges all footers.  Only if it finds a column of two
    types, or (by position) a name that the first file lacks, are the files
    told apart by their own schemas.
    """
    try:
        merged = _hive_options(spark.read.option("mergeSchema", True), files, hive).parquet(*files).schema
        if by_name or set(merged.names) == set(_hive_options(spark.read, files[:1], hive).parquet(files[0]).columns):
            return [list(files)]
    except (PySparkException, Py4JJavaError) as e:  # the footer job's error arrives unconverted
        if not _merges(e):
            raise
    return _grouped(files, lambda f: tuple(
        (c.name, c.dataType.simpleString()) for c in _hive_options(spark.read, [f], hive).parquet(f).schema.fields))


def _json_groups(spark: SparkSession, files: Sequence[str]) -> list[tuple[list[str], list[str]]]:
    """Files of equal keys, each group with its keys in the order of their first appearance.

    One job over the lines: a (file, key) row per key of a file reaches the driver.
    """
    lines = spark.read.text(list(files)).select(
        F.col("_metadata.file_path").alias("f"),
        F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"),
        F.posexplode(F.json_object_keys("value")).alias("p", "k"))
    keys = lines.groupBy("f", "k").agg(F.min(F.struct("at", "p")).alias("at")).orderBy("f", "at").collect()
    own: dict[str, list[str]] = {}
    for r in keys:
        own.setdefault(r["f"], []).append(r["k"])
    first = {re.sub("^file:/+", "/", unquote(f)) for f in spark.read.text(files[0]).inputFiles()}
    groups: dict[tuple, list[str]] = {}
    for f, names in sorted(own.items(), key=lambda x: (re.sub("^file:/+", "/", unquote(x[0])) not in first, x[0])):
        groups.setdefault(tuple(names), []).append(f)
    return [(fs, list(names)) for names, fs in groups.items()]


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds the values of both columns: the wider number, or text for unlike simple types."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, _WHOLE) and isinstance(b, _WHOLE):
        return max(a, b, key=lambda t: _WHOLE.index(type(t)))
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
            scale = max(a.scale, b.scale)
            whole = max(a.precision - a.scale, b.precision - b.scale)
            if whole + scale <= 38:
                return T.DecimalType(whole + scale, scale)
        return T.DoubleType()
    stamps = (T.DateType, T.TimestampNTZType, T.TimestampType)
    if isinstance(a, stamps) and isinstance(b, stamps):
        return max(a, b, key=lambda t: stamps.index(type(t)))
    nested = (T.StructType, T.ArrayType, T.MapType, T.BinaryType, T.VariantType)
    if isinstance(a, nested) or isinstance(b, nested):
        raise ValueError(f"columns of type {a.simpleString()} and {b.simpleString()} cannot be united")
    return T.StringType()


def unite(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts, columns matched by name; a column a part lacks is NULL there, unlike types are widened."""
    kinds: dict[str, T.DataType] = {}
    for p in parts:
        for f in p.schema.fields:
            kinds[f.name] = common_type(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    out = None
    for p in parts:
        p = p.select(*[(qcol(c) if c in p.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
        out = p if out is None else out.union(p)
    return out


def _at_place(part: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns under the first file's names: as they are if all of them are known there, else by their position."""
    if set(part.columns) <= set(names):
        return part
    if len(part.columns) != len(names):
        raise ValueError(f"files with columns {part.columns} and {list(names)} cannot be united by position; "
                         "use union_by_name")
    return part.toDF(*names)


def _scans(spark: SparkSession, files: Sequence[str], ext: str, options: Mapping[str, object],
           schema: T.StructType | None, by_name: bool) -> tuple[list[DataFrame], Mapping[str, object]]:
    """One scan for all files, or one for each distinct set of columns, and the options that act after a scan."""

    def read(own: Sequence[str], **more: object) -> tuple[DataFrame, Mapping[str, object]]:
        df, post = _read_one_scan(spark, own, ext, {**options, **more}, schema)
        return df, post

    if schema is not None or len(files) == 1 or {"columns", "names"} & set(options):
        df, post = read(files)
        return [df], post
    if ext == "parquet":
        groups = _parquet_groups(spark, files, bool(options.get("hive_partitioning", True)), by_name)
        if len(groups) > 1:
            return [read(g)[0] for g in groups], {}
        if not by_name:
            return [read(files)[0]], {}
        df, post = read(files, merge_schema=True)
        first = [c for c in read(files[:1])[0].columns if c in df.columns]
        return [df.select(*[qcol(c) for c in [*first, *[c for c in df.columns if c not in first]]])], post
    if ext == "json":
        # one inference over all files merges their columns by name already
        df, post = read(files)
        if by_name or options.get("format") == "array" or set(df.columns) == set(read(files[:1])[0].columns):
            return [df], post
        parts = []
        for own, keys in _json_groups(spark, files):
            d = read(own)[0]
            parts.append(d.select(*[qcol(c) for c in [k for k in keys if k in d.columns] + [c for c in d.columns if c not in keys]]))
        return parts, post
    if not by_name:  # the delimited reader goes by position
        df, post = read(files)
        return [df], post
    got = [read(g) for g in _grouped(files, lambda f: tuple(read([f], auto_detect=False)[0].columns))]
    return [df for df, _ in got], got[0][1]


def load_files(
    spark: SparkSession,
    files: Sequence[str] | Mapping[str, object] | str,
    *,
    format: str | None = None,
    schema: T.StructType | None = None,
    filename: str | None = None,
    union_by_name: bool = False,
    base: str | None = None,
    table: str | None = None,
    virtual: bool = True,
    **options: object,
) -> DataFrame:
    """Load one or more files as a single DataFrame.

    With ``table`` the result is also a temp view of that name, or a table of
    the catalog if ``virtual`` is false.

    ``files`` may be a list of paths or the reference's request dict
    ``{"files": [...], "format": ..., <options>}``.  With ``filename="c"``
    the file stem (no extension) is added as column ``c``.

    Columns are matched by position under the first file's names, or by name
    with ``union_by_name`` (a column that a file lacks is NULL).  JSON objects
    and Parquet files name their columns: a file whose names all occur in the first
    one is matched by name in either case; others by position must have as
    many columns, or they raise.  There is one scan for each distinct set of
    columns, however many files; columns of unlike types are widened.
    """
    if isinstance(files, Mapping):
        req = dict(files)
        paths = list(req.pop("files"))
        format = req.pop("format", format)
        filename = req.pop("filename", filename)
        union_by_name = bool(req.pop("union_by_name", union_by_name))
        options = {**req, **options}
        files = paths
    if isinstance(files, str):
        files = [files]
    if base is not None:
        files = [os.path.join(base, f) for f in files]
    fmt_key = infer_format(files, format)
    fmt = FORMATS.get(fmt_key, fmt_key)
    ext_key = fmt_key if fmt_key in DELIMITED else ("csv" if fmt == "csv" else fmt)

    scans, post = _scans(spark, list(files), ext_key, options, schema, union_by_name)
    if filename and int(post.get("skip", 0)) > 0:
        raise ValueError("filename and skip cannot be combined")
    parts = []
    for df in scans:
        df = _apply_post(df, post)
        if not union_by_name and parts:
            df = _at_place(df, [c for c in parts[0].columns if c != filename])
        parts.append(df.withColumn(filename, _file_stem()) if filename else df)
    out = parts[0] if len(parts) == 1 else unite(parts)
    if table and virtual:
        out.createOrReplaceTempView(table)
    elif table:
        out.write.mode("overwrite").saveAsTable(table)
        out = spark.table(table)
    return out
