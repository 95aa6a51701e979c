"""Reading and writing a parquet lake: union by name, capture from the path, tolerant NDJSON, footer inventories."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.exprs import col


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_union(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One relation over many files, united by column name; an empty list is refused."""
    if not paths:
        raise ValueError("no paths: an empty union would read as an empty table")
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    return df.select(*map(col, columns)) if columns else df


def with_capture(df: DataFrame, base: str) -> DataFrame:
    """Adds `capture`, the first path segment below base, of a relation that reads files."""
    tail = F.element_at(F.split(F.col("_metadata.file_path"), base.rstrip("/").lstrip("/") + "/"), -1)
    return df.select("*", F.split_part(tail, F.lit("/"), F.lit(1)).alias("capture"))


def read_ndjson(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Newline-delimited JSON; a torn line is dropped."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column a string."""
    return spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(path)


def scan(df: DataFrame, valid=None, sample_percent: float | None = None, limit: int | None = None, seed: int = 0) -> DataFrame:
    """Filter, then a Bernoulli sample, then a limit, in that order."""
    out = df.where(valid) if valid is not None else df
    out = out.sample(False, sample_percent / 100.0, seed) if sample_percent else out
    return out.limit(limit) if limit else out


def write_parquet(df: DataFrame, path: str) -> int:
    """Writes and returns the number of rows, which the new files' footers tell without a read of data."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).count()


def write_csv(df: DataFrame, path: str) -> int:
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    return read_text_csv(df.sparkSession, path).count()


def list_files(spark: SparkSession, pattern: str, hidden: bool = False) -> list[tuple[str, int]]:
    """(path, bytes) of the files that a pattern matches, in any file system Spark knows; hidden ones begin with _ or a dot."""
    jvm, path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(path) or []
    out: list[tuple[str, int]] = []
    for status in found:
        if status.isDirectory():
            files = fs.listFiles(status.getPath(), True)
            while files.hasNext():
                f = files.next()
                out.append((f.getPath().toString(), f.getLen()))
        else:
            out.append((status.getPath().toString(), status.getLen()))
    return sorted(x for x in out if hidden or not jvm.org.apache.hadoop.fs.Path(x[0]).getName().startswith(("_", ".")))


def catalog(spark: SparkSession, root: str, suffix: str = ".parquet") -> dict[str, dict[str, list[str]]]:
    """{dataset: {log type: [paths]}} of a mirror: the first folder below root, and the file's name without suffix."""
    out: dict[str, dict[str, list[str]]] = {}
    whole = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = whole.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(whole).toString().rstrip("/")
    for path, _ in list_files(spark, root):
        parts = path.removeprefix(whole).lstrip("/").split("/")
        at = next((i for i, p in enumerate(parts) if p.endswith(suffix)), None)  # Spark writes a folder for a file
        if at is not None:
            dataset, kind = (parts[0] if at else "(root)"), parts[at].removesuffix(suffix)
            paths = out.setdefault(dataset, {}).setdefault(kind, [])
            whole_path = "/".join([whole, *parts[: at + 1]])
            if whole_path not in paths:
                paths.append(whole_path)
    return out


def latest_extraction(spark: SparkSession, root: str, dataset: str, sidecar: str = "_extractor_meta.json", allow_incomplete: bool = False) -> str:
    """The feature space of the most recent complete extraction of a data set below root."""
    found = []
    for path, _ in list_files(spark, root, hidden=True):
        if path.endswith(f"/{dataset}/{sidecar}"):
            try:
                meta = json.loads(read_text(spark, path))
            except ValueError:
                continue
            found.append((bool(meta.get("complete", True)), meta.get("extracted_at_utc", ""), meta.get("feature_space")))
    found = [f for f in found if f[2]]
    usable = [f for f in found if f[0] or allow_incomplete]
    if not usable:
        raise ValueError(f"{'only incomplete' if found else 'no'} extractions of {dataset!r} below {root}")
    return max(usable)[2]


def _at_once(work, items: Sequence, threads: int = 16) -> list:
    """Small driver-side calls, each with its own Spark job, some at a time."""
    with ThreadPoolExecutor(min(threads, max(1, len(items)))) as pool:
        return list(pool.map(work, items))


def summarize(spark: SparkSession, paths: Sequence[str], sample: int = 200) -> dict:
    """files, rows, bytes, columns, signatures (of at most `sample` files) and the columns that some of them lack.

    Rows are one job over all footers, whatever the files' schemas.
    """
    names = [set(x) for x in _at_once(lambda p: spark.read.parquet(p).columns, list(paths)[:sample])]
    every = sorted(set().union(*names))
    sizes = [n for x in _at_once(lambda p: list_files(spark, p), list(paths)) for f, n in x if f.endswith(".parquet")]
    rows = spark.read.parquet(*paths).count() if paths else 0
    return {"files": len(paths), "rows": rows, "bytes": sum(sizes), "columns": every, "signatures": len({tuple(sorted(n)) for n in names}), "partial": [c for c in every if any(c not in n for n in names)]}


def convert_tree(spark: SparkSession, source: str, target: str, suffix: str = ".log", kinds: Sequence[str] | None = None, formats: Sequence[str] = ("parquet",), threads: int = 16) -> list[dict]:
    """Converts each NDJSON log below source to the same place below target; sidecars (a leading underscore) are skipped.

    Some files are converted at a time, each in a job of its own, so one that fails is reported and stops no other. Each
    is parsed once: further formats are written from the first.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(source)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")

    def wanted(path: str) -> bool:
        name = path.rsplit("/", 1)[-1]
        return name.endswith(suffix) and not name.startswith("_") and (not kinds or name.removesuffix(suffix) in kinds)

    def convert(path: str) -> dict:
        place = path.removeprefix(root).lstrip("/").removesuffix(suffix)
        entry = {"path": place, "rows": 0, "error": None}
        try:
            df = read_ndjson(spark, path)
            for i, f in enumerate(formats):
                entry["rows"] = write_parquet(df, f"{target}/{place}.parquet") if f == "parquet" else write_csv(df, f"{target}/{place}.csv")
                if not i and len(formats) > 1:
                    df = spark.read.parquet(f"{target}/{place}.parquet") if f == "parquet" else read_text_csv(spark, f"{target}/{place}.csv")
        except Exception as e:  # noqa: BLE001  one broken log must not hide the rest
            entry["error"] = str(e).splitlines()[0][:200]
        return entry

    return _at_once(convert, [p for p, _ in list_files(spark, source) if wanted(p)], threads)


def footer_inventory(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file, n_columns, signature (sorted column names) from schemas alone; no data is read."""
    found = _at_once(lambda p: sorted(spark.read.parquet(p).columns), list(paths))
    rows = [(p.rstrip("/").rsplit("/", 1)[-1], len(names), ",".join(names)) for p, names in zip(paths, found)]
    return spark.createDataFrame(rows, "file string, n_columns long, signature string")


def schema_columns(df: DataFrame) -> DataFrame:
    """name, type, place of a relation's columns, as rows."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), i) for i, f in enumerate(df.schema)], "name string, type string, place int")


def schema_diff(left: T.StructType, right: T.StructType) -> dict:
    """Columns that one side lacks, types that differ, and whether the shared columns come in another order."""
    a, b = {f.name: f.dataType.simpleString() for f in left}, {f.name: f.dataType.simpleString() for f in right}
    shared = [n for n in a if n in b]
    return {
        "only_left": sorted(set(a) - set(b)),
        "only_right": sorted(set(b) - set(a)),
        "types": {n: (a[n], b[n]) for n in shared if a[n] != b[n]},
        "order_differs": shared != [n for n in b if n in a],
    }


def read_text(spark: SparkSession, path: str) -> str:
    """A small document, from any file system Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small document, in any file system Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def remove(spark: SparkSession, path: str) -> None:
    """Takes one file away, in any file system Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, False)


def write_json(spark: SparkSession, path: str, document: dict) -> None:
    write_text(spark, path, json.dumps(document, sort_keys=True, default=str))


MANIFEST, SEAL = "_manifest.json", "_sealed"


def _local_sha(path: Path) -> str:
    digest = hashlib.sha256()
    with path.open("rb") as f:
        while chunk := f.read(1 << 20):
            digest.update(chunk)
    return digest.hexdigest()


def put_file(spark: SparkSession, source: str | Path, target: str) -> int:
    """Copies a local file to any file system Spark knows; its bytes."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(target)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(str(source)), where)
    return Path(source).stat().st_size


def put_tree(spark: SparkSession, source: str | Path, target: str) -> int:
    """Copies a local folder, file by file at its place; the number of files. A sealed target is refused."""
    refuse_sealed(spark, target)
    found = sorted(p for p in Path(source).rglob("*") if p.is_file())
    _at_once(lambda p: put_file(spark, p, f"{target}/{p.relative_to(source).as_posix()}"), found)
    return len(found)


def is_sealed(spark: SparkSession, folder: str) -> bool:
    return any(p.endswith(f"/{SEAL}") for p, _ in list_files(spark, f"{folder}/{SEAL}", hidden=True))


def seal(spark: SparkSession, folder: str) -> None:
    """Marks a folder as finished: put_tree() and ingest() refuse it from then on."""
    write_text(spark, f"{folder}/{SEAL}", "")


def unseal(spark: SparkSession, folder: str) -> None:
    remove(spark, f"{folder}/{SEAL}")


def refuse_sealed(spark: SparkSession, folder: str) -> None:
    if is_sealed(spark, folder):
        raise ValueError(f"{folder} is sealed")


def ingest(spark: SparkSession, files: Sequence[str | Path], folder: str, meta: dict | None = None, replace: bool = False) -> dict:
    """Copies captures into a data set's folder and merges what its manifest says: files (bytes, sha256) and `meta`.

    A file that is there with the same content is left; with another it is refused, unless `replace`. So is `meta` that
    contradicts the manifest, such as another UTC offset, and a sealed folder. The manifest is written last.
    """
    refuse_sealed(spark, folder)
    known = list_files(spark, f"{folder}/{MANIFEST}", hidden=True)
    manifest = json.loads(read_text(spark, f"{folder}/{MANIFEST}")) if known else {"files": {}}
    for k, v in (meta or {}).items():
        if manifest.get(k, v) != v:
            raise ValueError(f"{k} is {manifest[k]!r} in the manifest, not {v!r}")
    new = {Path(f).name: {"bytes": Path(f).stat().st_size, "sha256": _local_sha(Path(f))} for f in files}
    if len(new) < len(files):
        raise ValueError("two files have one name")
    other = sorted(n for n, x in new.items() if n in manifest["files"] and manifest["files"][n] != x)
    if other and not replace:
        raise ValueError(f"other content is there already: {', '.join(other)}")
    fresh = [f for f in files if manifest["files"].get(Path(f).name) != new[Path(f).name]]
    _at_once(lambda f: put_file(spark, f, f"{folder}/{Path(f).name}"), fresh)
    manifest = manifest | (meta or {}) | {"files": manifest["files"] | new}
    write_json(spark, f"{folder}/{MANIFEST}", manifest)
    return {"copied": [Path(f).name for f in fresh], "replaced": other, "manifest": manifest}
