"""The capture store: a parquet table partitioned by model_id, key-prefix reads, guarded SQL, and file keys."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CAPTURES, HOOKS, KEY, stored_name
from ..shared import delete, numbered
from .codec import token_rows

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
# Ports of the HTTP interface.
HTTP_PORTS = (8123, 8443)
CODECS = {"none": "none", "lz4": "lz4_raw", "zstd": "zstd"}
#: Session settings that a caller may pass.
SETTINGS = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold")


def check_identifier(name: str) -> str:
    if not _IDENTIFIER.fullmatch(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def check_port(port: int) -> int:
    """A port of the native protocol: those that stores of this kind keep for HTTP are refused."""
    if port in HTTP_PORTS or not 0 < port < 65536:
        raise ValueError(f"not a native port: {port}")
    return port


def names_matching(predicate: Callable[[str], bool] | str) -> list[str]:
    """Stored act names of the catalog that a function accepts, or that a regular expression matches whole."""
    test = predicate if callable(predicate) else re.compile(predicate).fullmatch
    return [n for n in (stored_name(h[1], h[3]) for h in HOOKS) if test(n)]


def apply_settings(spark: SparkSession, settings: dict) -> None:
    """Sets allowed session settings; values are str, int or bool."""
    for k, v in settings.items():
        if k not in SETTINGS:
            raise ValueError(f"setting {k!r} is not allowed")
        if not isinstance(v, (str, int)):
            raise TypeError(f"setting {k!r}: {type(v).__name__}")
        spark.conf.set(k, str(v).lower() if isinstance(v, bool) else str(v))


class CaptureStore:
    """One table of captures below a path; slots are values of model_id."""

    def __init__(self, spark: SparkSession, path: str, compression: str = "zstd"):
        if compression not in CODECS:
            raise ValueError(f"unknown compression {compression!r}")
        check_identifier(path.rstrip("/").rpartition("/")[2])
        self.spark, self.path, self.compression = spark, path.rstrip("/"), compression

    def _delete(self, path: str) -> bool:
        if not path.startswith(self.path):
            raise ValueError("outside the store")
        return delete(self.spark, path)

    def create(self, drop_existing: bool = False) -> None:
        if drop_existing:
            self._delete(self.path)
        empty = self.spark.createDataFrame([], CAPTURES)
        empty.write.mode("ignore").partitionBy("model_id").parquet(self.path)

    def insert(self, rows: DataFrame) -> None:
        """Appends rows with elements; sorted within files by key so that row groups can be skipped."""
        rows = rows.where("size(shape) > 0 and length(bytes) > 0").select(*[f.split()[0] for f in CAPTURES.split(", ")])
        rows.sortWithinPartitions(*KEY).write.mode("append").option("compression", CODECS[self.compression]).partitionBy("model_id").parquet(self.path)

    def submit(self, model_id: str, shard_rank: int, request_id: str, act_name: str, layer_no: int, start: int, end: int, dtype: str, shape: list[int], payload: bytes) -> bool:
        """One row; False (and nothing written) if it has no elements. For single rows: many belong into one insert."""
        if not payload or not shape:
            return False
        self.insert(self.spark.createDataFrame([(model_id, request_id, act_name, layer_no, shard_rank, start, end, dtype, list(shape), payload)], CAPTURES))
        return True

    def discard(self, rows: DataFrame) -> None:
        """Runs rows to their end and keeps nothing: transport alone."""
        rows.write.format("noop").mode("overwrite").save()

    def read(self) -> DataFrame:
        return self.spark.read.schema(CAPTURES).parquet(self.path)

    def scan(self, model_id: str) -> DataFrame:
        """All rows of a slot in the order of the key without model_id; only the slot's files are read."""
        return self.read().where(F.col("model_id") == model_id).orderBy(*KEY[1:]).drop("model_id")

    def tokens(self, model_id: str, request_ids: list[str] | None = None, act_names: list[str] | None = None, predicate: Callable[[str], bool] | str | None = None) -> DataFrame:
        """Token rows of a slot, filtered by request and act at the scan. predicate picks acts by a function or a pattern over the
        names of the hook catalog."""
        rows = self.read().where((F.col("model_id") == model_id) & (F.col("end_token_idx") > F.col("start_token_idx")))
        rows = rows.where(F.col("request_id").isin(*request_ids)) if request_ids else rows
        if predicate is not None:
            act_names = sorted(set(act_names or names_matching(predicate)) & set(names_matching(predicate)))
        return token_rows(rows.where(F.col("act_name").isin(*act_names)) if act_names is not None else rows)

    def wipe(self, model_id: str) -> bool:
        """Removes one slot; False if there was none. Other slots stay."""
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(model_id)
        return self._delete(f"{self.path}/model_id={escaped}")


def prefix_get(rows: DataFrame, prefix: tuple, full_key: bool = True) -> DataFrame:
    """Rows whose first key columns equal prefix, in key order. The equalities reach the scan."""
    if not isinstance(prefix, tuple):
        raise TypeError("the prefix is a tuple")
    if not prefix or len(prefix) > len(KEY):
        raise ValueError("the prefix has 1 to 7 values")
    for c, v in zip(KEY, prefix, strict=False):
        rows = rows.where(F.col(c) == F.lit(v))
    rows = rows.orderBy(*KEY)
    return rows if full_key else rows.drop(*KEY)


def custom_select(spark: SparkSession, text: str, params: dict | None = None, **tables: DataFrame) -> DataFrame:
    """SQL that starts with SELECT, with named parameters; {name} in the text stands for a DataFrame given under that name."""
    if not text.lstrip().upper().startswith("SELECT"):
        raise ValueError("the query must start with SELECT")
    return spark.sql(text, args=params or {}, **tables)


def scan_act(rows: DataFrame, model_id: str, act_name: str) -> DataFrame:
    return rows.where((F.col("model_id") == model_id) & (F.col("act_name") == act_name)).orderBy("layer_no", "start_token_idx")


def path_key(path: Column) -> Column:
    """<request>/<hook>[_L<layer>]_T<start>_<end>[_SR<rank>].<ext> -> key fields."""
    pattern = r"([^/]+)/([^/]+?)(?:_L(\d+))?_T(\d+)_(\d+)(?:_SR(\d+))?\.\w+$"

    def part(i: int) -> Column:
        return F.regexp_extract(path, pattern, i)

    def number(i: int, default: int) -> Column:
        return F.coalesce(F.nullif(part(i), F.lit("")).cast("int"), F.lit(default))

    return F.struct(part(1).alias("request_id"), part(2).alias("hook"), number(3, -1).alias("layer_no"), number(4, 0).alias("start_idx"), number(5, 0).alias("end_idx"), number(6, 0).alias("shard_rank"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(prompt) of a text file: stripped, blank lines dropped; none left raises ValueError."""
    lines = spark.read.text(path).select(F.trim("value", F.lit(" \t\r\n")).alias("prompt")).where("prompt <> ''")
    if not lines.take(1):
        raise ValueError(f"no prompts in {path}")
    return lines


def prompt_batches(prompts: DataFrame, size: int, order: list[str]) -> DataFrame:
    """Consecutive batches of ``size`` non-blank prompts, by a given order."""
    rows = prompts.where("prompt <> ''")
    return numbered(rows, order, "batch").withColumn("batch", F.floor(F.col("batch") / size).cast("long"))


def request_parts(request: Column) -> Column:
    """<group>:<index>; anything else raises when the row is reached."""
    ok = request.rlike(r"^\d+:\d+$")
    parts = F.split(F.when(ok, request).otherwise(F.raise_error(F.concat(F.lit("bad request id "), request)).cast("string")), ":")
    return F.struct(F.get(parts, F.lit(0)).cast("int").alias("grp"), F.get(parts, F.lit(1)).cast("int").alias("idx"))


def delta_tokens(act_name: Column, shape: Column) -> Column:
    """Tokens of a chunk: the second last dimension of attention matrices, else the first."""
    return F.when(act_name.rlike("hook_(attn_scores|pattern)$"), F.element_at(shape, -2)).otherwise(F.element_at(shape, 1))
