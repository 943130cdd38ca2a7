"""What the corpus operators share: tables, the shared folder, hashing of rows."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables, whole."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, where it isn't installed for them; once a session."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    top = Path(__file__).resolve().parents[1]
    file = Path(tempfile.mkdtemp(prefix="airside-")) / "airside.zip"
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(file))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session without that setting (a local test) gets a temporary folder of its own.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="airside-")
    return _OWN_DIR[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back.

    This cuts the lineage with files that survive a lost executor, and gives steps that
    read the same rows twice one copy of them.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables of at most so many rows are joined as they are: one key's rows are no burden for a task.
SPREAD_FROM = 20_000
#: In larger ones a key with more than HOT_ROWS rows, and more than one in HOT_SHARE of all, is spread over several tasks.
HOT_ROWS, HOT_SHARE = 1000, 1000


def join_hot(rows: DataFrame, table: DataFrame, counts: DataFrame, key: str, spread: str, total: int | None = None) -> DataFrame:
    """Inner join of ``rows`` and ``table`` on ``key`` in which no task gets all rows of a hot key.

    ``counts`` (key, n) says how many rows a key has; ``total`` is their sum, if known. Of hot
    keys there are at most HOT_SHARE, whatever the input, so that they can go to all executors;
    their rows are dealt to several tasks by ``spread``, and what the table has for them is
    repeated for each. The result is that of a plain join.
    """
    total = rows.count() if total is None else total
    if total <= SPREAD_FROM:
        return rows.join(table, key)
    size = max(HOT_ROWS, total // HOT_SHARE)
    hot = materialise(counts.where(F.col("n") > size).select(key, F.ceil(F.col("n") / size).cast("int").alias("_parts")), "hot")
    if hot.isEmpty():
        return rows.join(table, key)
    hot = F.broadcast(hot)
    dealt = rows.join(hot, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    repeated = table.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(repeated, [key, "_part"]).drop("_part")


def sample_texts(rows: DataFrame, n: int, by: DataFrame | None = None) -> DataFrame:
    """At most ``n`` rows of differing ``text``: those of least hash, whatever the partitioning.

    With ``by``, a small table of the values of one column, so many for each of its values and
    none for other values. Only columns text and ``by``'s are kept. Copies of a text count once.
    """
    keys = by.columns if by is not None else []
    rows = rows.where("text IS NOT NULL").select(*keys, "text").withColumn("_hash", F.xxhash64("text"))
    place = F.shiftrightunsigned("_hash", 11) / F.lit(float(1 << 53))
    if by is not None:
        rows = rows.join(F.broadcast(by), keys)
    many = rows.groupBy(*keys).agg(F.approx_count_distinct("_hash", 0.02).alias("_many"))
    shares = F.broadcast(many.select(*keys, (F.lit(2.0 * n) / F.greatest("_many", F.lit(1))).alias("_share")))  # a row for each value of ``by``
    drawn = (rows.join(shares, keys) if keys else rows.crossJoin(shares)).where(place < F.col("_share")).dropDuplicates([*keys, "_hash"])
    if not keys:
        return drawn.orderBy("_hash").limit(n).select("text")
    least = F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))
    return drawn.withColumn("_rn", least).where(F.col("_rn") <= n).select(*keys, "text")
