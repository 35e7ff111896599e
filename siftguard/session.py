"""Session helpers: recommended settings, small dimension tables, shared work folders."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Lists up to this many rows stay in the plan.
MAX_DIMENSION_ROWS = 20_000


def build_session(app_name: str = "siftguard", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library is tuned for."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Recording a Python call site per column costs more than planning these queries.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # Rows that go to Python carry whole files, so batches are bounded by bytes as well.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_packages(spark: SparkSession, *packages) -> None:
    """Send packages to the Python workers of a session, once.

    Needed where the library is not installed on the executors: user scanners and syntax
    facts run there and import it. The driver serves the archive to every executor.
    """
    context = spark.sparkContext
    sent = _SHIPPED.setdefault(context.applicationId, set())
    for package in packages:
        if package.__name__ in sent:
            continue
        source = Path(package.__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="ship-")) / f"{package.__name__}.zip"
        with zipfile.ZipFile(archive, "w") as bundle:
            for file in sorted(source.rglob("*.py")):
                bundle.write(file, file.relative_to(source.parent))
        context.addPyFile(str(archive))
        sent.add(package.__name__)


_SHIPPED: dict[str, set[str]] = {}


def dimension(spark: SparkSession, rows: list[dict], schema: StructType) -> DataFrame:
    """A driver-side list as a relation whose exact size Spark knows.

    No broadcast hint is set: the planner broadcasts the table while its size is under
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise. A list of more than ``MAX_DIMENSION_ROWS`` is
    written to the shared folder, so that plans do not carry it.
    """
    if not rows:
        return spark.createDataFrame([], schema).limit(0)
    from pyspark.sql.pandas.types import to_arrow_schema
    table = spark.createDataFrame(pa.Table.from_pylist(rows, schema=to_arrow_schema(schema)), schema)
    if len(rows) <= MAX_DIMENSION_ROWS:
        return table
    path = work_dir(spark, "dimension")
    table.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def spread_small(table: DataFrame, key: str) -> DataFrame:
    """Spread a stored table that arrives in fewer splits than the session has cores.

    Meant for plain table reads in front of costly expressions. A large table has more splits
    than cores and stays as it is, so nothing big is ever shuffled. ``key`` must be unique.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores, key) if table.rdd.getNumPartitions() < cores else table


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared checkpoint folder of the cluster.

    The folder comes from ``spark.checkpoint.dir``. A machine-local temporary folder
    stands in for it only when the session itself runs on one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="siftguard-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
