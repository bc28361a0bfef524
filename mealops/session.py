"""Session helpers.

The session is configured for the engine's needs (UTC, AQE, skew joins,
Arrow) and never starts the web UI. Master, driver host and memory are the
launcher's: they are set here only when the caller asks for a local master
(tests, bench). ``checkpoint_dir`` reads ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files go when the frames that wrote them are garbage.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Dimension sides above this size fall back to a shuffled join.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
LOCAL_CONF = {"spark.driver.host": "127.0.0.1", "spark.driver.bindAddress": "127.0.0.1",
              "spark.driver.memory": "16g"}


def get_session(master: str | None = None, app: str = "mealops",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Return (or create) a configured session.

    Without ``master`` the launcher's master stays (spark-submit and
    spark-defaults.conf set their own).
    """
    builder = SparkSession.builder.appName(app)
    conf = dict(DEFAULT_CONF)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            conf.update(LOCAL_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables: ``spark.checkpoint.dir``.

    Where it is unset, a scratch folder is made on a local master (tests);
    on a cluster an error asks for the setting.
    """
    sc = spark.sparkContext
    cur = (sc.getCheckpointDir()
           or sc.getConf().get("spark.checkpoint.dir", None)
           or spark.conf.get("spark.checkpoint.dir", None))
    if not cur:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        cur = tempfile.mkdtemp(prefix="mealops-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(cur)
    return sc.getCheckpointDir() or cur
