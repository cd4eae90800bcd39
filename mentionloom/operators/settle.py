"""Stage boundaries of long jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and go on from there.

    What follows uses the rows several times; without a boundary every use would
    plan and run all that came before.  The folder is the one that the session
    names (shared by driver and executors); a local session without one gets one.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="stages-")
        sc.setCheckpointDir(named)
    # Parquet, so that the planner knows the size of what it reads again and loops don't multiply guesses.
    path = f"{sc.getCheckpointDir()}/stage-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
