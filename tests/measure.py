"""What a session's stages have moved so far."""

import time


def shuffled_rows(spark) -> int:
    """Rows written to shuffles."""
    return sum(s.shuffleWriteRecords() for s in _stages(spark))


def moved_bytes(spark) -> int:
    """Bytes written to shuffles and tables, and spilled."""
    return sum(s.shuffleWriteBytes() + s.outputBytes() + s.diskBytesSpilled() for s in _stages(spark))


def _stages(spark):
    time.sleep(1)  # the store is told of a stage's end a little later
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return [stages.apply(k) for k in range(stages.size())]
