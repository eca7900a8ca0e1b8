"""How many rows a query shuffles, from Spark's own counters."""

import re


def shuffled_rows(spark, run) -> int:
    def total() -> int:
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def joins_by_broadcast(spark, run) -> set[str]:
    """The kinds of joins in ``run`` of which one side goes through the driver, from Spark's own list of executions."""
    store = spark._jsparkSession.sharedState().statusStore()
    held = lambda: [store.executionsList().apply(i) for i in range(store.executionsList().size())]
    last = max((e.executionId() for e in held()), default=-1)  # old ones are dropped in time
    run()
    plans = [e.physicalPlanDescription() for e in held() if e.executionId() > last]
    return {kind for p in plans for kind in re.findall(r"BroadcastHashJoin (\w+)", p)}
