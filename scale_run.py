"""Time the whole preparation on a replicated table: ``scale_run.py [copies] [folder]``.

The ``conversations`` table is repeated with shifted ids and marked texts, and
one extra conversation gets half as many turns again, so that a third of all
turns belong to it. Prints seconds and rates as JSON lines.
"""

from __future__ import annotations

import json
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from chatsieve.plans.prepare import prepare_jsonl, prepare_turns
from chatsieve.sources.jsonl import to_lines
from chatsieve.sources.turns import assemble, read_turns

SOURCE = "/root/testdata/sf0.1/conversations.parquet"
HOT_ID = -1


def main() -> None:
    copies = int(sys.argv[1]) if len(sys.argv) > 1 else 200
    folder = sys.argv[2] if len(sys.argv) > 2 else tempfile.mkdtemp(prefix="run-")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", "64")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    source = read_turns(spark, SOURCE)
    step = source.selectExpr("max(conv_id) + 1").first()[0]
    repeated = source.selectExpr(
        f"explode(sequence(0, {copies - 1})) AS copy", "*"
    ).selectExpr(
        f"conv_id + copy * {step} AS conv_id", "turn", "role",
        "concat(content, ' #', copy) AS content",
    )
    hot_turns = repeated.count() // 2
    hot = (
        spark.range(hot_turns)
        .selectExpr("id AS turn", "id % 2 = 1 AS said")
        .selectExpr(
            f"{HOT_ID}L AS conv_id",
            "turn",
            "IF(said, 'assistant', 'user') AS role",
            "array_join(transform(sequence(1, 60),"
            " i -> concat('w', pmod(hash(turn, i), 1000000))), ' ') AS content",
        )
    )
    table, lines = f"{folder}/turns", f"{folder}/lines"
    repeated.unionAll(hot).repartition(32, "conv_id", "turn").write.parquet(table)
    to_lines(assemble(repeated)).select("raw").write.text(lines)
    turns = spark.read.parquet(table)
    n = turns.count()

    start = time.time()
    done = prepare_turns(turns, f"{folder}/out_turns", min_quality=0.4)
    seconds = time.time() - start
    print(
        json.dumps(
            {
                "plan": "prepare_turns", "turns": n, "hot_share": hot_turns / n,
                "seconds": round(seconds, 1), "turns_per_second": round(n / seconds),
                "counters": done.counters.first().asDict(),
            }
        ),
        flush=True,
    )
    start = time.time()
    done = prepare_jsonl(spark, lines, f"{folder}/out_lines", min_quality=0.4)
    seconds = time.time() - start
    total = done.counters.first().asDict()
    print(
        json.dumps(
            {
                "plan": "prepare_jsonl", "lines": total["total_raw"],
                "seconds": round(seconds, 1),
                "lines_per_second": round(total["total_raw"] / seconds),
                "counters": total,
            }
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()
