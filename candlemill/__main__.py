"""The jobs as one command, for spark-submit or ``python -m candlemill``.

    day    --source 's3a://lake/in/*.zip' --root s3a://lake --date 2025-10-01 [--symbols BTCUSDT]
    range  --source ... --root ... --start 2025-10-01 --end 2025-10-31 [--scope continuous]
    stream --servers kafka:9092 --topic aggtrades-topic --partitions 0 1 2 3 --alerts-topic engulfings-topic --root ...
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from datetime import date

from candlemill.plans.jobs import run_range
from candlemill.session import drop_staged, session
from candlemill.sources.streams import read_trades_by_partition
from candlemill.streaming.jobs import start_pattern_job


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="candlemill")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("day", "range"):
        job = jobs.add_parser(name)
        job.add_argument("--source", required=True)
        job.add_argument("--root", required=True)
        job.add_argument("--symbols", nargs="*")
        job.add_argument("--interval", type=int, default=900)
        job.add_argument("--format", choices=("csv", "zip"))
        job.add_argument("--unit", default="us", choices=("s", "ms", "us", "ns"))
        job.add_argument("--ids-follow-time", action="store_true")
        if name == "day":
            job.add_argument("--date", type=date.fromisoformat, required=True)
        else:
            job.add_argument("--start", type=date.fromisoformat)
            job.add_argument("--end", type=date.fromisoformat)
            job.add_argument("--scope", default="day", choices=("day", "continuous"))
    stream = jobs.add_parser("stream")
    stream.add_argument("--servers", required=True)
    stream.add_argument("--topic", required=True)
    # each partition has a watermark of its own: a symbol that runs behind loses nothing
    stream.add_argument("--partitions", type=int, nargs="+", required=True)
    stream.add_argument("--max-offsets", type=int, help="messages of a partition in one micro-batch")
    stream.add_argument("--alerts-topic", required=True)
    stream.add_argument("--root", required=True)
    stream.add_argument("--interval", default="15 minutes")
    stream.add_argument("--delay", default="5 seconds")
    stream.add_argument("--parallelism", type=int)
    return parser.parse_args(argv)


def main(argv: Sequence[str] | None = None) -> None:
    args = arguments(argv)
    spark = session(f"candlemill {args.job}")
    if args.job == "stream":
        trades = read_trades_by_partition(
            spark, args.servers, args.topic, args.partitions, max_offsets=args.max_offsets)
        start_pattern_job(
            trades, f"{args.root}/klines", f"{args.root}/engulfings", args.alerts_topic,
            f"{args.root}/checkpoint", args.interval, args.delay, alerts_format="kafka",
            alerts_options={"kafka.bootstrap.servers": args.servers}, parallelism=args.parallelism,
        ).awaitTermination()
        return
    start, end = (args.date, args.date) if args.job == "day" else (args.start, args.end)
    try:
        run_range(
            spark, args.source, args.root, start, end, args.symbols or None,
            getattr(args, "scope", "day"), args.interval, args.unit, args.ids_follow_time, args.format,
        )
    finally:
        drop_staged(spark)


if __name__ == "__main__":
    main()
