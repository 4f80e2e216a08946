"""Command line: ``spark-submit -m`` style training run.

    python -m tidepool --events events.csv --properties1 p1.csv --categories tree.csv --output models
"""

from __future__ import annotations

import argparse
import logging
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tidepool.config import Params
from tidepool.plans.evaluate import leave_one_out
from tidepool.plans.model import Model
from tidepool.plans.training import Trainer
from tidepool.session import build_session
from tidepool.sources.artifacts import ArtifactStore
from tidepool.sources.tables import events_schema, is_parquet, properties_schema, quarantined, read_events, read_properties, read_tree

log = logging.getLogger("tidepool")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidepool", description="Train and judge a blended recommender on Spark.")
    p.add_argument("--events", required=True, help="event log, CSV or Parquet")
    p.add_argument("--properties1", help="item properties, first part")
    p.add_argument("--properties2", help="item properties, second part")
    p.add_argument("--categories", help="category tree")
    p.add_argument("--output", default="./models", help="folder for the model's tables")
    p.add_argument("--factors", type=int, default=Params.factors)
    p.add_argument("--iterations", type=int, default=Params.iterations)
    p.add_argument("--regularization", type=float, default=Params.regularization)
    p.add_argument("--simple", action="store_true", help="factors only, 50 factors and 5 iterations")
    p.add_argument("--jobs", type=int, help="accepted for compatibility; Spark decides the parallelism")
    p.add_argument("--no-reuse", action="store_true", help="recompute every stage")
    p.add_argument("--holdout", default="in_sample", choices=("in_sample", "leave_one_out"),
                   help="judge on events that training saw, or train without each user's newest event")
    p.add_argument("--neighbors", default=Params.neighbor_search, choices=("exact", "forest", "index"),
                   help="how similar items are searched; index saves a neighbour index with the model")
    p.add_argument("--format", choices=("csv", "parquet"), help="input format; default: by the suffix of the path")
    p.add_argument("--unit", default="ms", choices=("s", "ms", "us"), help="unit of epoch timestamps")
    return p


def report_bad_rows(spark: SparkSession, args: argparse.Namespace) -> int:
    """Saves the cells that do not fit their type as the table ``quarantine`` of the output folder; returns the number of their rows."""
    files = [args.events] if args.simple else [args.events, *filter(None, (args.properties1, args.properties2))]
    schemas = {path: events_schema() if path == args.events else properties_schema(spark, path) for path in files if not is_parquet(path, args.format)}
    found = [quarantined(spark, path, schema) for path, schema in schemas.items()]
    if not found:
        return 0
    bad = ArtifactStore(spark, args.output).save("quarantine", reduce(DataFrame.unionByName, found), "none")
    rows = bad.select("file", "line").distinct().count()
    if rows:
        log.warning("%d rows with cells that do not fit their type are left out; see %s/quarantine", rows, args.output)
    return rows


def run(spark: SparkSession, args: argparse.Namespace) -> Model:
    report_bad_rows(spark, args)
    events = read_events(spark, args.events, args.unit, args.format)
    known = leave_one_out(events) if args.holdout == "leave_one_out" else events
    if args.simple:
        model = Trainer(spark, args.output, Params.simple(), not args.no_reuse).fit_simple(known)
    else:
        params = Params(factors=args.factors, iterations=args.iterations, regularization=args.regularization, neighbor_search=args.neighbors)
        properties = read_properties(spark, [args.properties1, args.properties2], args.unit, args.format)
        trainer = Trainer(spark, args.output, params, not args.no_reuse)
        model = trainer.fit(known, properties, read_tree(spark, args.categories, args.format))
        log.info("evaluation (%s): %s", args.holdout, model.evaluate(events).first().asDict())
    first_user = model.tables["user_index"].where("user_idx = 0").select("user_id")
    for row in model.user_reports(first_user, 5).collect():
        print(row.report)
    return model


def main(argv: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = build_session()
    try:
        run(spark, parser().parse_args(argv))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
