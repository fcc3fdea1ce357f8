"""Command line: python -m terazi.cli COMMAND ..."""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="terazi")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, text: str):
        c = sub.add_parser(name, help=text)
        c.add_argument("--general", required=True, help="Parquet or CSV of the general table")
        c.add_argument("--allocation", required=True)
        c.add_argument("--format", choices=("parquet", "csv"), default="parquet")
        c.add_argument("--language", choices=("en", "tr"), default="en")
        c.add_argument("--output")
        return c

    report = add("report", "market report")
    compare = add("compare", "table of selected funds")
    for c in (report, compare):
        c.add_argument("--lookback", default="1m")
        c.add_argument("--from", dest="start", help="first day of a window, in place of a look-back")
        c.add_argument("--to", dest="end", help="last day of the window")
        c.add_argument("--include-unpublished", action="store_true")
    compare.add_argument("--funds", required=True, help="codes, separated by commas")
    classify = add("classify", "classification report")
    classify.add_argument("--lookback", default="3m")
    classify.add_argument("--k", type=int)
    classify.add_argument("--model", help="file to save the model to")
    stress = add("stress", "stress signals")
    stress.add_argument("--start", required=True)
    stress.add_argument("--end", required=True)
    stress.add_argument("--event")
    fetch = sub.add_parser("fetch", help="fetch over HTTP into a store")
    fetch.add_argument("--url", required=True)
    fetch.add_argument("--start", required=True)
    fetch.add_argument("--end", default=str(dt.date.today()))
    fetch.add_argument("--type", default="EMK")
    fetch.add_argument("--store", required=True)
    update = sub.add_parser("update", help="fetch what a store lacks, from two days before its last")
    update.add_argument("--url", required=True)
    update.add_argument("--end", default=str(dt.date.today()))
    update.add_argument("--type", default="EMK")
    update.add_argument("--store", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from terazi.config import ClassificationConfig, LensConfig, intervals
    from terazi.operators import lens as ln
    from terazi.operators.classifier import classify
    from terazi.operators.combine import universe_window
    from terazi.operators.stress import stress_signals
    from terazi.reports import markdown as md
    from terazi.sources.readers import load, write_markdown
    from terazi.sources.store import save_snapshot, update_store

    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("terazi").getOrCreate()
    lookback = getattr(a, "lookback", None)
    lookback = int(lookback) if lookback and lookback.isdigit() else lookback
    if a.command == "fetch":
        general, allocation = load(spark, "api", start=a.start, end=a.end, base_url=a.url, fund_type=a.type)
        save_snapshot(general, f"{a.store}/general")
        save_snapshot(allocation, f"{a.store}/allocation")
        return 0
    if a.command == "update":
        update_store(spark, a.store, dt.date.fromisoformat(a.end), a.url, a.type)
        return 0
    general, allocation = load(spark, a.format, general=a.general, allocation=a.allocation)
    if a.command == "classify":
        model, out = classify(allocation, intervals(lookback), ClassificationConfig(k=a.k))
        if a.model:
            model.save(a.model)
        text = md.classification_report(model, out, a.language)
    elif a.command == "stress":
        text = md.stress_report(stress_signals(general, a.start, a.end, a.event), a.language)
    else:
        config = LensConfig(lookback=lookback)
        if a.start or a.end:
            universe = universe_window(general, allocation, a.start, a.end, config, a.include_unpublished)
        else:
            universe = ln.universe(general, allocation, config, a.include_unpublished)
        text = md.market_report(universe, a.language) if a.command == "report" else md.selected_report(universe, a.funds.split(","), a.language)
    if a.output:
        write_markdown(text, a.output)
    else:
        sys.stdout.write(text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
