"""Command line: one sub-command a stage. Every stage is also a function of DataFrames."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubelark.functions.dates import month_index
from cubelark.operators import metrics as M
from cubelark.operators import profile as PR
from cubelark.operators import quality as Q
from cubelark.operators.cube import MONTHLY_KEYS, monthly_cube, reaggregate
from cubelark.plans import canonical, datasets, forecasts, model
from cubelark.session import session
from cubelark.sources import readers, sinks

SEGMENT = ("source_dataset", "region", "occupation_group")
STRICT = ("source_dataset", "country", "region", "occupation_group", "occupation_code", "experience_group", "employment_type", "schedule_type")
DATASETS = {"strict-monthly": datasets.MONTHLY_TARGET, "strict-quarterly": datasets.QUARTERLY_TARGET, "broad-monthly": datasets.BROAD_MONTHLY_TARGET, "broad-quarterly": datasets.BROAD_QUARTERLY_TARGET}


def indexed(cube: DataFrame) -> DataFrame:
    return cube.withColumn("month_idx", month_index(F.to_date(F.concat("vacancy_month", F.lit("-01"))))).where("month_idx is not null")


def build(kind: str, cube: DataFrame) -> DataFrame:
    if kind == "strict-monthly":
        return datasets.strict_monthly(reaggregate(cube, [*STRICT, "month_idx"]), STRICT)
    if kind == "strict-quarterly":
        return datasets.strict_quarterly(cube, STRICT)
    if kind == "broad-monthly":
        return datasets.broad_monthly(cube, SEGMENT, ["country", "federal_district"])
    return datasets.broad_quarterly(cube, SEGMENT, ["country", "federal_district"])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cubelark")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("input")
        c.add_argument("--output")
        c.add_argument("--no-save", action="store_true", help="print the result instead of writing it")
        for o in options:
            c.add_argument(f"--{o}")
        return c

    command("process-source", "source", "sample-rows")
    command("merge-sources")
    command("aggregate")
    command("profile")
    command("audit", "cube")
    command("readiness")
    command("prepare", "kind")
    command("baseline", "kind")
    command("train", "kind")
    command("tune", "kind", "grid")
    command("backtest", "kind", "periods")
    command("tune-backtest", "kind", "periods", "grid")
    command("ensemble", "kind", "periods")
    command("transitions", "kind")
    command("search", "kind", "periods", "grid", "stages")
    command("residual-search", "kind", "periods", "grid", "stages")
    command("fold-errors", "target", "model", "baseline", "keys", "min-rows")
    command("fold-findings", "target", "model", "baseline", "keys")
    command("errors", "target", "model", "keys")
    command("markdown", "title")
    command("excel")
    command("evaluate", "target", "model", "baseline", "keys")
    return p


def main(argv: list[str] | None = None) -> DataFrame | None:
    a = parser().parse_args(argv)
    spark = session()
    if a.command == "process-source":
        raw = readers.read_source(spark, a.source, readers.require_path(spark, a.input), int(a.sample_rows) if a.sample_rows else None)
        out = canonical.process_source(raw, a.source).records
    elif a.command == "merge-sources":
        frames = {p: spark.read.parquet(readers.require_path(spark, p)) for p in a.input.split(",")}
        out = canonical.merge_sources(frames)
    else:
        df = spark.read.parquet(readers.require_path(spark, a.input))
        if a.command == "aggregate":
            out = monthly_cube(df, MONTHLY_KEYS)
        elif a.command == "profile":
            out = PR.missing_values(df)
        elif a.command == "audit":
            out = Q.validate_result(df, spark.read.parquet(a.cube)) if a.cube else Q.merge_audit(df)
        elif a.command == "readiness":
            out = Q.readiness(reaggregate(indexed(df), [*STRICT, "month_idx"]), STRICT, "month_idx")
        elif a.command == "prepare":
            out = build(a.kind, indexed(df))
        elif a.command == "evaluate":
            out = M.compare(df, a.target, a.model, a.baseline, a.keys.split(","))
        elif a.command in ("fold-errors", "fold-findings"):
            sets = [k.split("+") for k in a.keys.split(",")]
            groups = M.group_error_sets(df, a.target, a.model, a.baseline, sets, int(getattr(a, "min_rows", None) or 1))
            out = groups if a.command == "fold-errors" else M.findings(df, groups, a.target, a.model, a.baseline)
        elif a.command == "errors":
            out = M.group_errors(df, a.target, a.model, a.keys.split(","))
        elif a.command == "markdown":
            print(sinks.markdown(df, a.title or a.input))
            return df
        elif a.command == "excel":
            sinks.write_excel_csv(df, a.output)
            return df
        else:
            order, target = ("month_idx", DATASETS[a.kind]) if "monthly" in a.kind else ("quarter_idx", DATASETS[a.kind])
            numeric = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "bigint", "int") and not f.name.startswith(("target", "gap_to")) and f.name != order]
            categorical = [c for c in SEGMENT if c in df.columns]
            if a.command == "baseline":
                out = M.evaluate(M.time_split(df, order), target, "median_salary_mid", ["split"])
            elif a.command == "train":
                rows = M.time_split(df, order)
                fitted = model.fit(rows, target, numeric, categorical)
                if a.output and not a.no_save:
                    model.save_artefacts(fitted, spark, f"{a.output}-artefacts", numeric, categorical, {})
                print(json.dumps(model.importances(fitted, numeric, categorical)[:20], ensure_ascii=False))
                out = model.predict(fitted, rows, numeric, categorical)
            elif a.command == "tune":
                found = model.grid_search(M.time_split(df, order), target, numeric, categorical, json.loads(a.grid))
                out = spark.createDataFrame([{k: float(v) for k, v in r.items()} for r in found])
            elif a.command == "transitions":
                out = M.evaluate(df, target, "median_salary_mid", ["quarter_transition"])
            else:
                periods = [int(p) for p in a.periods.split(",")]
                if a.command in ("search", "residual-search"):
                    grid, gap = json.loads(a.grid), "gap_to_target_months" if order == "month_idx" else "gap_to_target_quarters"
                    gap = gap if gap in df.columns else None
                    values = {f"{c}_value": [c] for c in categorical} | {"segment_value": categorical}
                    scores = forecasts.backtest_scores(df, target, "median_salary_mid", order, gap, periods, grid, [int(n) for n in a.stages.split(",")], a.command == "residual-search", numeric, values)
                    out = forecasts.searched(scores, grid)
                elif a.command == "tune-backtest":
                    out = model.backtest_search(df, target, numeric, categorical, order, periods, json.loads(a.grid), "median_salary_mid")
                elif a.command == "ensemble":
                    folds = model.fold_predictions(df, target, numeric, categorical, order, periods)
                    scores = M.evaluate_strategies(folds, target, M.strategies(F.col("prediction"), F.col("median_salary_mid")), ["fold"])
                    out = M.fold_summary(scores, ["strategy"], "fold").orderBy("mean_mape", "worst_mape", "strategy")
                else:
                    out = model.backtest(df, target, numeric, categorical, order, periods)
    if a.output and not a.no_save:
        sinks.write_parquet(out, a.output)
    else:
        print(sinks.markdown(out, a.command))
    return out


if __name__ == "__main__":
    main()
