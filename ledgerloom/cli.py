"""python -m ledgerloom.cli load|analyze|summary|correlations|scan|tables|kpis FILE"""

from __future__ import annotations

import argparse

from ledgerloom.functions.text_metrics import text_metrics
from ledgerloom.operators.association import strong_correlations
from ledgerloom.operators.column_state import profile_types
from ledgerloom.operators.profile import categorical_columns, categorical_summary, dataset_summary, missing_values, numeric_columns, numeric_summary, prepare_for_analysis, profile_score, summary_insights
from ledgerloom.operators.scan import full_scan, ranked_findings
from ledgerloom.session import session
from ledgerloom.sources import office
from ledgerloom.sources.loader import load_file


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="ledgerloom")
    p.add_argument("command", choices=["load", "analyze", "summary", "correlations", "scan", "tables", "kpis"])
    p.add_argument("file")
    p.add_argument("-t", "--threshold", type=float, default=0.5)
    p.add_argument("-d", "--show-data", action="store_true", help="with tables: their rows too")
    args = p.parse_args(argv)
    spark = session("ledgerloom-cli")
    if args.command == "kpis":
        lines = spark.read.text(args.file).selectExpr("monotonically_increasing_id() AS line", "value AS text")
        text_metrics(lines, "line", "text").show(50, False)
        return 0
    if args.command == "tables":
        for part, table in office.tables_of(office.read_documents(spark, args.file)).items():
            print(f"{part}: {table.count()} rows, {', '.join(table.columns)}")
            if args.show_data:
                table.show(200, False)
        return 0
    r = load_file(spark, args.file)
    if not r.success:
        print(r.error)
        return 1
    if args.command == "load":
        r.df.printSchema()
        missing_values(r.df).show(200, False)
        profile_types(r.df).select("column", "semantic_type").show(200, False)
        profile_score(r.df).show(1, False)
        return 0
    df = prepare_for_analysis(r.df)
    if args.command == "analyze":
        dataset_summary(df).show(1, False)
        if numeric_columns(df):
            numeric_summary(df).show(200, False)
        if categorical_columns(df):
            categorical_summary(df).show(200, False)
        if len(numeric_columns(df)) > 1:
            strong_correlations(df, args.threshold).show(200, False)
        summary_insights(df).show(200, False)
    elif args.command == "summary":
        numeric_summary(df).show(200, False)
        categorical_summary(df).show(200, False)
    elif args.command == "correlations":
        strong_correlations(df, args.threshold).show(200, False)
    else:
        ranked_findings(full_scan(df)).orderBy("place").show(200, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
