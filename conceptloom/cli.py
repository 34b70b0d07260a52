"""Command line: download, sequences, days, glove, embeddings."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from datetime import date

from conceptloom.config import read_database
from conceptloom.session import session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="conceptloom")
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, text: str) -> argparse.ArgumentParser:
        return jobs.add_parser(name, help=text)

    p = job("download", "database tables to Parquet")
    p.add_argument("-c", "--credential-path", required=True)
    p.add_argument("-tc", "--tables", nargs="+", required=True)
    p.add_argument("-o", "--output-folder", required=True)
    for name, text in (("sequences", "ordered sequences, embeddings and distances"), ("days", "sequences by day")):
        p = job(name, text)
        p.add_argument("-i", "--input-folder", required=True)
        p.add_argument("-o", "--output-folder", required=True)
        p.add_argument("-t", "--tables", nargs="+", required=True)
        p.add_argument("-s", "--start-year", type=int, default=1985)
        p.add_argument("--end-date", default=date.today().isoformat())
        if name == "sequences":
            p.add_argument("-v", "--visit", action="store_true")
            p.add_argument("-n", "--dimensions", type=int, default=200)
            p.add_argument("-e", "--epochs", type=int, default=100)
            p.add_argument("-w", "--window-size", type=int, default=60)
            p.add_argument("-sw", "--sub-window-size", type=int, default=30)
    p = job("glove", "a corpus of sequences to embeddings")
    p.add_argument("-i", "--input-folder", required=True)
    p.add_argument("-o", "--output-folder", required=True)
    p.add_argument("-n", "--dimensions", type=int, default=200)
    p.add_argument("-e", "--epochs", type=int, default=100)
    p.add_argument("-w", "--window-size", type=int, default=10)
    p = job("embeddings", "a dictionary and vectors to embeddings by concept")
    p.add_argument("-g", "--vector-folder", required=True)
    p.add_argument("-o", "--output-folder", required=True)
    return top


def main(argv: Sequence[str] | None = None) -> None:
    from pyspark.sql import functions as F

    from conceptloom.operators.embeddings import with_dictionary
    from conceptloom.plans import jobs
    from conceptloom.sources import files, jdbc

    args = parser().parse_args(argv)
    spark = session()
    if args.job == "download":
        jdbc.download(spark, read_database(args.credential_path), args.tables, args.output_folder)
    elif args.job in ("sequences", "days"):
        read = lambda name: spark.read.parquet(f"{args.input_folder}/{name}")
        tables, start = [read(t) for t in args.tables], f"{args.start_year}-01-01"
        vocabulary = {"concept": read("concept"), "closure": read("concept_ancestor")} if "drug_exposure" in args.tables else {}
        if args.job == "days":
            files.write_lines(jobs.day_sequences(tables, start, args.end_date, **vocabulary), f"{args.output_folder}/day_sequences")
            return
        rows = jobs.patient_sequences(tables, start, args.end_date, args.window_size, args.sub_window_size, args.visit, **vocabulary)
        jobs.write_sequences(rows, args.output_folder)
        files.write_parquet(jobs.sequence_embeddings(rows, args.dimensions, args.epochs), f"{args.output_folder}/embedding")
        jobs.distance_matrices(spark.read.parquet(f"{args.output_folder}/embedding"), args.output_folder)
    elif args.job == "glove":
        rows = files.read_corpus(spark, args.input_folder).select(F.transform("words", lambda w: w.cast("bigint")).alias("concepts"))
        files.write_parquet(jobs.sequence_embeddings(rows, args.dimensions, args.epochs, args.window_size), f"{args.output_folder}/embedding")
    else:
        read = lambda name: spark.read.parquet(f"{args.vector_folder}/{name}")
        files.write_parquet(with_dictionary(read("dictionary"), read("vectors")), f"{args.output_folder}/embedding")


if __name__ == "__main__":
    main()
