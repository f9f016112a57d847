"""Command line: analyze, mask, restore and list-types over files or Parquet tables."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veilspark.functions import masks, patterns
from veilspark.operators import batch, report
from veilspark.operators.detect import detect, without_excluded
from veilspark.sources import files, sinks


def _types(text: str | None) -> list[str]:
    return [t.strip() for t in (text or "").split(",") if t.strip()]


def _docs(spark, args):
    if args.input.endswith(".parquet"):
        return spark.read.parquet(args.input)
    return files.read_files(spark, args.input).withColumnRenamed("path", "doc_id")


def _json(path: str | None):
    return json.loads(Path(path).read_text(encoding="utf-8")) if path else None


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="veilspark", description=__doc__)
    sub = top.add_subparsers(dest="verb", required=True)
    for verb in ("analyze", "mask", "restore", "list-types"):
        p = sub.add_parser(verb)
        if verb != "list-types":
            p.add_argument("input", help="a file, a folder of files, or a Parquet table with doc_id and text")
            p.add_argument("-o", "--output", help="folder for the output; without it rows are shown")
        if verb in ("analyze", "mask"):
            p.add_argument("--only")
            p.add_argument("--exclude")
            p.add_argument("-e", "--entities", help="JSON list of {type, name}, or a file with one")
            p.add_argument("--no-entities", action="store_true", help="patterns and dictionary only")
        if verb == "analyze":
            p.add_argument("--context", action="store_true", help="show what stands around findings, and all of them")
            p.add_argument("--context-window", type=int, default=40)
        if verb == "mask":
            p.add_argument("--mask-strategy", help="type=partial or type=placeholder, comma-separated")
            p.add_argument("--all-strategy", choices=("partial", "placeholder"))
            p.add_argument("--style", choices=tuple(masks.STYLES), default="english_bracket")
            p.add_argument("--excluded", help="file with a JSON list of {type, name} that stay")
            p.add_argument("--abbreviations", help="file with a JSON object of reviewed short to full names")
            p.add_argument("--mapping", help="folder, not that of the output, for the mapping; without it none is written")
            p.add_argument("--format", choices=("parquet", "files"), default="parquet")
        if verb == "restore":
            p.add_argument("--mapping", required=True, help="JSON file of a mapping, or a folder that mask has written")
    args = top.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.verb == "list-types":
        for s in patterns.SPECS:
            print(f"{s.etype}\t{s.label}")
        return 0
    docs = _docs(spark, args)
    mapping = None
    if args.verb == "restore":
        out = restored(docs, args.mapping)
    else:
        entities = Path(args.entities).read_text(encoding="utf-8") if args.entities and Path(args.entities).is_file() else args.entities
        found = detect(docs, files.parse_dictionary(entities), _types(args.only), _types(args.exclude), entities=not args.no_entities)
        if args.verb == "analyze":
            out = report.findings(found, window=args.context_window)
            out = out if args.context else report.top_examples(out).drop("context")
        else:
            gone, short = _json(args.excluded), _json(args.abbreviations)
            found = without_excluded(found, [(x["type"], x["name"]) for x in gone or ()])
            if short is not None:
                found = found.withColumn("abbreviations", F.from_json(F.lit(json.dumps(short)), "map<string,string>"))
            chosen = dict(x.split("=", 1) for x in _types(args.mask_strategy))
            done = masks.masked(found, overrides=chosen, everything=args.all_strategy, style=args.style, abbreviations="abbreviations")
            out, mapping = done.select("doc_id", "masked_text"), done  # originals and the mapping stay out of the output
    if args.output and args.verb == "mask" and args.format == "files":
        sinks.write_texts(out, args.output, "doc_id", base=args.input)
    elif args.output:
        out.write.mode("overwrite").parquet(args.output)
    else:
        for row in out.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
            print(json.dumps(json.loads(row["j"]), ensure_ascii=False))
    if mapping is not None and args.mapping:
        if args.output and (args.mapping.rstrip("/") + "/").startswith(args.output.rstrip("/") + "/"):
            raise SystemExit("the mapping must not be in the folder of the output")
        sinks.write_mapping(mapping, args.mapping)
    return 0


def restored(docs, place: str):
    """doc_id, restored_text of masked documents (masked_text, or text of files) with the mapping at a place: one JSON
    object for all, or a folder of rows by doc_id."""
    text = "masked_text" if "masked_text" in docs.columns else "text"
    if Path(place).is_file():
        pairs = masks.flat_mapping(json.loads(Path(place).read_text(encoding="utf-8")))
        return batch.restore_report(docs, list(pairs.items()), "doc_id", text)
    rows = docs.sparkSession.read.json(place, schema="doc_id string, mapping string").select("doc_id", F.from_json("mapping", f"map<string,{masks.FACT}>").alias("mapping"))
    both = docs.withColumn("_id", F.col("doc_id").cast("string")).join(rows.withColumnRenamed("doc_id", "_id"), "_id", "left")
    return masks.restored(both, "mapping", text).select("doc_id", "restored_text")


if __name__ == "__main__":
    raise SystemExit(main())
