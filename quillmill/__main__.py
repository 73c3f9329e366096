"""Command line: ``python -m quillmill clean|chunk|index|search|cost ...`` (or with spark-submit). Exit code 1 on failure."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillmill import engine
from quillmill.functions import quality as Q
from quillmill.functions import text as T
from quillmill.functions.embedding import HashProvider
from quillmill.operators import costs
from quillmill.operators.index import Collection
from quillmill.operators.search import RetrievalFilter
from quillmill.runtime import materialize
from quillmill.settings import QuillmillError, Settings, setup_logging
from quillmill.sources import files


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quillmill", description=__doc__)
    verbs = out.add_subparsers(dest="verb", required=True)
    clean = verbs.add_parser("clean", help="text or PDF files to clean texts and quality reports")
    clean.add_argument("path")
    clean.add_argument("out")
    clean.add_argument("--pdf", action="store_true")
    clean.add_argument("--text-files", action="store_true", help="texts as a folder with a text file for each document instead of Parquet")
    clean.add_argument("--fail-on-low-quality", action="store_true")
    chunk = verbs.add_parser("chunk", help="text files to chunk lines")
    chunk.add_argument("path")
    chunk.add_argument("out")
    chunk.add_argument("--chunker", default="semantic", choices=["semantic", "sentence", "sliding"])
    chunk.add_argument("--chunk-size", type=int)
    chunk.add_argument("--overlap", type=int, help="words that sliding chunks share")
    chunk.add_argument("--clean", action="store_true", help="clean the texts first; chunks then carry their quality")
    index = verbs.add_parser("index", help="chunk lines into the index")
    index.add_argument("path")
    search = verbs.add_parser("search", help="the best chunks for a query")
    search.add_argument("query")
    search.add_argument("--top-k", type=int)
    search.add_argument("--threshold", type=float)
    search.add_argument("--per-document", type=int, default=0)
    for name in ("document-id", "source-file", "section", "chunker-name"):
        search.add_argument(f"--{name}")
    for name in ("page-number", "min-page", "max-page"):
        search.add_argument(f"--{name}", type=int)
    search.add_argument("--min-quality", type=float)
    cost = verbs.add_parser("cost", help="what tokens cost, or the price list")
    cost.add_argument("--model", default="gpt-4")
    cost.add_argument("--input-tokens", type=int, default=0)
    cost.add_argument("--output-tokens", type=int, default=0)
    cost.add_argument("--list-models", action="store_true")
    return out


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    settings = Settings.load()
    log = setup_logging(settings.LOG_LEVEL)
    provider = HashProvider(settings.EMBEDDING_DIMENSIONS)
    collection = Collection(spark, settings.INDEX_DIR, engine.RECORD)
    if args.verb == "clean":
        done = engine.clean(files.read_pdf_pages(spark, args.path).where("error is null")) if args.pdf else engine.clean_texts(files.read_text_dir(spark, args.path))
        done = materialize(done)
        if args.text_files:
            files.write_texts(done.withColumn("name", T.stem(F.col("source_path"))), "name", "clean_text", f"{args.out}/texts")
        else:
            done.select("source_path", "clean_text").write.mode("overwrite").parquet(f"{args.out}/texts")
        files.write_lines(done, Q.report_json(F.col("source_path"), F.col("quality")), f"{args.out}/reports")
        n, bad = done.agg(F.count("*"), F.count_if(~F.col("ok"))).first()
        log.info("%d documents, %d of them of low quality or empty", n, bad)
        return int(not n or args.fail_on_low_quality and bad > 0)
    if args.verb == "chunk":
        given = {"CHUNK_SIZE": args.chunk_size, "CHUNK_OVERLAP": args.overlap}
        settings = replace(settings, **{k: v for k, v in given.items() if v is not None})
        docs = files.read_text_dir(spark, args.path)
        docs, text = (engine.clean_texts(docs), "clean_text") if args.clean else (docs, "text")
        lines = engine.chunk_lines(docs, text=text, chunker=args.chunker, settings=settings)
        files.write_lines(lines, F.col("line"), args.out)
        return 0
    if args.verb == "index":
        stats = engine.index_directory(spark, args.path, collection, provider)
        print(stats)
        return int(not stats.success)
    if args.verb == "search":
        where = RetrievalFilter(**{f.name: getattr(args, f.name) for f in fields(RetrievalFilter) if getattr(args, f.name, None) is not None})
        log.info("%s", where.summary())
        engine.retrieve(collection, args.query, provider, args.top_k, args.threshold, where, args.per_document, settings).show(truncate=80)
        return 0
    prices = costs.price_table(spark)
    if args.list_models:
        prices.orderBy("model").show(truncate=False)
    else:
        one = spark.createDataFrame([(args.model, args.input_tokens, args.output_tokens)], "model string, input_tokens int, output_tokens int")
        print(costs.costs(one, prices).select(costs.summary().alias("s")).first()["s"])
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args, SparkSession.builder.appName("quillmill").getOrCreate())
    except QuillmillError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
