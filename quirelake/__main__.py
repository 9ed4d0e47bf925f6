"""Reads page images of a folder, or one, and writes ALTO, texts or both."""

from __future__ import annotations

import argparse
import importlib
import sys
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUFFIXES = {"alto": {"alto": ".alto.xml"}, "txt": {"text": ".txt"}, "multi": {"alto": ".alto.xml", "text": ".txt"}}


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quirelake", description=__doc__)
    p.add_argument("input", help="an image, or a folder of images")
    p.add_argument("--out-dir", default="results")
    p.add_argument("--format", choices=sorted(SUFFIXES), default="alto")
    p.add_argument("--layout", required=True, help="the layout network, as module:attribute")
    p.add_argument("--model", required=True, help="the recognition network, as module:attribute")
    p.add_argument("--vocab", required=True, help='a JSON file {"characters": [..]}')
    p.add_argument("--height-scale", type=float, default=1.0, help="factor of the heights that the layout network gives")
    p.add_argument("--max-width", type=int, default=1600)
    p.add_argument("--no-adaptive", dest="adaptive", action="store_false", help="one resolution only")
    p.add_argument("--master", default="local[*]")
    return p.parse_args(given)


def named(where: str):
    """The object module:attribute; a class is called without arguments."""
    module, _, attribute = where.partition(":")
    found = getattr(importlib.import_module(module), attribute)
    return found() if isinstance(found, type) else found


def write_files(made: DataFrame, folder: str, fmt: str) -> None:
    """A file for each page and kind, by the executors: the folder must be one that they share. Pages of one name would overwrite
    each other, so of several the second and later ones get a number."""
    kinds = SUFFIXES[fmt]

    def put(rows) -> None:
        Path(folder).mkdir(parents=True, exist_ok=True)
        for r in rows:
            for column, suffix in kinds.items():
                Path(folder, f"{r.file}{suffix}").write_text(r[column] or "", encoding="utf-8")

    from pyspark.sql import Window

    again = F.row_number().over(Window.partitionBy("page_id").orderBy("origin"))
    files = made.where("status = 202").withColumn("again", again).withColumn("file", F.when(F.col("again") > 1, F.concat_ws("-", "page_id", "again")).otherwise(F.col("page_id")))
    files.select("file", *kinds).foreachPartition(put)


def main(given: list[str] | None = None) -> int:
    from quirelake.plans.pages import process
    from quirelake.session import session, ship
    from quirelake.sources.images import read_pages
    from quirelake.sources.models import load_vocab

    a = arguments(given)
    spark = session(a.master)
    ship(spark)
    pages = read_pages(spark, a.input)
    if pages.isEmpty():
        print("no images", file=sys.stderr)
        return 1
    made = process(pages, named(a.layout), named(a.model), load_vocab(spark, a.vocab), a.adaptive, a.height_scale, a.max_width).cache()
    write_files(made, a.out_dir, a.format)
    failed = [r.page_id for r in made.where("status <> 202").select("page_id").orderBy("page_id").limit(100).collect()]
    n, lines = made.agg(F.count_if(F.col("status") == 202), F.coalesce(F.sum("n_lines"), F.lit(0))).first()
    print(f"{n} pages, {lines} lines" + (f", unreadable: {', '.join(failed)}" if failed else ""))
    return 0 if n else 1


if __name__ == "__main__":
    sys.exit(main())
