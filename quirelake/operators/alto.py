"""ALTO XML of pages, assembled by nested aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import strip

#: The root element's attributes.
ROOT = '<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="http://www.loc.gov/standards/alto/ns-v4# http://www.loc.gov/standards/alto/v4/alto-4-4.xsd">'
WORD = "struct<word:string,x:int,y:int,w:int,h:int>"


def escaped(t: Column) -> Column:
    # most words hold nothing to escape, which one look tells
    plain = t
    # XML can't hold other control characters; attribute values keep tabs and breaks as references
    t = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    for a, b in (("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.when(plain.rlike('[\\x00-\\x1F&<>"]'), t).otherwise(plain)


def _attrs(**values: Column | str) -> Column:
    parts: list[Column] = []
    for k, v in values.items():
        parts += [F.lit(f' {k}="'), F.lit(v) if isinstance(v, str) else v.cast("string"), F.lit('"')]
    return F.concat(*parts)


def _nested(level: int, name: str, *inner: str) -> str:
    pad = "  " * level
    return f"{pad}<{name}>\n{''.join(inner)}{pad}</{name.split()[0]}>\n"


def _leaf(level: int, name: str, text: str) -> str:
    return f"{'  ' * level}<{name}>{text}</{name}>\n"


def head(processed_at: str, software: str, layout: str | None, creator: str = "quirelake") -> str:
    """The document up to its tags: a step of processing for the layout, if there is one, and one for the recognition."""

    def step(kind: str, name: str, description: str) -> str:
        made = _nested(4, "processingSoftware", _leaf(5, "softwareCreator", creator), _leaf(5, "softwareName", name))
        return _nested(2, f'OCRProcessing ID="{kind}"', _nested(3, "ocrProcessingStep", _leaf(4, "processingDateTime", processed_at), _leaf(4, "processingStepDescription", description), made))

    steps = (step("IdLayout", layout, "layout") if layout else "") + step("IdRecognition", software, "recognition")
    return f'<?xml version="1.0" ?>\n{ROOT}\n' + _nested(1, "Description", _leaf(2, "MeasurementUnit", "pixel"), steps)


def to_alto(lines: DataFrame, processed_at: str = "1970-01-01T00:00:00Z", software: str = "recogniser", layout: str | None = "layout") -> DataFrame:
    """lines (page_id, region_idx, line_idx, text, hpos, vpos, width, height, page_w, page_h, role, words array<WORD>) -> (page_id, alto).

    Blank lines aren't written, nor blocks without others; the blocks and lines that are written count from 0. Roles other than body
    become tags in the order of their first line. Line boxes are as they are; word boxes start at 0 and are 1 wide and
    high at least. Lines are dealt by page once; their places, the blocks and the pages follow from that.
    """
    stripped = lines.withColumn("blank", F.coalesce(strip(F.col("text")) == "", F.lit(True)))
    page, block = Window.partitionBy("page_id"), Window.partitionBy("page_id", "blank", "region_idx")
    rows = stripped.withColumn("bi", F.dense_rank().over(page.orderBy("blank", "region_idx")) - 1).withColumn("li", F.row_number().over(block.orderBy("line_idx")) - 1)
    clear = lambda c: F.greatest(F.lit(0), c)
    one = lambda c: F.greatest(F.lit(1), c)
    place = lambda *parts: F.concat_ws("_", *parts)

    def string(w: Column, i: Column) -> Column:
        return F.concat(F.lit("            <String"), _attrs(ID=place(F.lit("word"), "bi", "li", i), CONTENT=escaped(w["word"]), HPOS=clear(w["x"]), VPOS=clear(w["y"]), WIDTH=one(w["w"]), HEIGHT=one(w["h"])), F.lit("/>\n"))

    inner = F.array_join(F.transform(F.coalesce("words", F.expr(f"CAST(array() AS array<{WORD}>)")), string), "            <SP/>\n")
    tagged = F.col("role").isNotNull() & (F.col("role") != "body")
    tag = F.when(tagged, F.concat(F.lit(' TAGREFS="ROLE_'), F.col("role"), F.lit('"'))).otherwise("")
    opening = F.concat(F.lit("          <TextLine"), _attrs(ID=place(F.lit("line"), "bi", "li"), HPOS=F.col("hpos"), VPOS=F.col("vpos"), WIDTH=F.col("width"), HEIGHT=F.col("height")), tag)
    rows = rows.withColumn("inner", inner).withColumn("opening", opening)
    xml = F.when(F.col("inner") == "", F.concat("opening", F.lit("/>\n"))).otherwise(F.concat("opening", F.lit(">\n"), "inner", F.lit("          </TextLine>\n")))
    rows = rows.select("page_id", "page_w", "page_h", "blank", "region_idx", "bi", "li", "hpos", "vpos", "width", "height", F.when(~F.col("blank"), xml).alias("xml"), F.when(tagged & ~F.col("blank"), F.col("role")).alias("tag"))

    item = F.struct("li", "xml", "tag")
    x, y = F.min("hpos"), F.min("vpos")
    blocks = rows.groupBy("page_id", "blank", "region_idx", "bi").agg(
        F.first("page_w").alias("page_w"), F.first("page_h").alias("page_h"), F.array_sort(F.collect_list(item)).alias("items"), x.alias("x"), y.alias("y"),
        F.greatest(F.lit(1), F.max(F.col("hpos") + F.col("width")) - x).alias("w"), F.greatest(F.lit(1), F.max(F.col("vpos") + F.col("height")) - y).alias("h"),
    )
    written = F.concat(F.lit("        <TextBlock"), _attrs(ID=place(F.lit("block"), "bi"), HPOS=F.col("x"), VPOS=F.col("y"), WIDTH=F.col("w"), HEIGHT=F.col("h")), F.lit(">\n"), F.array_join(F.transform("items", lambda i: i["xml"]), ""), F.lit("        </TextBlock>\n"))
    blocks = blocks.select("page_id", "page_w", "page_h", "bi", F.when(~F.col("blank"), written).alias("block"), F.filter(F.transform("items", lambda i: i["tag"]), lambda t: t.isNotNull()).alias("tags"))
    pages = blocks.groupBy("page_id").agg(F.first("page_w").alias("page_w"), F.first("page_h").alias("page_h"), F.array_sort(F.collect_list(F.struct("bi", "block", "tags"))).alias("all"))
    pages = pages.withColumn("blocks", F.array_join(F.transform("all", lambda b: b["block"]), "")).withColumn("tags", F.array_distinct(F.flatten(F.transform("all", lambda b: b["tags"]))))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("  <Tags>\n"), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("    <StructureTag"), _attrs(ID=F.concat(F.lit("ROLE_"), t), LABEL=t), F.lit("/>\n"))), ""), F.lit("  </Tags>\n"))).otherwise("")
    space = F.concat(F.lit("      <PrintSpace"), _attrs(HPOS="0", VPOS="0", WIDTH=F.col("page_w"), HEIGHT=F.col("page_h")))
    filled = F.when(F.col("blocks") == "", F.concat(space, F.lit("/>\n"))).otherwise(F.concat(space, F.lit(">\n"), "blocks", F.lit("      </PrintSpace>\n")))
    opened = F.concat(F.lit("  <Layout>\n    <Page"), _attrs(ID=F.concat(F.lit("page_"), escaped(F.col("page_id").cast("string"))), WIDTH=F.col("page_w"), HEIGHT=F.col("page_h"), PHYSICAL_IMG_NR="1"), F.lit(">\n"))
    return pages.select("page_id", F.concat(F.lit(head(processed_at, software, layout)), tags, opened, filled, F.lit("    </Page>\n  </Layout>\n</alto>\n")).alias("alto"))


def with_words(lines: DataFrame, words: DataFrame) -> DataFrame:
    """lines with words, the words (page_id, line_idx, word_idx, word, x, y, w, h) of each in their order."""
    nested = words.groupBy("page_id", "line_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word", "x", "y", "w", "h"))), lambda w: F.struct(*(w[c].alias(c) for c in ("word", "x", "y", "w", "h")))).alias("words"))
    return lines.join(nested, ["page_id", "line_idx"], "left")


#: Words of a line whose places are summed at once: what a fold has summed is copied with each step, so long lines go by parts.
PART = 256


def _sums(sizes: Column) -> Column:
    """0 and the sums of the sizes up to each."""
    return F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def with_shared_words(lines: DataFrame) -> DataFrame:
    """lines with words, each over its share of the line's width by characters; made within the row."""
    rows = lines.withColumn("found", F.filter(F.split(strip(F.coalesce("text", F.lit(""))), " "), lambda w: w != ""))
    sizes = F.transform("found", lambda w: F.length(w) + 1)
    last = F.floor((F.greatest(F.size("found"), F.lit(1)) - 1) / PART).cast("int")
    rows = rows.withColumn("sizes", sizes).withColumn("parts", F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("sizes", k * PART + 1, F.lit(PART))))
    rows = rows.withColumn("ahead", _sums(F.transform("parts", lambda p: F.aggregate(p, F.lit(0), lambda s, n: s + n))))
    # the characters up to each word
    upto = F.flatten(F.transform("parts", lambda p, k: F.transform(F.slice(_sums(p), F.lit(1), F.size(p)), lambda n: n + F.get("ahead", k))))
    rows = rows.withColumn("upto", upto).withColumn("unit", F.col("width") / F.greatest(F.lit(1), F.element_at("ahead", -1) - 1))
    unit = F.col("unit")
    word = lambda w, i: F.struct(w.alias("word"), (F.col("hpos") + F.floor(F.get("upto", i) * unit)).cast("int").alias("x"), F.col("vpos").cast("int").alias("y"), F.ceil(F.length(w) * unit).cast("int").alias("w"), F.col("height").cast("int").alias("h"))
    return rows.withColumn("words", F.transform("found", word)).drop("found", "sizes", "parts", "ahead", "upto", "unit")
