"""Pages, chunks and what is checked on them. All but the joins are narrow: arrays are folded inside a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def split_pages(docs: DataFrame, lines_each: int = 3) -> DataFrame:
    """doc_id, page_number, text, extraction_failed: pages of so many lines; every 29th page stands for a failed one."""
    lines = F.split("text", "\n")
    many = F.ceil(F.size(lines) / lines_each).cast("int")
    pages = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.array_join(F.slice(lines, i * lines_each + 1, F.lit(lines_each)), "\n"))
    out = docs.select("doc_id", F.posexplode(pages).alias("p", "text")).select("doc_id", (F.col("p") + 1).cast("long").alias("page_number"), "text")
    return out.withColumn("extraction_failed", (F.col("doc_id") + F.col("page_number")) % 29 == 0)


def paragraphs_to_pages(docs: DataFrame, least: int = 1500) -> DataFrame:
    """doc_id, page_number, n_chars: paragraphs are gathered until a page holds `least` characters."""
    parts = F.split("text", "\n\n")
    start = F.struct(F.array().cast("array<bigint>").alias("pages"), F.lit(0).cast("long").alias("open"))

    def fold(acc: Column, p: Column) -> Column:
        size = acc["open"] + F.length(p)
        return F.when(size >= least, F.struct(F.concat(acc["pages"], F.array(size)).alias("pages"), F.lit(0).cast("long").alias("open"))).otherwise(F.struct(acc["pages"].alias("pages"), size.cast("long").alias("open")))

    sizes = F.aggregate(parts, start, fold, lambda acc: F.when(acc["open"] > 0, F.concat(acc["pages"], F.array(acc["open"]))).otherwise(acc["pages"]))
    return docs.select("doc_id", F.posexplode(sizes).alias("p", "n_chars")).select("doc_id", (F.col("p") + 1).cast("long").alias("page_number"), "n_chars")


def chunk(pages: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """doc_id, page_number, chunk_index, token_count, content: token windows; empty pages give none."""
    t = T.tokens(F.col("text"))
    last = F.ceil(F.greatest(F.size("t") - size, F.lit(0)) / (size - overlap)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(F.col("t"), i * (size - overlap) + 1, F.lit(size)))
    out = pages.withColumn("t", t).filter(F.size("t") > 0).select("doc_id", "page_number", F.posexplode(windows).alias("k", "w"))
    order = Window.partitionBy("doc_id").orderBy("page_number", "k")
    return out.select("doc_id", "page_number", (F.row_number().over(order) - 1).cast("long").alias("chunk_index"), F.size("w").cast("long").alias("token_count"), F.array_join("w", " ").alias("content"))


def furniture(pages: DataFrame, least_pages: int = 3, spread: float = 0.15, margin: float = 0.10, least_length: int = 3) -> DataFrame:
    """Lines that stand near one edge of several pages: doc_id, line, occurrences, pages, avg_position, spread, zone, shown."""
    lines = pages.filter(~F.col("extraction_failed")).select("doc_id", "page_number", F.split("text", "\n").alias("ls"))
    lines = lines.select("doc_id", "page_number", F.size("ls").alias("n"), F.posexplode("ls").alias("i", "raw"))
    at = F.when(F.col("n") > 1, F.col("i") / (F.col("n") - 1)).otherwise(0.0)
    lines = lines.select("doc_id", "page_number", "i", "raw", at.alias("at"), F.trim(F.lower(F.regexp_replace("raw", r"\s+", " "))).alias("line"))
    lines = lines.filter((F.length("line") >= least_length) & ((F.col("at") <= margin) | (F.col("at") >= 1 - margin)))
    first = lines.groupBy("doc_id", "page_number", "line").agg(F.min(F.struct("i", "at", "raw")).alias("m"))
    out = first.groupBy("doc_id", "line").agg(
        F.count("*").alias("occurrences"), F.array_join(F.transform(F.array_sort(F.collect_list("page_number")), lambda x: x.cast("string")), ",").alias("pages"),
        F.avg("m.at").alias("a"), (F.max("m.at") - F.min("m.at")).alias("s"), F.min_by("m.raw", "page_number").alias("shown"),
    )
    out = out.filter((F.col("occurrences") >= least_pages) & (F.col("s") <= spread))
    return out.select("doc_id", "line", "occurrences", "pages", F.bround("a", 4).alias("avg_position"), F.bround("s", 4).alias("spread"), F.when(F.col("a") <= 0.5, "top").otherwise("bottom").alias("zone"), F.trim("shown").alias("shown"))


def _lost(samples: int):
    """From lines of words in order, those of a document's chunks before those of its pages: doc_id, words, missing, and
    the first missing words. The words of one document's chunks are held at a time."""
    import pyarrow as pa

    def run(batches):
        doc, begun, kept, words, missing, first = None, False, set(), 0, 0, []
        kind = None

        def rows(done: list) -> pa.RecordBatch:
            ids, *rest = zip(*done)
            return pa.record_batch([pa.array(ids, kind), *(pa.array(x, t) for x, t in zip(rest, (pa.int64(), pa.int64(), pa.string())))], ["doc_id", "words", "missing", "sample"])

        for batch in batches:
            kind, done = batch.column(0).type, []
            for at in range(0, batch.num_rows, 256):
                for d, said, w in zip(*(batch.column(i).slice(at, 256).to_pylist() for i in range(3))):
                    if not begun or d != doc:
                        if words:
                            done.append((doc, words, missing, " ".join(first)))
                        doc, begun, kept, words, missing, first = d, True, set(), 0, 0, []
                    ws = w.split(" ")
                    if said:
                        lost = [x for x in ws if x not in kept]
                        words, missing = words + len(ws), missing + len(lost)
                        first += lost[: samples - len(first)]
                    elif d is not None:  # a document without an id has no chunks
                        kept.update(ws)
            if done:
                yield rows(done)
        if words:
            yield rows([(doc, words, missing, " ".join(first))])

    return run


def data_loss(pages: DataFrame, chunks: DataFrame, least: int = 2, share: float = 0.005, samples: int = 20) -> DataFrame:
    """Per document: words of its pages, those that none of its chunks holds, their share, whether that passes, the first of them."""
    line = lambda c: F.array_join(T.words(F.col(c)), " ").alias("w")
    said = pages.filter(~F.col("extraction_failed")).select("doc_id", F.lit(True).alias("said"), F.col("page_number").cast("long").alias("page_number"), line("text"))
    kept = chunks.select("doc_id", F.lit(False).alias("said"), F.lit(0).cast("long").alias("page_number"), line("content"))
    # a row is a page or a chunk, not a word; the chunks of a document come before its pages
    rows = said.unionByName(kept).filter("w <> ''").repartition("doc_id").sortWithinPartitions("doc_id", "said", "page_number")
    kind = pages.schema["doc_id"].dataType.simpleString()
    counts = rows.select("doc_id", "said", "w").mapInArrow(_lost(samples), f"doc_id {kind}, words long, missing long, sample string")
    limit = F.greatest(F.lit(float(least)), F.col("words") * share)
    return counts.select("doc_id", "words", "missing", F.bround(F.col("missing") / F.col("words"), 6).alias("ratio"), (F.col("missing") <= limit).alias("passed"), "sample")


#: Cells that hold nothing: fixed values.
PLACEHOLDERS = [".", "..", "-", "—", "do", "do."]


def quality(pages: DataFrame, engine: Column) -> DataFrame:
    """Extraction quality of a page: characters, lines, row-like lines, share of Devanagari among all characters, share
    of placeholders among cells, degenerate."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    cells = F.flatten(F.transform(lines, lambda x: F.filter(F.split(x, r"\s{2,}|\|"), lambda c: F.trim(c) != "")))
    rowlike = F.size(F.filter(lines, lambda x: (F.size(F.filter(F.split(x, r"\s{2,}|\|"), lambda c: F.trim(c) != "")) >= 2) & x.rlike("[0-9]")))
    marks = F.size(F.filter(cells, lambda c: F.lower(F.trim(c)).isin(*PLACEHOLDERS)))
    deva = F.length(F.regexp_replace("text", r"[^\x{0900}-\x{097F}]", ""))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return pages.select(
        "doc_id", "page_number", engine.alias("engine"), F.length("text").cast("long").alias("n_chars"), F.size(lines).cast("long").alias("n_lines"), rowlike.cast("long").alias("row_like"),
        F.bround(share(deva, F.length("text")), 4).alias("devanagari"), F.bround(share(marks, F.size(cells)), 4).alias("placeholders"), (share(marks, F.size(cells)) > 0.9).alias("degenerate"),
    )


def recommend_engine(scores: DataFrame) -> DataFrame:
    """The best engine of each page by row-like lines, then Devanagari share, then name; null where none is usable."""
    usable = ~F.col("degenerate") & (F.col("n_chars") > 0)
    best = F.max_by(F.when(usable, F.col("engine")), F.when(usable, F.struct("row_like", "devanagari", "engine")))
    return scores.groupBy("doc_id", "page_number").agg(best.alias("engine"))
