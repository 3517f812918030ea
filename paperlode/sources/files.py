"""File sources and what decides which files come in; sinks with manifests."""

from __future__ import annotations

import hashlib
from email import message_from_bytes, policy
from functools import cache, lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.staging import numbered

ALLOWED = ["pdf", "docx", "txt", "csv", "json", "md", "xlsx", "pptx", "rtf", "png", "jpg", "jpeg", "tiff"]
MAX_BYTES = 50 * 1024 * 1024
#: Fixed values.
SKIPPED_PATHS = ["/api/docs", "/api/redoc", "/openapi.json", "/_next", "/static", "/favicon", "/api/v1/health"]


def accept(files: DataFrame, allowed: list[str] = ALLOWED, max_bytes: int = MAX_BYTES) -> DataFrame:
    """files (path, content, other columns) with length, file_hash and reason: why one is not taken, or null.

    A file fails on its own and the others go on: by type, size, without content (unreadable), empty, or as text that
    no JSON reader takes where it is called .json. Only what is taken has a hash.
    """
    kind = F.lower(F.substring_index("path", ".", -1))
    size = F.octet_length("content")
    reason = (
        F.when(~kind.isin(*allowed), "type").when(F.col("content").isNull(), "unreadable").when(size > max_bytes, "size").when(size == 0, "empty")
        .when((kind == "json") & parsed_json(decode_text(F.col("content"))).isNull(), "json")
    )
    out = files.withColumn("length", size.cast("long")).withColumn("reason", reason)
    return out.withColumn("file_hash", F.when(F.col("reason").isNull(), F.sha2("content", 256)))


def read_files(spark: SparkSession, path: str, allowed: list[str] = ALLOWED, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The files of a folder and all below it, accepted or not. Files beyond max_bytes are listed, but not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = accept(files.filter(F.col("length") <= max_bytes).drop("length"), allowed, max_bytes)
    large = files.filter(F.col("length") > max_bytes).select("path", "modificationTime", "length")
    kind = F.lower(F.substring_index("path", ".", -1))
    return small.unionByName(large.withColumn("reason", F.when(~kind.isin(*allowed), "type").otherwise("size")), allowMissingColumns=True)


def outcome_counts(files: DataFrame) -> DataFrame:
    """reason (null: taken), files, bytes of a batch."""
    return files.groupBy("reason").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def decode_text(content: Column) -> Column:
    """UTF-8 where it is valid, else Latin-1."""
    return F.when(F.is_valid_utf8(F.decode(content, "ISO-8859-1")) & F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def csv_pages(rows: DataFrame, columns: list[str], order: list[str], rows_each: int = 100) -> DataFrame:
    """page_number, text: non-empty rows joined by bars, so many to a page. Rows of one file are one ordered list."""
    line = F.concat_ws(" | ", *columns)
    lines = numbered(rows.filter(F.trim(F.concat_ws("", *columns)) != "").select(line.alias("line"), *order), *order).withColumnRenamed("n", "i")
    pages = lines.groupBy((F.floor(F.col("i") / rows_each) + 1).alias("page_number")).agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("x"))
    return pages.select("page_number", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("text"))


def parsed_json(text: Column) -> Column:
    """The variant of a text that is one JSON value and nothing else, else null.

    Spark's parser stops after the first value and takes whatever follows it. Read as the first of two elements, of which
    the other is a digest that the text cannot hold, a text with more than a value breaks the array or moves the digest.
    """
    digest = F.sha2(text, 256)
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), digest, F.lit('"]')))
    return F.when(F.try_variant_get(pair, "$[1]", "string") == digest, F.try_parse_json(text))


def json_page(text: Column) -> Column:
    """Pretty-printed JSON, or the text as it is where it is none."""
    parsed = parsed_json(text)
    return F.when(parsed.isNull(), text).otherwise(F.to_json(parsed, {"pretty": "true"}))


def exact_gate(incoming: DataFrame, stored: DataFrame, count_trashed: bool) -> tuple[DataFrame, DataFrame]:
    """(accepted, conflicts): incoming (tenant_id, id, file_hash, force) against stored hashes of the tenant.

    A conflict names the stored document with the smallest id, and its title. Of equal incoming files the smallest id is accepted,
    unless trashed documents do not count and the file is forced.
    """
    known = stored if count_trashed else stored.filter("not is_trashed")
    known = known.groupBy("tenant_id", "file_hash").agg(F.min(F.struct("doc_id", "title")).alias("e")).select("tenant_id", "file_hash", F.col("e.doc_id").alias("existing"), F.col("e.title").alias("existing_title"))
    rows = incoming.join(known, ["tenant_id", "file_hash"], "left")
    conflict = F.col("existing").isNotNull() & ~F.col("force")
    return rows.filter(~conflict).drop("existing", "existing_title"), rows.filter(conflict)


def stable_files(listing: DataFrame, reserved: tuple[str, ...] = ("processed/", "failed/"), grace: float = 2 * 86_400) -> DataFrame:
    """path, poll_no, size of the first poll at which a file had the size of the poll before and its last change was
    `grace` seconds old. A file that a poll misses is forgotten, and another one if it comes back.

    listing: path, poll_no, size, mtime, poll_ts.
    """
    w = Window.partitionBy("path").orderBy("poll_no")
    rows = listing.filter(~F.col("path").startswith(reserved[0]) & ~F.col("path").startswith(reserved[1]))
    rows = rows.withColumn("before", F.lag("size").over(w)).withColumn("poll_before", F.lag("poll_no").over(w)).withColumn("stay", F.col("poll_no") - F.row_number().over(w))
    old = F.unix_micros("poll_ts") - F.unix_micros("mtime") >= int(grace * 1e6)
    rows = rows.filter((F.col("size") == F.col("before")) & (F.col("poll_before") == F.col("poll_no") - 1) & old)
    return rows.groupBy("path", "stay").agg(F.min(F.struct("poll_no", "size")).alias("x")).select("path", "x.poll_no", "x.size")


def route(outcomes: DataFrame) -> DataFrame:
    """path, destination: errors go to failed/, all else to processed/, below the same subfolder."""
    return outcomes.select("path", F.concat(F.when(F.col("status") == "error", "failed/").otherwise("processed/"), F.regexp_replace("path", "^[^/]*/", "")).alias("destination"))


def folder_paths(rows: DataFrame, segments: Column) -> DataFrame:
    """tenant_id, folder_path, parent_path, folder_id: every prefix of the rows' segments once, with a derived id."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.array_join(F.slice("s", 1, i), "/"))
    paths = rows.select("tenant_id", segments.alias("s")).filter(F.size("s") > 0).select("tenant_id", F.explode(prefixes).alias("folder_path")).distinct()
    parent = F.regexp_extract("folder_path", "^(.*)/[^/]*$", 1)
    return paths.select("tenant_id", "folder_path", F.when(parent != "", parent).alias("parent_path"), F.sha2(F.concat(F.col("tenant_id").cast("string"), F.lit("|"), "folder_path"), 256).alias("folder_id"))


@cache
def _mail_policy():
    """The default policy. Equal headers, as most mails have them, are parsed once in a worker."""
    return policy.default.clone(header_factory=lru_cache(4096)(policy.default.header_factory))


def attachments(mails: DataFrame, digest: bool = False) -> DataFrame:
    """mail_id, name, content, error of the named parts of raw messages (mail_id, raw). A mail that cannot be read gives one error row.

    With digest the SHA-256 of a part, h, stands for its content, which then stays in the task.
    """

    def run(batches):
        what = pa.string() if digest else pa.binary()
        kinds = [pa.int64(), pa.string(), what, pa.string()]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for mail_id, raw in zip(batch.column(0).slice(at, 64).to_pylist(), batch.column(1).slice(at, 64).to_pylist()):
                    try:
                        for part in message_from_bytes(bytes(raw), policy=_mail_policy()).walk():
                            if name := part.get_filename():
                                content = part.get_payload(decode=True) or b""
                                rows.append((mail_id, name, hashlib.sha256(content).hexdigest() if digest else content, None))
                    except (ValueError, LookupError, TypeError, AttributeError) as e:
                        rows.append((mail_id, None, None, type(e).__name__))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], ["mail_id", "name", "h" if digest else "content", "error"])

    return mails.select(F.col("mail_id").cast("long").alias("mail_id"), "raw").mapInArrow(run, f"mail_id long, name string, {'h string' if digest else 'content binary'}, error string")


def csv_line(*cells: Column) -> Column:
    """Cells in one CSV line: nulls empty, quoted where they hold a comma, a quote or a line end."""
    text = [F.coalesce(c.cast("string"), F.lit("")) for c in cells]
    return F.concat_ws(",", *[F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in text])


def sectioned_csv(nodes: DataFrame, key: str, sections: dict[str, tuple[DataFrame, list[str], str]]) -> DataFrame:
    """key, section, part, seq, line: the lines of one CSV for each node: for each section (rows with the key, columns,
    a long that orders them) a title, the names of its columns, its rows in order, and an empty line. A node without
    rows in a section has its title and names alone."""
    out = None
    for i, (name, (rows, columns, order)) in enumerate(sections.items()):
        lines = [F.lit(f"# {name}"), F.lit(",".join(columns)), F.lit("")]
        frame = nodes.select(key, F.posexplode(F.array(*lines)).alias("p", "line")).select(key, F.lit(name).alias("section"), F.lit(i).alias("part"), F.when(F.col("p") == 2, F.lit(2**62)).otherwise(F.col("p") - 2 - F.lit(2**62)).cast("long").alias("seq"), "line")
        body = rows.select(key, F.lit(name).alias("section"), F.lit(i).alias("part"), F.col(order).cast("long").alias("seq"), csv_line(*[F.col(c) for c in columns]).alias("line"))
        both = frame.unionByName(body)
        out = both if out is None else out.unionByName(both)
    return out


def write_sectioned(lines: DataFrame, key: str, path: str) -> DataFrame:
    """Write the lines of sectioned_csv, each node's together and in order, and return the manifest of what was written:
    key, n_bytes, digest (SHA-256 of the node's file, lines ended by a line feed) and sections, the rows in each.

    The digest is taken as the sorted lines stream by, so no node is held as a whole.
    """
    rows = lines.repartition(key).sortWithinPartitions(key, "part", "seq", "line")
    rows.write.parquet(path)

    def run(batches):
        node, h, size = None, None, 0
        for pdf in batches:
            done = []
            for k, line in zip(pdf[key], pdf["line"]):
                if k != node or h is None:
                    if h is not None:
                        done.append((node, size, h.hexdigest()))
                    node, h, size = k, hashlib.sha256(), 0
                raw = f"{line}\n".encode()
                h.update(raw)
                size += len(raw)
            yield pd.DataFrame(done, columns=[key, "n_bytes", "digest"])
        if h is not None:
            yield pd.DataFrame([(node, size, h.hexdigest())], columns=[key, "n_bytes", "digest"])

    kind = lines.schema[key].dataType.simpleString()
    # the files as written: one for each task, whose lines are in order
    digests = rows.select(key, "line").mapInPandas(run, f"{key} {kind}, n_bytes long, digest string")
    written = lines.sparkSession.read.schema(lines.schema).parquet(path)
    counts = written.groupBy(key, "section", "part").agg((F.count("*") - 3).alias("n"))
    counts = counts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "section", "n"))), lambda x: F.concat_ws("=", x["section"], x["n"].cast("string"))), ",").alias("sections"))
    return digests.join(counts, key)


def manifest(df: DataFrame, key: str) -> DataFrame:
    """key, n_rows, n_bytes of the rows as JSON, and a digest that does not depend on their order.

    The digest is that of the count and of sums over four 60-bit pieces of the rows' own digests, so a key of any
    size is summed up in a row on each side of the shuffle.
    """
    line = F.to_json(F.struct(*sorted(df.columns)))
    rows = df.select(F.col(key), F.octet_length(line).alias("bytes"), F.sha2(line, 256).alias("h"))
    pieces = [F.sum(F.conv(F.substring("h", 1 + 16 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(4)]
    out = rows.groupBy(key).agg(F.count("*").alias("n_rows"), F.sum("bytes").alias("n_bytes"), *pieces)
    digest = F.sha2(F.concat_ws(":", F.col("n_rows").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(4)]), 256)
    return out.select(key, "n_rows", "n_bytes", digest.alias("digest"))
