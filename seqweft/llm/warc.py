"""WARC archives: written and read back by Spark's text source, record borders verified as a chain.

Archives are cut at every occurrence of the magic string, also inside payloads, so each piece gives a candidate record and
the offset of its successor. A record is real only if it can be reached from the start of its file: candidates that
follow each other directly are first drawn together in chains within their block, then pointer jumping over the few
chains doubles the distance reached in every round. What isn't reached is payload. All steps are DataFrame operations;
payloads are shuffled only to join them with what decides their record type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqweft.llm._arrow import look_up, ready_checkpoints, shared_folder, written

MAGIC = "WARC/1.1\r\n"
_GAP = "\r\n\r\n"
_RECORD = "urn:page:"
#: Rounds of pointer jumping at most: files of more than 2**60 chains don't occur.
_ROUNDS = 60


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hexadecimal digits are four of base 32."""
    hexed = F.sha1(data)
    part = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*part), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, compression: str = "gzip") -> None:
    """Write a record for each row: response, or revisit where an equal payload of least_bytes or more has a larger id.

    A null payload is empty, a null URL is about:blank; control characters and spaces in URLs are escaped. Rows that
    repeat the largest id are all responses; rows with a null id are revisits if their payload has an id elsewhere.
    """
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    keyed = source.withColumn("key", F.when(F.octet_length("payload") >= least_bytes, F.sha2(F.col("payload").cast("binary"), 256)))
    latest = written(keyed.where("key is not null").groupBy("key").agg(F.max("id").alias("latest")), "latest")
    known = look_up(keyed, latest, "key")
    revisit = F.coalesce(F.col("latest") > F.col("id"), F.col("latest").isNotNull() & F.col("id").isNull())
    digest = base32_sha1(F.col("payload").cast("binary"))
    url = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(_GAP))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    named = lambda c: F.concat(F.lit(f"<{_RECORD}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", named(F.col("id"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", named(F.col("latest"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block, F.lit("\r\n\r"),
    )
    known.select(record.alias("value")).write.option("compression", compression).text(path)  # the writer adds the last line feed


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between occurrences of the magic string, with file, block and order."""
    read = spark.read.text(path, lineSep=MAGIC)
    return read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nr"))


def _header(value: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(value, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1), F.lit(""))


def _parsed(df: DataFrame) -> DataFrame:
    """Header fields of `value` (what follows a magic string), and payload as binary if it holds the whole record."""
    has = F.instr("value", _GAP) > 0
    df = df.withColumn("head", F.when(has, F.substring_index("value", _GAP, 1)))
    df = df.withColumns({"head_bytes": F.octet_length("head").cast("long"), "length": F.expr("try_cast(regexp_extract(head, '(?:^|\\r\\n)Content-Length: ([0-9]+)(?:\\r\\n|$)', 1) as bigint)"), "bytes": F.octet_length("value").cast("long")})
    df = df.withColumn("whole", F.coalesce(F.col("bytes") == F.col("head_bytes") + F.col("length") + 8, F.lit(False)))
    block = F.expr("cast(substring(cast(value as binary), cast(head_bytes as int) + 5, cast(length as int)) as string)")
    df = df.withColumn("body", F.when(F.col("whole"), block))
    df = df.withColumn("payload", F.expr(f"substring(cast(body as binary), octet_length(substring_index(body, '{_GAP}', 1)) + 5)".replace("\r", "\\r").replace("\n", "\\n")))
    return df.withColumns({
        "type": _header(F.col("head"), "WARC-Type"), "url": _header(F.col("head"), "WARC-Target-URI"),
        "id": F.regexp_extract(F.col("head"), rf"WARC-Record-ID: <{_RECORD}([^>]*)>", 1), "refers": F.regexp_extract(F.col("head"), rf"WARC-Refers-To: <{_RECORD}([^>]*)>", 1),
        "said": F.regexp_replace(_header(F.col("head"), "WARC-Payload-Digest"), "^sha1:", ""),
        "payload_bytes": F.octet_length("payload").cast("long"), "digest": F.when(F.col("payload").isNotNull(), base32_sha1(F.col("payload"))),
    })


_FIELDS = ["type", "url", "id", "refers", "said", "payload_bytes", "digest"]


def with_offsets(df: DataFrame) -> DataFrame:
    """Add `at`, the offset of each piece's magic string; negative for what precedes the first one.

    Sums run within a block and over the blocks of a file, never over all records of a file.
    """
    step = len(MAGIC)
    sizes = df.groupBy("file", "block").agg(F.sum(F.col("bytes") + step).alias("size"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("skip", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    inner = Window.partitionBy("file", "block").orderBy("nr").rowsBetween(Window.unboundedPreceding, -1)
    return df.join(sizes, ["file", "block"]).withColumn("at", F.col("skip") + F.coalesce(F.sum(F.col("bytes") + step).over(inner), F.lit(0)) - step).drop("skip")


def reachable(nodes: DataFrame) -> DataFrame:
    """Of candidates (file, block, at, next) those that the chain from offset 0 of their file reaches: (file, at)."""
    ready_checkpoints(nodes.sparkSession)
    w = Window.partitionBy("file", "block").orderBy("at")
    near = nodes.select("file", "block", "at", "next", F.lag("next").over(w).alias("last_next"), F.lead("at").over(w).alias("following"))
    targets = near.where("next is not null and (following is null or next <> following)").select("file", F.col("next").alias("at")).distinct().withColumn("entered", F.lit(True))
    marked = near.join(targets, ["file", "at"], "left")
    starts = F.when(F.col("last_next").eqNullSafe(F.col("at")) & F.col("entered").isNull(), 0).otherwise(1)
    chained = marked.withColumn("chain", F.sum(starts).over(w)).select("file", "block", "chain", "at", "next").checkpoint()
    chains = chained.groupBy("file", "block", "chain").agg(F.min("at").alias("first"), F.max_by("next", "at").alias("exit"))
    jump = chains.where("exit is not null").select("file", "first", "exit").checkpoint()
    reached = chains.where("first = 0").select("file", "first").checkpoint()
    n = reached.count()
    for _ in range(_ROUNDS):
        on = reached.join(jump, ["file", "first"]).select("file", F.col("exit").alias("first"))
        own = on.join(chains.select("file", "first"), ["file", "first"], "left_semi")
        reached = reached.union(own).distinct().checkpoint()
        if (now := reached.count()) == n:
            break
        n = now
        further = jump.select("file", F.col("first").alias("exit"), F.col("exit").alias("beyond"))
        jump = jump.join(further, ["file", "exit"]).select("file", "first", F.col("beyond").alias("exit")).checkpoint()
    kept = chains.join(reached, ["file", "first"], "left_semi").select("file", "block", "chain")
    return chained.join(kept, ["file", "block", "chain"], "left_semi").select("file", "at")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The real records: file, at, type, id (string), refers, url, said (digest in the header), payload_bytes and digest.

    payload_bytes and digest are those of the stored block's payload, empty for revisits. Bytes that the chain doesn't
    reach are ignored; a file that doesn't begin with a record has none.
    """
    parsed = _parsed(pieces(spark, path))
    slim = parsed.select("file", "block", "nr", "bytes", "head_bytes", "length", "whole", *_FIELDS, F.when(~F.col("whole"), F.col("value").cast("binary")).alias("raw"))
    found = written(with_offsets(slim), "pieces").where("at >= 0")
    nodes = found.select("file", "block", "at", (F.col("at") + len(MAGIC) + F.col("head_bytes") + F.col("length") + 8).alias("next"))
    real = written(reachable(nodes), "real").withColumn("real", F.lit(True))
    joined = found.join(real, ["file", "at"], "left")
    if found.where("not whole").isEmpty():
        return joined.where("real and whole").select("file", "at", *_FIELDS)
    # a piece belongs to the last real record before it, in its block or an earlier one
    within, earlier = Window.partitionBy("file", "block").orderBy("at"), Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    real_at = F.when(F.col("real"), F.col("at"))
    tops = joined.groupBy("file", "block").agg(F.max(real_at).alias("top")).withColumn("top", F.last("top", True).over(earlier))
    owned = joined.join(tops, ["file", "block"]).withColumn("owner", F.coalesce(F.last(real_at, True).over(within), "top")).drop("top")
    split = owned.where("real and not whole").select("file", "owner", (F.col("at") + len(MAGIC) + F.col("head_bytes") + F.col("length") + 8).alias("end"))
    parts = owned.select("file", "block", "nr", "at", "owner", "raw")
    if _has_whole_inside(joined):
        full = _parsed(pieces(spark, path)).select("file", "block", "nr", F.col("value").cast("binary").alias("raw"))
        parts = parts.drop("raw").join(full, ["file", "block", "nr"])
    inside = parts.join(split, ["file", "owner"]).where("at < end")
    glued = inside.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "raw"))).alias("parts"))
    value = F.expr(f"cast(aggregate(slice(parts, 2, size(parts)), parts[0].raw, (a, x) -> concat(a, cast('{MAGIC}' as binary), x.raw)) as string)".replace("\r", "\\r").replace("\n", "\\n"))
    again = _parsed(glued.select("file", F.col("owner").alias("at"), value.alias("value")))
    return joined.where("real and whole").select("file", "at", *_FIELDS).unionByName(again.where("whole").select("file", "at", *_FIELDS))


def _has_whole_inside(joined: DataFrame) -> bool:
    """Whether a payload holds something that looks like a whole record, whose bytes weren't kept."""
    return not joined.where("whole and real is null").isEmpty()


def op1_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = shared_folder(spark) + "-archives"
    write_archives(pages, path)
    found = written(read_archives(spark, path), "records")
    kind = pages.schema["page_id"].dataType.simpleString()
    own = F.expr(f"try_cast(id as {kind})")
    responses = found.where("type = 'response'")
    sizes = responses.where("id <> ''").groupBy("id").agg(F.max("payload_bytes").alias("full_bytes"), F.max("digest").alias("full_digest")).withColumnRenamed("id", "refers")
    revisits = look_up(found.where("type = 'revisit'").select("id", "refers"), sizes, "refers")
    return responses.select(own.alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast(kind).alias("refers_to")).unionByName(
        revisits.select(own.alias("page_id"), F.col("full_bytes").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.expr(f"try_cast(refers as {kind})").alias("refers_to"))
    )
