"""One zip an archive, of any size, put together by many tasks.

Members are dealt out by ranges of (archive, order); each becomes a record by itself.  Only their names
and lengths are then summed up by range, which gives every record's offset and so the central directory.
An archive is rows (archive, at, data), its pieces: their data in the order of `at` is the file.  No task holds
more than a range of an archive, and bytes are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import ancestors
from lodestone.operators.rounds import cut

#: Where the directory's pieces and an archive's end begin; records are numbered below, by partition (33 bits a partition).
DIRECTORY, END = 1 << 60, 1 << 61
PARTITION_BITS = 33
#: From here on a 32-bit field says that the zip64 fields hold the value.
LARGE = 0xFFFFFFFF
#: Fixed values of the format, as they lie: version 1.0 or 4.5, names in UTF-8, stored, the first of January 1980; a plain file of mode 0644, a folder of mode 0755.
OLD, NEW, PLAIN, FILE, FOLDER = "0A00", "2D00", "0008000000002100", "0000A481", "1000ED41"
JOINED_BYTES = 256 << 20


def _little(value: Column | int, width: int) -> Column:
    """A number's bytes, the lowest first, in hex."""
    digits = F.lpad(F.hex(F.lit(value).cast("long") if isinstance(value, int) else value.cast("long")), 2 * width, "0")
    return F.concat(*[F.substr(digits, F.lit(2 * i - 1), F.lit(2)) for i in range(width, 0, -1)])


def _number(data: Column, at: int, width: int) -> Column:
    """The number that lies at a place, counted from 1, lowest byte first."""
    return F.conv(F.concat(*[F.hex(F.substring(data, at + i, 1)) for i in range(width - 1, -1, -1)]), 16, 10).cast("long")


def _before(table: DataFrame, values: list[str]) -> DataFrame:
    """A table by (archive, part) with the sums of values over an archive's parts before, as `_values`; as many rows as archives and ranges."""
    w = Window.partitionBy("archive").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumns({f"_{v}": F.coalesce(F.sum(v).over(w), F.lit(0)) for v in values})


def by_folder() -> Column:
    """Sorts paths as a walk does that takes each folder's names in order, folders' contents where their names stand."""
    return F.split(F.rtrim(F.col("path"), F.lit("/")), "/")


def with_folders(rows: DataFrame) -> DataFrame:
    """Members and an empty one, named with a slash at its end, for each folder on their paths."""
    folders = rows.select("archive", F.explode(ancestors(F.rtrim(F.col("path"), F.lit("/")))).alias("path")).distinct()
    own = rows.filter(~F.col("path").endswith("/"))
    inner = folders.join(own.select("archive", "path").distinct(), ["archive", "path"], "left_anti")  # a file is the last of its own ancestors
    return own.select("archive", "path", "bytes").union(inner.select("archive", F.concat("path", F.lit("/")), F.lit(b"")))


def assembled(rows: DataFrame, order: list[str] | None = None, large: int = LARGE) -> DataFrame:
    """The pieces of one stored zip for each archive of members (archive, path, bytes): archive, at, data.

    Members are in the order of the columns that `order` names, else as by_folder() sorts them.
    Null bytes are empty; rows without archive or path are left out; repeated rows are members of one name, as
    the format allows; an archive without members is none.  A path that ends with a slash is a folder.  A name
    of more than 65,535 bytes is an error.  Offsets from `large` on are told by zip64 fields; a smaller limit gives the same contents.
    """
    keys = {f"_o{i}": F.col(c) for i, c in enumerate(order)} if order else {"_o0": by_folder()}
    own = rows.filter("archive is not null and path is not null").select("archive", "path", F.coalesce("bytes", F.lit(b"")).alias("bytes"), *[c.alias(n) for n, c in keys.items()])
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = own.repartitionByRange(n, "archive", *keys).sortWithinPartitions("archive", *keys)
    ranged = cut(ranged.select("archive", F.monotonically_increasing_id().alias("at"), "path", "bytes"))

    name_bytes, too_long = F.octet_length("path"), F.raise_error(F.concat(F.lit("name too long for an archive: "), F.substr("path", F.lit(1), F.lit(100))))
    name = F.when(name_bytes <= 0xFFFF, F.hex("path")).otherwise(too_long)
    length = F.octet_length("bytes").cast("long")
    crc_sizes = lambda crc, size: F.concat(_little(crc, 4), _little(size, 4), _little(size, 4))
    header = F.concat(F.lit("504B0304" + OLD + PLAIN), crc_sizes(F.crc32("bytes"), length), _little(name_bytes, 2), F.lit("0000"), name)
    records = ranged.select("archive", "at", F.concat(F.unhex(header), "bytes").alias("data"))

    # names, sums and lengths only
    slim = ranged.select("archive", F.shiftright("at", PARTITION_BITS).alias("part"), "at", "path", F.crc32("bytes").alias("crc"), length.alias("size"), (30 + name_bytes + length).alias("record"))
    starts = _before(slim.groupBy("archive", "part").agg(F.sum("record").alias("record")), ["record"]).select("archive", "part", F.col("_record").alias("start"))
    inside = Window.partitionBy("archive", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumn("inner", F.coalesce(F.sum("record").over(inside), F.lit(0))).join(starts, ["archive", "part"]).withColumn("offset", F.col("start") + F.col("inner"))
    far = F.col("offset") >= large
    entry = F.concat(
        F.lit("504B0102" + "2D03"), F.when(far, NEW).otherwise(OLD), F.lit(PLAIN), crc_sizes(F.col("crc"), F.col("size")), _little(F.octet_length("path"), 2),
        F.when(far, "0C00").otherwise("0000"), F.lit("0000" * 3), F.when(F.col("path").endswith("/"), FOLDER).otherwise(FILE), F.when(far, "FFFFFFFF").otherwise(_little(F.col("offset"), 4)),
        F.hex("path"), F.when(far, F.concat(F.lit("01000800"), _little(F.col("offset"), 8))).otherwise(""),
    )
    directory = placed.select("archive", (F.col("at") + DIRECTORY).alias("at"), F.unhex(entry).alias("data"))

    sums = placed.groupBy("archive").agg(F.count("*").alias("n"), F.sum("record").alias("place"), F.sum(46 + F.octet_length("path") + F.when(far, 12).otherwise(0)).alias("long"))
    wide = (F.col("place") >= large) | (F.col("long") >= large) | (F.col("n") >= 0xFFFF)
    wide_end = F.concat(
        F.lit("504B0606"), _little(44, 8), F.lit("2D03" + NEW + "00000000" * 2), _little(F.col("n"), 8), _little(F.col("n"), 8), _little(F.col("long"), 8), _little(F.col("place"), 8),
        F.lit("504B0607" + "00000000"), _little(F.col("place") + F.col("long"), 8), _little(1, 4),
    )
    short = lambda c, width: F.when(wide, F.lit("FF" * width)).otherwise(_little(F.col(c), width))
    end = F.concat(F.when(wide, wide_end).otherwise(""), F.lit("504B0506" + "0000" * 2), short("n", 2), short("n", 2), short("long", 4), short("place", 4), F.lit("0000"))
    return records.union(directory).union(sums.select("archive", F.lit(END).cast("long").alias("at"), F.unhex(end).alias("data")))


def contents(pieces: DataFrame) -> DataFrame:
    """The file members of archives as assembled() gives them: archive, at (their order), path, bytes."""
    data, names = F.col("data"), _number(F.col("data"), 27, 2)
    found = pieces.filter(F.col("at") < DIRECTORY).select("archive", "at", F.decode(F.substr(data, F.lit(31), names.cast("int")), "UTF-8").alias("path"), F.substr(data, (names + 31).cast("int"), F.octet_length(data)).alias("bytes"))
    return found.filter(~F.col("path").endswith("/"))


def directory(pieces: DataFrame) -> DataFrame:
    """What the central directories say of their members, folders too: archive, at, path, crc, size, offset."""
    data = F.col("data")
    names, short = _number(data, 29, 2), _number(data, 43, 4)
    name, far = F.substr(data, F.lit(47), names.cast("int")), F.substr(data, (names + 51).cast("int"), F.lit(8))
    own = pieces.filter((F.col("at") >= DIRECTORY) & (F.col("at") < END))
    return own.select("archive", (F.col("at") - DIRECTORY).alias("at"), F.decode(name, "UTF-8").alias("path"), _number(data, 17, 4).alias("crc"), _number(data, 21, 4).alias("size"), F.when(short == LARGE, _number(far, 1, 8)).otherwise(short).alias("offset"))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of (archive, at) with idx, their place in the archive from 0; ranges number their own, counts by range say how many come before."""
    parts = rows.withColumn("part", F.shiftright("at", PARTITION_BITS))
    counts = _before(parts.groupBy("archive", "part").agg(F.count("*").alias("n")), ["n"]).select("archive", "part", "_n")
    own = F.row_number().over(Window.partitionBy("archive", "part").orderBy("at")) - 1
    return parts.withColumn("idx", own).join(counts, ["archive", "part"]).withColumn("idx", F.col("idx") + F.col("_n")).drop("part", "_n", "at")


def joined(pieces: DataFrame, most_bytes: int = JOINED_BYTES) -> DataFrame:
    """Archives as single values: archive, data.  One of more than most_bytes is an error: it stays in pieces."""
    sizes = pieces.groupBy("archive").agg(F.sum(F.octet_length("data")).alias("_bytes"))
    error = F.raise_error(F.format_string("an archive of %d bytes stays in pieces", "_bytes")).cast("boolean")
    small = sizes.filter(F.when(F.col("_bytes") <= most_bytes, True).otherwise(error)).select("archive")
    return pieces.join(small, "archive").groupBy("archive").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY at)").alias("data"))
