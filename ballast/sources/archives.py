"""Members of zip and tar archives, read in splits, so that an archive of any size is many tasks' work.

Spark's text reader splits files by a separator of any bytes: here the mark that begins a zip member's header, or that stands in a tar
member's. It knows where blocks of a bzip2 file begin, so a tar.bz2 is split too; a tar.gz is one task's, in a stream. What lies between two
marks is a piece. A mark may also occur inside a member by chance, or in an archive inside the archive, so pieces are
placed by their offsets in the file (sums over splits, as pieces and marks add up to the file), and offsets tell which marks are headers:

* zip: those that the directory at the file's end names;
* tar: those at the places of headers that no member before them covers.

These outlines hold a row for each piece, without its data. Then the pieces of each member meet by its offset and are put
together; zip members are inflated and checked there. An archive whose members do not add up fails with a message.

A member and a zip's directory are bounded by a row (2 GB); an archive is not. Folders, links and other members
without data are left out. Empty archives and no archives give no rows. Encrypted zips and zips in several parts fail.
"""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ballast.functions.durable import cut
from ballast.operators.sample import carried

# Fixed values of the formats: what begins a zip member's header, and what stands 257 bytes into a tar member's of 512.
ZIP_MARK, TAR_MARK, TAR_AT, TAR_BLOCK = "PK\x03\x04", "ustar", 257, 512
_ENTRY = "array<struct<at:bigint,member:string,packed:bigint,crc:bigint,method:int,flags:int>>"
_OUTLINE = f"path string, block long, rel long, size long, before binary, head binary, entries {_ENTRY}"
_ENTRY_TYPE = pa.struct([("at", pa.int64()), ("member", pa.string()), ("packed", pa.int64()), ("crc", pa.int64()), ("method", pa.int32()), ("flags", pa.int32())])
_OUTLINE_TYPE = pa.schema([("path", pa.string()), ("block", pa.int64()), ("rel", pa.int64()), ("size", pa.int64()), ("before", pa.binary()), ("head", pa.binary()), ("entries", pa.list_(_ENTRY_TYPE))])


def _pieces(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """``(path, block, value)`` of the pieces of files, in order inside each split, whose start ``block`` is."""
    return spark.read.option("lineSep", mark).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _outlined(mark: bytes, zipped: bool):
    """A row for each piece, and one with ``rel`` -1 for each split: its size, its last bytes, and the directory if it ends in one."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, tail, last, held = None, 0, b"", b"", []

        def end() -> tuple:
            return (*own, -1, at, tail, b"", directory(last) if zipped else None)

        for batch in it:
            for path, block, value in zip(*(c.to_pylist() for c in batch.columns)):
                if (path, block) != own:
                    if own:
                        held.append(end())
                    own, at, tail = (path, block), 0, b""
                special = not zipped and (not at or tail[156:157] in (b"L", b"x"))  # the data may be the next member's name
                held.append((*own, at, len(value), b"" if zipped else tail, value[:4096] if special else value[:238], None))
                last = value
                at += len(value) + len(mark)
                tail = (tail + mark + value if len(value) < TAR_AT and at > len(value) + len(mark) else value)[-TAR_AT:]
            if held:
                yield _rows(held)
                held = []
        if own:
            yield _rows([end()])

    return run


def _rows(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _OUTLINE_TYPE)], schema=_OUTLINE_TYPE)


def directory(piece: bytes) -> list[dict] | None:
    """The entries of the central directory that ``piece`` ends in, or None if it ends in none."""
    end = piece.rfind(b"PK\x05\x06")
    if end < 0 or end + 22 > len(piece):
        return None
    part, first, _, n, size, offset = struct.unpack_from("<HHHHII", piece, end + 4)
    if 0xFFFF in (n, part) or 0xFFFFFFFF in (size, offset):  # the large form
        end = piece.rfind(b"PK\x06\x06", 0, end)
        if end < 0 or end + 56 > len(piece):
            return None
        part, first, _, n, size, offset = struct.unpack_from("<IIQQQQ", piece, end + 16)
    at, found = end - size, []
    if at < 0 or part or first:
        return None
    for _ in range(n):
        if piece[at : at + 4] != b"PK\x01\x02" or at + 46 > end:
            return None
        _, _, flags, method, _, _, crc, packed, plain, n_name, n_extra, n_note, _, _, _, start = struct.unpack_from("<HHHHHHIIIHHHHHII", piece, at + 4)
        name, extra = piece[at + 46 : at + 46 + n_name], piece[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, length = struct.unpack_from("<HH", extra)
            if kind == 1:  # numbers too large for their fields, in this order
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                start = next(wide) if start == 0xFFFFFFFF else start
            extra = extra[4 + length :]
        found.append({"at": start, "member": name.decode("utf-8" if flags & 0x800 else "cp437", "replace"), "packed": packed, "crc": crc, "method": method, "flags": flags})
        at += 46 + n_name + n_extra + n_note
    return found


def _numbered(mark: bytes):
    """Pieces with ``rel``, their place in their split."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = None, 0
        for batch in it:
            rels = []
            for path, block, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), pc.binary_length(batch.column(2)).to_pylist()):
                if (path, block) != own:
                    own, at = (path, block), 0
                rels.append(at)
                at += size + len(mark)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rels, pa.int64()), batch.column(2)], names=["path", "block", "rel", "value"])

    return run


def _placed(outline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(splits, pieces)``: splits with the bytes before them and the last bytes before them; pieces with ``at``, their place in the file."""
    order = W.partitionBy("path").orderBy("block")  # a row for each split of a file
    tails = F.concat(F.coalesce(F.lag("before", 2).over(order), F.lit(b"")), F.coalesce(F.lag("before", 1).over(order), F.lit(b"")))
    splits = outline.where("rel = -1").select("path", "block", "entries", F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"), tails.alias("ahead"), F.lead("block").over(order).isNull().alias("is_last"))
    pieces = outline.where("rel >= 0").drop("entries").join(splits.drop("entries", "is_last"), ["path", "block"])
    return splits, pieces.withColumn("at", F.col("base") + F.col("rel"))


def _carry(pieces: DataFrame, what: Column, name: str, before: bool) -> DataFrame:
    """``pieces`` with the running maximum of ``what`` along each file, without the own one if ``before``; a split is one range."""
    ranges = carried(pieces.withColumn("__range", F.col("block")).withColumn("__what", what), ["path"], F.max("__what"), "__earlier", F.max)
    inside = W.partitionBy("path", "block").orderBy("rel").rowsBetween(W.unboundedPreceding, -1 if before else 0)
    return ranges.withColumn(name, F.greatest("__earlier", F.max("__what").over(inside))).drop("__range", "__what", "__earlier")


def _together(spark: SparkSession, path: str, mark: str, owned: DataFrame, *keep: str) -> DataFrame:
    """``owned`` ``(path, block, rel, at, start, keep...)`` pieces put together by ``start``, with the mark between: ``(path, start, keep..., data)``."""
    raw = _pieces(spark, path, mark).mapInArrow(_numbered(mark.encode()), "path string, block long, rel long, value binary")
    met = raw.join(owned, ["path", "block", "rel"]).groupBy("path", "start").agg(*(F.max(c).alias(c) for c in keep), F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"))
    first = F.element_at("parts", 1)["value"]
    rest = F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), first, lambda acc, x: F.concat(acc, F.lit(mark.encode()), x["value"]))
    return met.select("path", "start", *keep, rest.alias("data"))


def read_zip(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``(path, member, raw)`` of the files in zip archives, of those whose names ``pattern`` (a regular expression) matches if there is one."""
    mark = ZIP_MARK.encode()
    outline = cut(_pieces(spark, path, ZIP_MARK).mapInArrow(_outlined(mark, True), _OUTLINE))
    splits, pieces = _placed(outline)
    whole = splits.where("is_last")
    if not whole.where("entries IS NULL").isEmpty():
        raise ValueError("an archive does not end in a directory of its members")
    entries = whole.select("path", F.explode("entries").alias("e")).select("path", F.col("e.at").alias("start"), "e.member", "e.packed", "e.crc", "e.method", "e.flags")
    places = pieces.select("path", "block", "rel", "at", (F.col("at") - len(mark)).alias("start"))
    marked = places.join(entries, ["path", "start"], "left")
    owned = cut(_carry(marked.select("path", "block", "rel", "at", F.when(F.col("member").isNotNull(), F.col("start")).alias("__s")), F.col("__s"), "start", False).where("start is not null").select("path", "block", "rel", "at", "start"))
    lost = entries.join(owned.withColumn("__at", F.col("at") - len(mark)).where("__at = start").select("path", "start"), ["path", "start"], "left_anti")
    if not lost.isEmpty():
        raise ValueError("the directory of an archive names members that are not there")
    wanted = entries.where(~F.col("member").endswith("/"))
    wanted = wanted.where(F.col("member").rlike(pattern)) if pattern else wanted
    found = _together(spark, path, ZIP_MARK, owned.join(wanted, ["path", "start"]), "member", "packed", "crc", "method", "flags")
    return found.select("path", "member", "packed", "crc", "method", "flags", "data").mapInArrow(_inflated, "path string, member string, raw binary")


def _inflated(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for k in range(len(batch)):
            path, member, packed, crc, method, flags, data = (c[k].as_py() for c in batch.columns)
            raw = inflate(data, packed, method, flags, member)
            if zlib.crc32(raw) != crc:
                raise ValueError(f"{member} in {path} does not have its checksum")
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([member]), pa.array([raw], pa.binary())], names=["path", "member", "raw"])


def inflate(data: bytes, packed: int, method: int, flags: int, member: str) -> bytes:
    """A zip member's bytes; ``data`` begins behind the mark of its header."""
    if flags & 1:
        raise ValueError(f"{member} is encrypted")
    n_name, n_extra = struct.unpack_from("<HH", data, 22)
    body = data[26 + n_name + n_extra :][:packed]
    if method == 0:
        return body
    if method == 8:
        return zlib.decompress(body, -15)
    if method == 12:
        return bz2.decompress(body)
    if method == 14:  # the properties' length stands before them
        n = struct.unpack_from("<H", body, 2)[0]
        lc, lp, pb = body[4] % 9, body[4] // 9 % 5, body[4] // 45
        return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "lc": lc, "lp": lp, "pb": pb, "dict_size": struct.unpack_from("<I", body, 5)[0]}]).decompress(body[4 + n :])
    raise ValueError(f"{member} is packed by a method that is not known: {method}")


def _field(column: Column, at: int, length: int) -> Column:
    """A field of bytes as text, up to the first zero."""
    return F.substring_index(F.substring(column, at + 1, length).cast("string"), "\0", 1)


def read_tar(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``(path, member, raw)`` of the regular files in tar, tar.gz and tar.bz2 archives, of those whose names ``pattern`` matches if there is one.

    Headers must have the mark of the POSIX and GNU formats; long names of both kinds are read.
    """
    mark, behind = TAR_MARK.encode(), TAR_BLOCK - TAR_AT - len(TAR_MARK)  # bytes of a header behind its mark
    outline = cut(_pieces(spark, path, TAR_MARK).mapInArrow(_outlined(mark, False), _OUTLINE))
    _, pieces = _placed(outline)
    before = F.substring(F.when(F.octet_length("before") < TAR_AT, F.concat("ahead", "before")).otherwise(F.col("before")), -TAR_AT, TAR_AT)
    size = F.trim(F.regexp_replace(_field(F.col("b"), 124, 12), r"\s", ""))
    wide = F.substring("b", 125, 1) == F.lit(b"\x80")  # a number of 64 bits
    octal = size.rlike("^[0-7]+$")
    length = F.when(wide, F.conv(F.hex(F.substring("b", 129, 8)), 16, 10).cast("long")).when(octal, F.conv(size, 8, 10).cast("long"))
    start = F.col("at") - len(mark) - TAR_AT
    headers = pieces.withColumn("b", before).withColumn("start", start).withColumn("length", F.when((F.octet_length("b") == TAR_AT) & (F.col("start") >= 0) & (F.col("start") % TAR_BLOCK == 0), length))
    end = F.col("start") + TAR_BLOCK + TAR_BLOCK * F.ceil(F.col("length") / TAR_BLOCK)
    covered = _carry(headers.withColumn("end", end), F.col("end"), "cover", True)
    real = F.col("length").isNotNull() & (F.col("start") >= F.coalesce("cover", F.lit(0)))
    prefix = F.when(F.substring("head", 1, 1) == F.lit(b"\0"), F.nullif(_field(F.col("head"), 345 - TAR_AT - len(mark), 155), F.lit("")))  # the POSIX form alone has one
    named = covered.withColumn("real", real).withColumn("kind", _field(F.col("b"), 156, 1)).withColumn("short", F.concat_ws("/", prefix, _field(F.col("b"), 0, 100)))
    owned = _carry(named, F.when(F.col("real"), F.col("start")), "owner", False)
    marked = cut(owned.select("path", "block", "rel", "at", "size", "start", "end", "length", "real", "owner", "kind", "short", "head"))
    headers = marked.where("real")
    # members lie one behind the other from the file's start, or something was taken for a header that is none
    sums = headers.groupBy("path").agg(F.sum(F.col("end") - F.col("start")).alias("sum"), F.max("end").alias("most"))
    if not sums.where("sum <> most").isEmpty():
        raise ValueError("the members of an archive do not follow one another")
    full = marked.where((F.col("at") == 0) & (F.col("size") >= TAR_AT) & (F.substring("head", 1, 1) != F.lit(b"\0")))
    if not full.join(headers, "path", "left_anti").isEmpty():
        raise ValueError("an archive has no header of a known form")
    data = F.substring("head", behind + 1, F.col("length").cast("int"))
    said = headers.where(F.col("kind").isin("L", "x")).select("path", F.col("end").alias("start"), F.when(F.col("kind") == "L", _field(data, 0, 4096)).otherwise(F.regexp_extract(data.cast("string"), r"(?:^|\n)\d+ path=([^\n]*)", 1)).alias("long"))
    files = headers.where(F.col("kind").isin("0", "", "7")).select("path", "start", "length", "short").join(said, ["path", "start"], "left").select("path", "start", "length", F.coalesce(F.nullif("long", F.lit("")), "short").alias("member"))
    files = files.where(F.col("member").rlike(pattern)) if pattern else files
    wanted = marked.select("path", "block", "rel", "at", F.col("owner").alias("start")).join(files, ["path", "start"])
    return _together(spark, path, TAR_MARK, wanted, "member", "length").select("path", "member", F.substring("data", behind + 1, F.col("length").cast("int")).alias("raw"))


def read_members(spark: SparkSession, path: str, pattern: str | None = None, kind: str | None = None) -> DataFrame:
    """``(path, member, raw)`` of archives; ``kind`` is ``zip`` or ``tar``, and told by the path's ending if it is not given."""
    zipped = path.lower().endswith(".zip") if kind is None else kind == "zip"
    return (read_zip if zipped else read_tar)(spark, path, pattern)
