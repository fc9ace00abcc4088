"""Members of archives read in splits, against the standard library."""

import bz2
import gzip
import io
import random
import tarfile
import zipfile

import pytest

from ballast.sources import archives, tables

MB = "spark.sql.files.maxPartitionBytes"


@pytest.fixture()
def small_splits(spark):
    old = spark.conf.get(MB)
    spark.conf.set(MB, "20000")
    yield
    spark.conf.set(MB, old)


def payloads():
    draw = random.Random(4)
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:  # stored, so its marks are in the open
        for k in range(40):
            z.writestr(f"in/{k}.txt", f"inner {k} " * draw.randrange(60))
    inner_tar = io.BytesIO()
    with tarfile.open(fileobj=inner_tar, mode="w") as t:
        for k in range(30):
            add(t, f"in/{k}.txt", f"inner {k} ".encode() * draw.randrange(60))
    out = {"plain/0.txt": b"", "plain/1.txt": b"x", "nested.zip": inner.getvalue(), "nested.tar": inner_tar.getvalue(), "marks.bin": b"PK\x03\x04" * 500 + b"ustar" * 700 + b"PK\x05\x06", "ustar.txt": b"ustar ustar"}
    out |= {f"mail/{k}.aa": bytes(draw.randrange(256) for _ in range(draw.randrange(3000))) for k in range(150)}
    out |= {"ünï/日本.txt": "é".encode() * 900, "a/" + "long" * 40 + "/" + "name" * 30: b"far", "tail": b"z" * 5000}
    return out


def add(t, name, data):
    info = tarfile.TarInfo(name)
    info.size = len(data)
    t.addfile(info, io.BytesIO(data))


def test_zip_in_splits(spark, tmp_path, small_splits):
    want = payloads()
    ways = [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.mkdir("folder")
        for k, (name, data) in enumerate(want.items()):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=k % 5 == 0) if k % 2 else io.BytesIO() as f:
                f.write(data)
            if not k % 2:
                z.writestr(name, data, compress_type=ways[k // 2 % 4] if "marks" not in name and "nested" not in name else zipfile.ZIP_STORED)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("one", b"1" * 100_000, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    with zipfile.ZipFile(tmp_path / "c.zip", "w"):
        pass
    assert spark.read.text(str(tmp_path / "a.zip")).rdd.getNumPartitions() > 5
    got = {(r.path.rpartition("/")[2], r.member): bytes(r.raw) for r in archives.read_zip(spark, str(tmp_path / "*.zip")).collect()}
    assert got == {("a.zip", k): v for k, v in want.items()} | {("b.zip", "one"): b"1" * 100_000}
    some = archives.read_zip(spark, str(tmp_path / "*.zip"), r"^mail/\d\.aa$").collect()
    assert len(some) == 10


@pytest.mark.parametrize("form", [tarfile.GNU_FORMAT, tarfile.PAX_FORMAT, tarfile.USTAR_FORMAT])
def test_tar_in_splits(spark, tmp_path, small_splits, form):
    want = payloads()
    if form == tarfile.USTAR_FORMAT:
        want = {k[-90:]: v for k, v in want.items() if k.isascii()} | {"p" * 120 + "/q": b"prefixed"}
    plain = io.BytesIO()
    with tarfile.open(fileobj=plain, mode="w", format=form) as t:
        folder = tarfile.TarInfo("folder")
        folder.type = tarfile.DIRTYPE
        t.addfile(folder)
        for name, data in want.items():
            add(t, name, data)
    (tmp_path / "a.tar").write_bytes(plain.getvalue())
    (tmp_path / "b.tar.gz").write_bytes(gzip.compress(plain.getvalue()))
    (tmp_path / "c.tar.bz2").write_bytes(bz2.compress(plain.getvalue(), 1))  # blocks of 100 kB
    with tarfile.open(tmp_path / "d.tar", "w", format=form):
        pass
    got = {(r.path.rpartition("/")[2], r.member): bytes(r.raw) for r in archives.read_tar(spark, str(tmp_path / "*.tar*")).collect()}
    assert got == {(a, k): v for a in ("a.tar", "b.tar.gz", "c.tar.bz2") for k, v in want.items()}


def test_a_bzip2_archive_is_several_tasks(spark, tmp_path, small_splits):
    draw = random.Random(6)
    with tarfile.open(tmp_path / "a.tar.bz2", "w:bz2", compresslevel=1) as t:
        for k in range(900):
            add(t, f"m/{k}.x", bytes(draw.randrange(256) for _ in range(700)))
    blocks = archives._pieces(spark, str(tmp_path / "a.tar.bz2"), archives.TAR_MARK).select("block").distinct().count()
    got = archives.read_tar(spark, str(tmp_path / "a.tar.bz2"), r"\d+\.x$")
    assert blocks >= 5 and got.count() == 900 and {len(r.raw) for r in got.collect()} == {700}


def test_broken_archives_fail(spark, tmp_path):
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w") as z:
        z.writestr("a", b"hello" * 50)
        z.writestr("b", b"there" * 50)
    raw = whole.getvalue()
    for name, data, says in (("sum", raw.replace(b"hellohello", b"hellohelly", 1), "checksum"), ("cut", raw[:-30], "directory"), ("lost", raw.replace(b"PK\x03\x04", b"PK\x03\x05", 1), "not there")):
        (tmp_path / f"{name}.zip").write_bytes(data)
        with pytest.raises(Exception, match=says):
            archives.read_zip(spark, str(tmp_path / f"{name}.zip")).collect()
    (tmp_path / "no.tar").write_bytes(b"a" * 4000)
    with pytest.raises(Exception, match="known form"):
        archives.read_tar(spark, str(tmp_path / "no.tar")).collect()


def test_labelled_lines_and_mail_of_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "sms.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("SMSSpamCollection", "ham\tone\ttwo\nspam\té\n\nham\tlast\n")
        z.writestr("readme", "not\tread\n")
        z.writestr("box/7.aa", b"Subject: x\n\n\xff")
    got = sorted(tuple(r) for r in tables.read_labelled_lines(spark, str(tmp_path / "sms.zip"), "^SMSSpamCollection$").collect())
    assert got == [(0, "ham", "one\ttwo"), (1, "spam", "é"), (3, "ham", "last")]
    mail = tables.read_mail_archive(spark, str(tmp_path / "sms.zip")).collect()
    assert [(r.member, r.spam, bytes(r.raw)) for r in mail] == [("box/7.aa", False, b"Subject: x\n\n\xff")]
