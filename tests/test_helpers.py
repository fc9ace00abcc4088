"""Text, mail, tree and archive helpers."""

import io
import json
import tarfile
from email.message import EmailMessage

from ballast.functions import helpers


def test_visible_text_skips_scripts_and_decodes():
    html = '<style>p{}</style><p>Fish &amp; chips</p><script>var t="</p>";</script><div>caf&eacute;<br>open</div>'
    assert helpers.html_text(html) == "Fish & chips café open"
    assert helpers.html_text(None) == "" and helpers.html_text("") == ""


def test_mail_prefers_plain_and_survives_bad_charsets():
    m = EmailMessage()
    m["Subject"] = "x"
    m.set_content("plain  body\n")
    m.add_alternative("<p>html body</p>", subtype="html")
    assert helpers.mail_body(bytes(m)) == "plain body"
    html = b"Content-Type: text/html; charset=utf-8\r\n\r\n<p>only <b>html</b></p>"
    assert helpers.mail_body(html) == "only html"
    odd = b"Content-Type: text/plain; charset=no-such-charset\r\n\r\ncaf\xc3\xa9"
    assert helpers.mail_body(odd) == "café"
    assert helpers.mail_body(None) == "" and helpers.mail_body(b"") == ""


def test_regions():
    leaf = lambda *b, **k: {"bounds": list(b), **k}
    root = {"bounds": [0, 0, 100, 200], "children": [leaf(0, 0, 50, 50), leaf(0, 0, 50, 50), {"bounds": [0, 0, 9, 9], "children": [leaf(1, 1, 3, 3)]}, leaf(0, 0, 300, 9), leaf(5, 5, 6, 6, visibility="gone")]}
    got = helpers.regions(json.dumps({"activity": {"root": root}}))
    assert [r["key"] for r in got] == [1, 4]
    assert got[1] == {"key": 4, "left": 0.01, "top": 0.005, "right": 0.03, "bottom": 0.015}
    assert helpers.regions("{") is None and helpers.regions(None) is None and helpers.regions('{"activity":{"root":{"bounds":[0,0,1,1],"children":[3]}}}') is None


def test_leaves_of_deep_json():
    deep = "x"
    for _ in range(5000):
        deep = [deep]
    assert helpers.leaves_of({"a": "1", "b": ["2", {"c": "3", "n": 4}], "d": deep}) == ["1", "2", "3", "x"]


def test_archive_members(spark, tmp_path):
    with tarfile.open(tmp_path / "box_spam.tar.bz2", "w:bz2") as tar:
        for name in ("spam/1.aa", "spam/notes", "spam/2.bb"):
            data = f"Subject: {name}\n\nbody".encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    from ballast.sources.tables import read_mail_archive

    got = read_mail_archive(spark, str(tmp_path / "*.bz2")).orderBy("member").collect()
    assert [(r.member, r.spam) for r in got] == [("spam/1.aa", True), ("spam/2.bb", True)]


def test_hidden_text_stays_hidden():
    assert helpers.html_text("<script>a<b>c</script>d</script>e<style>x</style>") == "d e"
    assert helpers.html_text("x<p>y<li>z<b>w</b>") == "x y z w"
    assert helpers.html_text("</script>shown<SCRIPT>hidden") == "shown"


def test_blanks_are_the_white_characters(spark):
    from pyspark.sql import functions as F

    from ballast.functions import keys as K

    chars = spark.range(0x11000).where("id < 55296 or id > 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    white = {r.id for r in chars.where(F.col("c").rlike(f"^{K.WHITE}$")).collect()}
    assert white == {ord(c) for c in K.BLANKS}


def test_mail_parts():
    m = EmailMessage()
    m.set_content("<p>one<script>two</script></p>", subtype="html")
    m.add_attachment("attached text", filename="a.txt")
    assert helpers.mail_body(bytes(m)) == "one"
    assert helpers.mail_body(b"Content-Type: application/pdf\r\n\r\nxx") == ""
    assert helpers.mail_body(b"Content-Type: text/plain; charset=base64\r\n\r\na  b") == "a b"
    assert helpers.mail_body(b"no header at all") in ("", "no header at all")


def test_spam_is_told_by_the_archives_name(spark, tmp_path):
    from ballast.sources.tables import read_mail_archive, read_mbox

    folder = tmp_path / "antispam_spam_box"
    folder.mkdir()
    for name in ("easy_ham.tar.bz2", "hard_spam.tar.bz2"):
        with tarfile.open(folder / name, "w:bz2") as tar:
            info = tarfile.TarInfo("m/1.x")
            info.size = 2
            tar.addfile(info, io.BytesIO(b"hi"))
    got = {r.path.rpartition("/")[2]: r.spam for r in read_mail_archive(spark, str(folder / "*.bz2")).collect()}
    assert got == {"easy_ham.tar.bz2": False, "hard_spam.tar.bz2": True}
    raw = [b"Subject: a\n\nbody \xff\xfe\n", b"Subject: b\n\nFromage\n>From x\n", b"Subject: c\n\n"]
    (folder / "ham.mbox").write_bytes(b"".join(b"From me@x Mon\n" + r + b"\n" for r in raw))
    found = sorted(bytes(r.raw) for r in read_mbox(spark, str(folder / "ham.mbox")).collect())
    assert [r.strip() for r in found] == sorted(r.strip() for r in raw)


def test_line_numbers_over_splits(spark, tmp_path):
    from ballast.sources.tables import read_labelled_lines

    for k in range(3):
        (tmp_path / f"f{k}").write_text("".join(f"l{k}\tt{i}\tx\n" if i % 5 else "\n" for i in range(4000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = read_labelled_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 3 * 3200 and all(r.text == f"t{r.uid}\tx" for r in got)
    assert len({(r.label, r.uid) for r in got}) == len(got)


def test_two_encodings_of_a_picture(spark, tmp_path):
    from ballast.plans.sources import _png
    from ballast.sources import tables

    red, blue = b"\xff\0\0" * 4, b"\0\0\xff" * 4
    for name, data in (("a", _png(red, 0)), ("b", _png(red, 9)), ("c", _png(blue, 9))):
        (tmp_path / f"{name}.png").write_bytes(data)
    pixels = {r.path[-5]: r.pixel_key for r in tables.read_pixels(spark, str(tmp_path)).collect()}
    files = {r.path[-5]: r.bytes_key for r in tables.read_images(spark, str(tmp_path)).collect()}
    assert pixels["a"] == pixels["b"] != pixels["c"] and len(set(files.values())) == 3


def test_json_document(spark, tmp_path):
    from ballast.sources import tables

    (tmp_path / "a.json").write_text(json.dumps({"items": [{"a": 1}, {"a": 2}]}, indent=1))
    got = tables.read_json_document(spark, str(tmp_path / "a.json"), "items array<struct<a:int>>", "items")
    assert sorted(r.a for r in got.collect()) == [1, 2]


def test_large_files(spark, tmp_path):
    import hashlib

    from ballast.sources import tables

    (tmp_path / "f").write_bytes(b"x" * 3_000_000)
    good = hashlib.sha256(b"x" * 3_000_000).hexdigest()
    manifest = spark.createDataFrame([(str(tmp_path / "f"), 3_000_000, good), (str(tmp_path / "f"), 3_000_000, "00")], "path string, bytes long, sha256 string")
    assert [r.reason for r in tables.verify_large_files(manifest).collect()] == ["digest"]


def test_normal_forms_of_odd_texts(spark):
    import hashlib
    import random
    import re

    from pyspark.sql import functions as F

    from ballast.functions import keys as K

    draw = random.Random(8)
    parts = ["a", "B2", "_", "é", "日", "½", " ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "-", "...", "!?", "ß", "\x0b", "^", "]", "&"]
    texts = [None, "", " ", "--", " a ", "^^"] + ["".join(draw.choice(parts) for _ in range(draw.randrange(25))) for _ in range(400)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", K.normalized(F.col("t")).alias("n"), K.fingerprint(F.col("t")).alias("f")).collect()
    for r in got:
        if r.t is None:
            assert r.n is None and r.f is None
            continue
        folded = r.t.lower().replace("ß", "ss")
        assert r.n == re.sub(f"[{re.escape(K.BLANKS)}]+", " ", folded).strip(" ")
        assert r.f == hashlib.sha256(" ".join(re.findall(r"\w+", folded)).encode()).hexdigest(), r.t


def test_token_counts_against_the_vocabularys_library(spark):
    from pathlib import Path

    import tiktoken
    from pyspark.sql import functions as F

    from ballast.operators import budget
    from ballast.plans.mixture import RANKS

    ranks = helpers.Ranks(Path(RANKS).read_bytes())
    own = tiktoken.Encoding("own", pat_str=helpers.SPLIT, mergeable_ranks=ranks.ranks, special_tokens={})
    texts = [None, "", " ", "it's  naïve\n\n  straße 日本 ½ ٣ ''s \x00", "a" * 3000, "<|endoftext|>", "\u00a0\u2028 x"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in texts[3:60]:
        for w in set(helpers._WORDS.findall(t)):
            assert [ranks.ranks[p] for p in ranks.merged(w.encode())] == own.encode_ordinary(w), w
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.n for r in df.select("id", budget.vocabulary_tokens(spark, F.col("text"), RANKS).alias("n")).collect()}
    assert got == {i: len(own.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}


def test_missing_large_files(spark, tmp_path):
    from ballast.sources import tables

    (tmp_path / "f").write_bytes(b"x" * 10)
    manifest = spark.createDataFrame([(f"file:{tmp_path}/f", 11, "00"), (str(tmp_path / "none"), 1, "00")], "path string, bytes long, sha256 string")
    assert sorted(r.reason for r in tables.verify_large_files(manifest).collect()) == ["length", "missing"]
    assert tables.verify_large_files(manifest.where("false")).count() == 0
