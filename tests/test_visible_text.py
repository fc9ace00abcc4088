"""The SQL of visible_text against the parser, on character references that pages cut short."""

from ballast.plans import convert, registry  # noqa: F401
from tests.oracle import check


def test_references_without_a_semicolon(spark, tmp_path):
    heads = ["a&&&amp", "a &amp", "&ampx;", "&copy2", "&lt&gt", "&amp;lt;", "&amplt;", "&quot&nbsp&middot", "&am", "&;&&"]
    pages = [(k, f"<title>{x}</title><p>{x}</p>") for k, x in enumerate(heads)]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    for f in (tmp_path / "made").iterdir():
        f.unlink()
    (tmp_path / "made").rmdir()
    check(spark, "visible_text", registry.QUERIES["visible_text"], registry.ORACLE["visible_text"], str(tmp_path))
