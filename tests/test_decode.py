import pytest
from pyspark.sql import functions as F

from sedgeline.functions import text

CASES = [
    ("windows-1251", "Привет, мир"), ("KOI8-R", "Привет"), ("iso-8859-2", "Žluťoučký kůň"), ("iso-8859-7", "Καλημέρα"), ("iso-8859-15", "5 €"), ("windows-1255", "שלום"), ("windows-1256", "مرحبا"), ("macintosh", "naïve"), ("ibm866", "Привет"),
    ("Shift_JIS", "日本語テスト"), ("euc-jp", "日本語"), ("gbk", "汉字"), ("gb2312", "汉字"), ("big5", "漢字"), ("euc-kr", "한국어"), ("utf-8", "süß"), ("windows-1252", "“x”"), ("", "süß"), ("unknown-8", "süß"),
]
NAMES = {"macintosh": "mac-roman", "ibm866": "cp866", "": "utf-8", "unknown-8": "utf-8"}


def test_declared_charsets(spark):
    rows = [(c, bytearray(t.encode(NAMES.get(c, c.lower())))) for c, t in CASES]
    df = spark.createDataFrame(rows, "cs string, body binary")
    assert [r.x for r in df.coalesce(1).select(text.decode_text(F.col("body"), F.col("cs")).alias("x")).collect()] == [t for _, t in CASES]


@pytest.mark.parametrize("charset", ["windows-1251", "shift_jis", "gb18030", None])
def test_damaged_and_absent_bytes(spark, charset):
    df = spark.createDataFrame([(bytearray(b"a\xff\x81"),), (None,), (bytearray(b""),)], "body binary")
    got = [r.x for r in df.coalesce(1).select(text.decode_text(F.col("body"), F.lit(charset)).alias("x")).collect()]
    assert got[0].startswith("a") and got[1] is None and got[2] == ""
