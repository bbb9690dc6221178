"""Decoders and terminal styles on odd input."""

import pytest
from pyspark.sql import functions as F

from silt.functions import text as T


def shown(spark, fn, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in rows.orderBy("i").select(fn(F.col("t")).alias("x")).collect()]


CASES = [
    (T.url_decoded, [("a%20b", "a b"), ("100%", "100%"), ("%zz%41", "%zzA"), ("%", "%"), ("a+b", "a+b"), ("%C3%A4", "ä"), ("%2541", "%41"), ("", ""), (None, None)]),
    (T.unicode_unescaped, [("\\u00e4", "ä"), ("\\u00e", "\\u00e"), ("\\\\u0041", "\\A"), ("\\u0041\\u0042", "AB"), ("none", "none"), (None, None)]),
    (T.hex_unescaped, [("\\x41\\x4", "A\\x4"), ("\\xZZ", "\\xZZ"), ("\\x7e", "~"), ("", "")]),
    (T.html_unescaped, [("&lt;&amp;lt;&gt;", "<&lt;>"), ("&nope;", "&nope;"), ("&#228;&#xe4;", "ää"), ("&amp", "&"), (None, None)]),
    (T.mime_decoded, [("=?utf-8?q?a_=C3=BC?=", "a ü"), ("=?utf-8?b?w6Q=?= x", "ä x"), ("plain", "plain"), ("=?utf-8?q?open", "=?utf-8?q?open"), ("=?iso-8859-1?q?=E4?= =?utf-8?q?=C3=A4?=", "ää")]),
    (T.ansi_html, [("\x1b[38;2;1;2;255mx", '<span style="color:#0102ff">x</span>'), ("\x1b[48;5;196my\x1b[0mz", '<span style="background-color:#ff0000">y</span>z'), ("\x1b[1;31ma\x1b[22mb", '<span style="color:#aa0000;font-weight:bold">a</span><span style="color:#aa0000">b</span>'), ("\x1b[2Ja<b", "a&lt;b"), ("\x1b]0;title\x07t", "t"), ("\x1b[38;2;1mx", None)]),
]


@pytest.mark.parametrize("fn,cases", CASES)
def test_odd_codes(spark, fn, cases):
    got = shown(spark, fn, [a for a, _ in cases])
    assert [(a, g) for (a, w), g in zip(cases, got, strict=True) if w is not None or a is None] == [(a, w) for a, w in cases if w is not None or a is None]
