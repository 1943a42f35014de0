"""Grams are counted where texts are, and only terms that can be alike are compared."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from folioscan.plans import mine


def test_grams_are_counted_without_a_shuffle(spark):
    texts = {1: "合同约定ab合同约定\U0001f600合", 2: "plain", 3: None, 4: "合", 5: "xy一二三" * 9000}
    df = spark.createDataFrame(list(texts.items()), "doc long, text string")
    found = mine.grams(df)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = Counter((d, t[i : i + k]) for d, t in texts.items() for k in range(3, 7) for i in range(len(t or "") - k + 1) if any("一" <= c <= "鿿" for c in t[i : i + k]))
    assert {(r.doc, r.gram): r.n for r in found.collect()} == want
    assert {(r.doc, r.gram): r.n for r in mine.grams(df, least=2).collect()} == {k: n for k, n in want.items() if n >= 2}


def test_terms_too_short_to_be_alike_are_not_compared(spark, monkeypatch):
    @F.pandas_udf("double")
    def never(a: pd.Series, b: pd.Series) -> pd.Series:
        if len(a):
            raise ValueError(f"{a.iloc[0]} and {b.iloc[0]} were compared")
        return pd.Series([], dtype="float64")

    monkeypatch.setattr(mine, "likeness", never)
    rows = [(d, "".join(("甲", "乙", chr(0x4E00 + d * 40 + i))) + more, 2) for d in range(4) for i in range(30) for more in ("", "丁")]
    assert mine.conflicts(spark.createDataFrame(rows, "doc long, gram string, n long")).count() == 0
