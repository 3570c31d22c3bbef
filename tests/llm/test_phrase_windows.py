"""Windows of phrase mining travel as one string each."""

from collections import Counter

from beaconflow.llm import phrases as P


def test_a_window_is_one_string(spark):
    docs = spark.createDataFrame([("en", "new york is big. new york"), ("en", "rare"), ("fr", "new\tyork"), ("de", "")], "lang string, text string")
    x = docs.coalesce(1)
    often = P.frequent_slots(x, [1, 2], {}, 18, 2)
    got = Counter()
    w = P.windows(x, often, 18, 4)
    assert w.columns == ["lang", "window", "n"]
    for r in w.collect():
        got[r.lang, r.window] += r.n
    # is, big, rare and the French words occur once: nothing of their windows is left but the count
    assert got == {("en", "new york"): 2, ("en", "york"): 2, ("en", ""): 3, ("fr", ""): 2}
