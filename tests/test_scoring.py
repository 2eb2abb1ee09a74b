import pytest
from pyspark.sql import functions as F

from siftstream.operators import scoring as S
from siftstream.plans import lexicons as L

NOW = F.lit("2024-05-02 12:00:00").cast("timestamp")


def score(value, title, weight=5, ago="24 hours", summary="", boost=None):
    at = NOW - F.expr(f"INTERVAL {ago}")
    return value(S.base_score(F.lower(F.lit(f"{title} {summary}")), F.lit(weight).cast("int"), at, NOW, boost=boost))


@pytest.mark.parametrize("title, want", [
    ("Burglary in town", 0), ("Police drug bust downtown", 0), ("Mayor indicted over cocaine trafficking", 4), ("Mayor indicted after cocaine bust", 1), ("Robbery and arson", 0), ("Quiet day", 0),
    ("FOMC statement due", 8), ("Major earthquake hits", 6), ("Apple results", 1.5),
])
def test_score(value, title, want):
    assert score(value, title) == want


@pytest.mark.parametrize("weight, ago, want", [(9, "30 minutes", 2.0), (7, "59 minutes", 1.5), (8, "61 minutes", 1.0), (6, "3 hours", 0.0), (None, "-1 hours", 1.0)])
def test_weight_and_age(value, weight, ago, want):
    assert score(value, "Nothing here", weight, ago) == want


def test_ceilings(value):
    assert score(value, "inflation gdp earnings merger tariff", 9, "30 minutes") == 8
    assert score(value, "nuclear sanctions coup", 9, "30 minutes") == 10
    assert score(value, "Nothing", boost=F.lit(2.5)) == 2.5


@pytest.mark.parametrize("text, level, reasons", [
    ("Two killed in crash", "high", ["killed"]), ("DOJ files lawsuit", "medium", ["doj", "lawsuit"]), ("Local bakery opens", "low", []), ("Shooting after protest", "high", ["shooting"]), ("Skilled adjoining worker", "low", []),
])
def test_risk(value, text, level, reasons):
    got = value(S.risk(F.lit(text)))
    assert (got.level, got.reasons) == (level, reasons)


@pytest.mark.parametrize("title, want", [
    ("Transfer of power in Iran", ["🇮🇷 Iran"]), ("NBA playoff tonight", ["🏆 Sports"]), ("NBAA meeting", []),
    ("China, Russia and Iran discuss oil price and bitcoin and AI", ["🇨🇳 China", "🇷🇺 Russia", "🪙 Crypto", "🤖 AI"]),
])
def test_topics(value, title, want):
    assert value(S.topics(F.lit(title), F.lit(None).cast("string"), L.GEO_TAGS, L.TOPIC_TAGS)) == want


@pytest.mark.parametrize("words, text, ok", [(["fomc", "rate cut"], "FOMC weighs rate cut", True), (["fomc", "gdp"], "FOMC meets", False), ([], "FOMC rate cut", False)])
def test_mergeable(value, words, text, ok):
    assert value(S.mergeable(F.array(*map(F.lit, words)).cast("array<string>"), F.lit(text))) is ok


@pytest.mark.parametrize("volume, want", [(1000.0, 1.5), (1e6, 3.0), (1e9, 3.0), (0.5, 0.0), (0.0, 0.0)])
def test_log_boost(value, volume, want):
    assert value(S.log_boost(F.lit(volume))) == pytest.approx(want)


def test_lexicon_sizes():
    assert [len(x) for x in (L.NEWS.top, L.NEWS.middle, L.NEWS.light, L.NEWS.priority, L.NEWS.grave, L.NEWS.penalised, L.NEWS.serious)] == [26, 32, 10, 57, 12, 18, 24]
    assert (len(L.GEO_TAGS), len(L.TOPIC_TAGS), len(L.LOW_SIGNAL), len(set(L.PUBLISHERS)), len(L.FILING_ITEMS), len(L.TAG_LABELS)) == (12, 14, 23, 91, 16, 25)
