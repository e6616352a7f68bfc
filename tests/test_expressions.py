"""Scalar operators on single cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from postloom.functions import dates as T
from postloom.functions import expressions as E


def value(spark, expr, **cols):
    names = list(cols)
    schema = ", ".join(f"{n} {'timestamp' if isinstance(cols[n], datetime.datetime) else 'bigint' if isinstance(cols[n], int) else 'string'}" for n in names)
    return spark.createDataFrame([tuple(cols.values())], schema).selectExpr(f"{expr} as v").first()["v"]


@pytest.mark.parametrize(
    "text, reason",
    [
        ("Лови промокод SALE2024 на все курсы прямо сейчас!", "promocode"), ("Друзья, подпишитесь на наш канал чтобы не пропустить новости технологий", "subscribe_cta"), ("   ", "empty"), (None, "empty"),
        ("Apple представила новый MacBook Pro с обновлённым чипом M4 и улучшенным дисплеем.", "pass"), ("!!! ... 12", "too_short_junk"),
    ],
)
def test_rule_filter(spark, text, reason):
    assert value(spark, E.rule_reason("t"), t=text) == reason


@pytest.mark.parametrize("text, ad", [("Промокод WINTER20 — скидка 30%", True), ("Apple представила iPhone 18 Pro с новой батареей", False), (None, False)])
def test_ad(spark, text, ad):
    assert value(spark, E.is_ad("t"), t=text) is ad


@pytest.mark.parametrize(
    "text, theme", [("Новые санкции, Кремль отвечает", "politics"), ("ChatGPT обновили", "tools"), ("Steam Machine выходит", "gaming"), ("GPU дешевеют", "technology"), ("Pixel Fold", "software"), ("Открыта вакансия", "work"), ("NASA запускает", "science"), ("Компания готовит IPO", "business"), ("погода", "other")]
)
def test_theme(spark, text, theme):
    assert value(spark, E.theme("t"), t=text) == theme


@pytest.mark.parametrize("raw, theme", [("ИИ", "software"), ("ai_software", "software"), ("business_finance", "business"), ("", "other"), (None, "other"), ("GAMING", "gaming")])
def test_normal_theme(spark, raw, theme):
    assert value(spark, E.normal_theme("t"), t=raw) == theme


@pytest.mark.parametrize("q, intent, days", [("Что нового по Apple?", "news", None), ("Почему Apple судится с OpenAI?", "qa", None), ("новости NVIDIA за неделю", None, 7), ("today about Apple", None, 1)])
def test_intent(spark, q, intent, days):
    if intent:
        assert value(spark, E.intent("t"), t=q) == intent
    assert value(spark, E.period_days("t"), t=q) == days


def test_strings(spark):
    assert value(spark, E.slug("t"), t="iPhone 18 Pro") == "iphone-18-pro"
    assert value(spark, E.channel_refs("t"), t="@openai https://t.me/s/nvidia telegram.me/TechCrunch t.me/joinchat @openai") == ["openai", "nvidia", "techcrunch"]
    assert "@trendsetter" not in value(spark, E.without_mentions("t"), t="Обзор, эксклюзив @trendsetter. С 7 июля.")
    assert value(spark, E.dated("t", "date'2026-07-13'"), t="завтра Apple, через три дня анонс") == "14.07 Apple, 16.07 анонс"
    assert value(spark, E.message_url("u", "c", "m"), u="technews", c=1, m=42) == "https://t.me/technews/42"
    assert value(spark, E.message_url("u", "c", "m"), u=None, c=-1001234567890, m=7) == "https://t.me/c/1234567890/7"
    assert value(spark, E.language("t"), t="Привет мир") == "ru" and value(spark, E.language("t"), t="Hello") == "en" and value(spark, E.language("t"), t="123") == "ru"
    assert value(spark, E.escaped("t"), t="a<b & c>") == "a&lt;b &amp; c&gt;"


def test_quiet_hours(spark):
    at = lambda h: datetime.datetime(2024, 1, 31, h, 0)
    assert value(spark, T.quiet("t", "1380", "480"), t=at(23)) and value(spark, T.quiet("t", "1380", "480"), t=at(3)) and not value(spark, T.quiet("t", "1380", "480"), t=at(12))
    assert value(spark, T.minutes("t", 99), t="07:30") == 450 and value(spark, T.minutes("t", 99), t="bad") == 99
    assert not value(spark, T.digest_due("'off'", "t", "t", "t", "540", "false"), t=at(10))
    assert value(spark, T.digest_due("'1h'", "cast(null as timestamp)", "t", "t", "540", "false"), t=at(10))


def test_importance(spark):
    v = spark.sql(f"select {E.importance('5', '1.0D', '52', '3')} as v").first()["v"]
    assert 5 <= v <= 10


def test_capitals_keep_letters_single(spark):
    """ß is no SS: titles in capitals have the letters of the text again when they are lowered."""
    rows = [(0, "GROß ßa ß"), (1, "grüße an alle"), (2, "ﬁn"), (3, ""), (4, "ᾳb")]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r["id"]: (r["c"], r["k"]) for r in df.select("id", F.expr(E.capitals("t")).alias("c"), F.expr(E.title_case(E.capitals("t"))).alias("k")).collect()}
    assert got[0] == ("GROẞ ẞA ẞ", "Groß ẞA ẞ") and got[1] == ("GRÜẞE AN ALLE", "Grüße AN Alle")
    assert got[2][0] == "ﬁN" and got[3] == ("", "") and got[4][0] == "ᾼB"


def test_hashed_words_stay_in_tasks_that_grow_with_the_table(spark, sf, monkeypatch):
    """Texts are dealt by id, not their sums: as many tasks as the table asks for, and one exchange."""
    from postloom.functions.vectors import hashed_words
    from postloom.plans import catalogue
    from postloom.sources import tables as T

    df = spark.createDataFrame([(1, "a b b c"), (1, "b d"), (2, None), (3, "")], "id long, text string")
    assert sorted(hashed_words(df, "id", "text", 384, 5).collect()) == sorted(hashed_words(df, "id", "text", 384).collect()) != []
    monkeypatch.setattr(T, "tasks", lambda df, each: 9)
    for name in ("hash_embedding_sparse", "hash_embedding_norms"):
        assert catalogue.queries()[name](spark, sf).rdd.getNumPartitions() == 9
