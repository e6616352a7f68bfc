"""The domain's tables over the provided Parquet tables. Each has a Spark form and the same as an SQL subquery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the decorated posts say besides their text, by doc_id % 40: every rule, theme and alias gets rows.
ADDED = {
    0: " Promo code SALE2024", 1: " скидки на все курсы", 2: " Подпишись на наш канал", 3: " реклама erid 123", 4: " sponsored by NVIDIA", 5: " только сегодня!", 6: " бесплатный вебинар завтра",
    7: " заработок без вложений", 8: " казино онлайн", 9: " https://t.me/+abc", 14: " Apple представила iPhone 18 Pro и MacBook", 15: " OpenAI and Microsoft breaking release of ChatGPT",
    16: " Steam Machine and Xbox gaming", 17: " президент и санкции, Кремль", 18: " вакансии и зарплата, hiring", 19: " NASA телескоп, research", 20: " bitcoin и инвестиции, IPO", 21: " чипы, ransomware, NVIDIA GPU",
    22: " see @TechNews and https://t.me/s/openai, telegram.me/Reuters", 23: " завтра анонс, через два дня релиз, today and tomorrow", 24: " order now: giveaway", 25: " ИИ и нейросеть, эксклюзив @trendsetter", 26: " Почему Apple судится с OpenAI",
    30: " через 12 дней, через 3 дня и ЧЕРЕЗ 400 days, через 99999999999 дней", 31: ", source @some_handle (@other) via @third and x@y.z @ab",
}
#: Short posts of their own, beside the document of that doc_id % 40.
SHORT = {10: "http://a.b http://c.d http://e.f http://g.h", 11: "   ", 12: "!!! 123", 13: "1234567890 1234567890 1234567890 ab", 27: "MAX удалили из Google Play", 28: "Приложение MAX удалили из Google Play", 29: "MAX исчез из магазина Google Play"}
#: Added to the id of a document for its short post.
SHORT_IDS = 1_000_000_000_000


def _cases(texts: dict[int, str]) -> str:
    return "case doc_id % 40 " + " ".join("when {} then '{}'".format(k, v.replace("'", "''")) for k, v in texts.items())


_TEXT, _SHORT, _HAS_SHORT = f"concat(coalesce(text, ''), {_cases(ADDED)} else '' end)", f"{_cases(SHORT)} end", f"doc_id % 40 in ({', '.join(map(str, SHORT))})"

#: Post subquery for the SQL forms: (id, channel, text, lang, minute).
POSTS_SQL = f"""(select doc_id as id, source as channel, {_TEXT} as text, lang, doc_id as minute from documents
 union all select doc_id + {SHORT_IDS}, source, {_SHORT}, lang, doc_id from documents where {_HAS_SHORT})"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over as many tasks as the session runs at once, where the scan has fewer: one file with one row group is one task's
    work, however many cores there are. A table of many files is left as it is, so nothing large is ever shuffled here."""
    most = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= most else df.repartition(most)


#: Rows that a task of a join or aggregation over a table of small rows gets, about. So tasks grow in number with the table, not in memory.
TASK_ROWS = 400_000


def tasks(df: DataFrame, each: int = TASK_ROWS) -> int:
    """Over how many tasks a stored table is dealt; its rows are counted from its files' footers."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // each))


def post_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for what is made of each post's words: some hundred rows a post."""
    return tasks(table(spark, sf_dir, "documents"), 4_000)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts (id, channel, text, lang, minute): every document's whole text, with the additions above, and the short posts."""
    d = table(spark, sf_dir, "documents")
    form = lambda df, more, text: df.select((F.col("doc_id") + more).alias("id"), F.col("source").alias("channel"), F.expr(text).alias("text"), "lang", F.col("doc_id").alias("minute"))
    return form(spread(d.select("doc_id", "source", "text", "lang")), 0, _TEXT).unionAll(form(d.where(_HAS_SHORT), SHORT_IDS, _SHORT))


#: Events with importance, theme number, status, and day (from orders).
NEWS_SQL = """(select o_orderkey as event_id, o_custkey % 97 as channel_id, o_totalprice / 65536.0 as importance, cast(substr(o_orderpriority, 1, 1) as bigint) as theme_no,
  case o_orderstatus when 'O' then 'active' when 'F' then 'archived' else 'merged' end as status, o_orderdate as created_at from orders)"""


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_id"), (F.col("o_custkey") % 97).alias("channel_id"), (F.col("o_totalprice") / 65536.0).alias("importance"),
        F.expr("cast(substr(o_orderpriority, 1, 1) as bigint)").alias("theme_no"),
        F.expr("case o_orderstatus when 'O' then 'active' when 'F' then 'archived' else 'merged' end").alias("status"), F.col("o_orderdate").alias("created_at"),
    )


#: What users did to events (from the events table).
ACTIONS_SQL = """(select event_id as action_id, user_id, event_id % 40 * 7 + 1 as news_id, ts,
  case event_type when 'view' then 'read' when 'click' then 'like' when 'purchase' then 'favorite' when 'error' then 'dislike' else 'shown' end as action, value from events)"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("action_id"), "user_id", F.expr("event_id % 40 * 7 + 1").alias("news_id"), "ts",
        F.expr("case event_type when 'view' then 'read' when 'click' then 'like' when 'purchase' then 'favorite' when 'error' then 'dislike' else 'shown' end").alias("action"), "value",
    )


#: Which nodes an event mentions (from lineitem).
LINKS_SQL = "(select distinct l_orderkey as event_id, l_partkey as node_id from lineitem)"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt by event once, before they are made distinct: joins by event then need no other exchange."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("node_id")).repartition(tasks(li), "event_id").distinct()
