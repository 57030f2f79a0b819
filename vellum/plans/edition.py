"""Card dealing: what an issue offers, which interests it can serve, which three cards a round gets.

Cards are predicates over an issue's objects. They unpivot into (issue, card, object)
rows in one pass, so any number of issues is dealt for at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.plans.browse import issue_features
from vellum.sources.views import OBJECT_ENTITIES_SQL, OBJECT_EVENTS_SQL, OBJECT_TOPICS_SQL, OBJECTS_SQL, TOPICS_SQL, bare_objects, object_topics, published, published_ids, topics


#: What a text may speak of.
SAYS = {
    "price": lambda text: text.rlike(T.SAYS_PRICE),
    "lost": lambda text: T.about(text, T.LOST),
    "milestone": lambda text: T.about(text, T.MILESTONE),
    "civic": lambda text: T.about(text, T.CIVIC),
    "shows": lambda text: T.about(text, T.SHOWS),
    "property": lambda text: T.about(text, T.PROPERTY),
    "kids": lambda text: T.about(text, T.KIDS),
}


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    # What texts say becomes flags at the scan: no text goes through a join.
    said = [F.coalesce(p(F.col("text")), F.lit(False)).alias(f"says_{n}") for n, p in SAYS.items()]
    o = bare_objects(spark, sf_dir).select("id", "issue_id", "is_advertorial", *said, (F.col("id") % 8).alias("page"))
    f = o.join(published_ids(spark, sf_dir), "id", "left_semi").join(issue_features(spark, sf_dir), "id")
    named = object_topics(spark, sf_dir).join(F.broadcast(topics(spark)), "topic_id").groupBy(F.col("object_id").alias("id")).agg(F.collect_set("name").alias("topics"))  # twelve rows
    return f.join(named, "id", "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))


def _cls(*names: str) -> Column:
    return F.col("object_class").isin(*names)


def _topic(name: str) -> Column:
    return F.array_contains("topics", name)


def is_price() -> Column:
    """Documents print no prices in dollars, so an event's price stands for them all."""
    return F.col("event_price") | F.col("says_price")


def is_odd() -> Column:
    return F.col("is_advertorial") | _cls("legal_notice", "classified_section", "coupon") | F.col("says_lost")


#: Interest -> (least material, predicate). Fixed values of the card library.
INTERESTS = {
    "ads": (3, lambda: _cls("advertisement", "coupon")),
    "people": (5, lambda: F.col("people") > 0),
    "week": (3, lambda: _cls("article") | (F.col("events") > 0)),
    "money": (2, lambda: is_price()),
    "strange": (2, lambda: is_odd()),
}

#: Card -> (interests served, roles or none, odd, least material, predicate). Fixed values of the card library.
CARDS = {
    "ads-best": (("ads",), (), False, 3, lambda: _cls("advertisement")),
    "ads-trick": (("ads", "strange"), ("kid", "curious", "local"), True, 1, lambda: F.col("is_advertorial")),
    "ads-numbers": (("ads",), ("researcher",), False, 5, lambda: _cls("advertisement", "article")),
    "ads-shops": (("ads", "people"), ("family", "local", "researcher"), False, 3, lambda: _cls("advertisement", "article") & (F.col("orgs") > 0)),
    "people-surnames": (("people",), ("family",), False, 5, lambda: F.col("people") > 0),
    "people-milestones": (("people",), ("family", "local", "curious"), True, 1, lambda: F.col("says_milestone")),
    "people-busy": (("people",), (), False, 3, lambda: F.col("people") >= 2),
    "people-orgs": (("people", "week"), ("researcher", "local"), False, 4, lambda: F.col("orgs") > 0),
    "week-news": (("week",), (), False, 3, lambda: _cls("article")),
    "week-calendar": (("week",), ("local", "curious", "kid", "family"), False, 3, lambda: F.col("events") > 0),
    "week-civic": (("week",), ("researcher", "local"), False, 2, lambda: _topic("Local Government & Civic") | F.col("says_civic")),
    "week-sports": (("week",), (), False, 2, lambda: _topic("Sports & Recreation")),
    "week-front": (("week",), (), False, 3, lambda: (F.col("page") == 1) & _cls("article")),
    "money-dollar": (("money",), (), True, 2, lambda: is_price()),
    "money-show": (("money",), ("kid", "curious", "local"), True, 1, lambda: F.col("says_shows") & (is_price() | (F.col("events") > 0))),
    "money-realestate": (("money",), ("local", "family", "researcher"), False, 2, lambda: _topic("Real Estate & Building") | F.col("says_property")),
    "strange-lost": (("strange",), (), True, 1, lambda: F.col("says_lost") | _cls("classified_section")),
    "strange-fineprint": (("strange",), ("researcher", "curious", "family"), True, 1, lambda: _cls("legal_notice")),
    "strange-oddest": (("strange",), (), True, 2, lambda: is_odd()),
    "strange-now": (("strange",), (), False, 3, lambda: F.lit(True)),
    "kids-then": ((), ("kid", "family", "curious", "local"), True, 1, lambda: F.col("says_kids") | _topic("Schools & Education")),
    "best-sentence": ((), (), False, 3, lambda: _cls("article")),
    "unchanged": ((), (), False, 3, lambda: F.lit(True)),
    "faith": ((), ("local", "family", "researcher"), False, 3, lambda: _topic("Churches & Religion")),
}


def _unpivot(f: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """(issue_id, id, card) for every predicate that holds."""
    cards = F.filter(F.array(*[F.when(p, F.lit(n)) for n, p in predicates.items()]), lambda c: c.isNotNull())
    return f.select("issue_id", "id", F.explode(cards).alias("card"))


def interests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interests that an issue can serve, with the size of their material."""
    u = _unpivot(_features(spark, sf_dir), {n: p() for n, (_, p) in INTERESTS.items()}).groupBy("issue_id", F.col("card").alias("interest")).agg(F.count(F.lit(1)).alias("n"))
    least = F.create_map(*[F.lit(x) for n, (m, _) in INTERESTS.items() for x in (n, m)])
    return u.where(F.col("n") >= F.element_at(least, F.col("interest")))


def topic_interests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two topics that an issue is most about, four objects at least."""
    t = _features(spark, sf_dir).select("issue_id", "id", F.explode("topics").alias("topic")).groupBy("issue_id", "topic").agg(F.countDistinct("id").alias("n"))
    w = Window.partitionBy("issue_id").orderBy(F.desc("n"), "topic")
    ranked = t.withColumn("place", F.row_number().over(w))
    return ranked.where("place <= 2 AND n >= 4").select("issue_id", F.concat(F.lit("topic:"), T.slug(F.col("topic"), spaced_and=False)).alias("interest"), "n")


def card_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each library card's material per issue; cards short of material are not offered."""
    u = _unpivot(_features(spark, sf_dir), {n: c[4]() for n, c in CARDS.items()}).groupBy("issue_id", "card").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    least = F.create_map(*[F.lit(x) for n, c in CARDS.items() for x in (n, c[3])])
    return u.where(F.col("n") >= F.element_at(least, F.col("card")))


def candidates(material: DataFrame, cited: DataFrame, taken: DataFrame, role: str) -> DataFrame:
    """Cards an issue may be dealt: not taken, for this role, with enough material, some of it uncited.

    material (issue_id, card, id), cited (issue_id, id), taken (issue_id, card). Adds the
    number of fresh objects and the standing for the role.
    """
    table = {n: (c[3], not c[1] or role in c[1], role in c[1], c[2]) for n, c in CARDS.items()}
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for n, t in table.items() for x in (n, t[i])]), F.col("card"))
    fresh = material.join(cited.withColumn("cited", F.lit(1)), ["issue_id", "id"], "left")
    g = fresh.groupBy("issue_id", "card").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cited").isNull()).alias("fresh"))
    return g.where((F.col("n") >= pick(0)) & pick(1) & (F.col("fresh") > 0)).join(taken, ["issue_id", "card"], "left_anti").withColumns({"for_role": pick(2).cast("int"), "odd": pick(3).cast("int")})


def dealt(cands: DataFrame, first: list[Column], cards: int = 3) -> DataFrame:
    """The best cards by `first`, then by role, fresh material and name."""
    w = Window.partitionBy("issue_id").orderBy(*first, F.desc("for_role"), F.desc("fresh"), "card")
    return cands.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cards).select("issue_id", "place", "card", "fresh")


def _dealing(spark: SparkSession, sf_dir: str) -> DataFrame:
    material = _unpivot(_features(spark, sf_dir), {n: c[4]() for n, c in CARDS.items()})
    cited = published(spark, sf_dir).where("id % 4 = 0").select("issue_id", "id")
    taken = published(spark, sf_dir).select("issue_id").distinct().withColumn("card", F.lit("ads-best"))
    return candidates(material, cited, taken, "curious")


def deal_r1(spark: SparkSession, sf_dir: str, wanted: tuple[str, ...] = ("money", "ads", "week")) -> DataFrame:
    """Round one: the strongest card of each of the reader's interests, in their order."""
    serves = F.create_map(*[x for n, c in CARDS.items() for x in (F.lit(n), F.array(*[F.lit(s) for s in c[0]]).cast("array<string>"))])
    c = _dealing(spark, sf_dir).withColumn("serves", F.element_at(serves, F.col("card")))
    rank = {i: F.row_number().over(Window.partitionBy("issue_id", F.array_contains("serves", i)).orderBy(F.desc("for_role"), F.desc("fresh"), "card")) for i in wanted}
    for i in wanted:
        c = c.withColumn(f"best_{i}", F.array_contains("serves", i) & (rank[i] == 1))
    order = F.when(F.col(f"best_{wanted[0]}"), 0)
    for n, i in enumerate(wanted[1:], 1):
        order = order.when(F.col(f"best_{i}"), n)
    served = F.arrays_overlap("serves", F.array(*[F.lit(i) for i in wanted]))
    return dealt(c, [order.otherwise(F.when(served, len(wanted)).otherwise(len(wanted) + 1))])


def deal_r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round three: the odd cards first."""
    return dealt(_dealing(spark, sf_dir), [F.desc("odd")])


def deal_r4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round four: whatever has most material left."""
    return dealt(_dealing(spark, sf_dir).withColumn("for_role", F.lit(0)), [])


def deep_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic most of the last section's references share, per issue; the first named wins a tie."""
    refs = _features(spark, sf_dir).where("id % 6 = 0").select("issue_id", "id", F.explode("topics").alias("topic"))
    g = refs.groupBy("issue_id", "topic").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("seen"))
    w = Window.partitionBy("issue_id").orderBy(F.desc("n"), "seen", "topic")
    return g.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("issue_id", "topic", "n")


QUERIES = {f.__name__: f for f in (interests, topic_interests, card_material, deal_r1, deal_r3, deal_r4, deep_topic)}

# ── SQL twins ─────────────────────────────────────────────────────────────────────────────

_about = lambda a: f"regexp_matches(text, '(?i)\\b({a})\\b')"
_in = lambda *c: "object_class IN (" + ", ".join(f"'{x}'" for x in c) + ")"
_has = lambda t: f"list_contains(topics, '{t}')"
_PRICE = f"(event_price OR regexp_matches(text, '{T.SAYS_PRICE_RE2}'))"
_ODD = f"(is_advertorial OR {_in('legal_notice', 'classified_section', 'coupon')} OR {_about(T.LOST)})"
_INTEREST_SQL = {"ads": _in("advertisement", "coupon"), "people": "people > 0", "week": f"{_in('article')} OR events > 0", "money": _PRICE, "strange": _ODD}
_CARD_SQL = {
    "ads-best": _in("advertisement"), "ads-trick": "is_advertorial", "ads-numbers": _in("advertisement", "article"), "ads-shops": f"{_in('advertisement', 'article')} AND orgs > 0", "people-surnames": "people > 0",
    "people-milestones": _about(T.MILESTONE), "people-busy": "people >= 2", "people-orgs": "orgs > 0", "week-news": _in("article"), "week-calendar": "events > 0",
    "week-civic": f"{_has('Local Government & Civic')} OR {_about(T.CIVIC)}", "week-sports": _has("Sports & Recreation"), "week-front": f"page = 1 AND {_in('article')}", "money-dollar": _PRICE,
    "money-show": f"{_about(T.SHOWS)} AND ({_PRICE} OR events > 0)", "money-realestate": f"{_has('Real Estate & Building')} OR {_about(T.PROPERTY)}", "strange-lost": f"{_about(T.LOST)} OR {_in('classified_section')}",
    "strange-fineprint": _in("legal_notice"), "strange-oddest": _ODD, "strange-now": "true", "kids-then": f"{_about(T.KIDS)} OR {_has('Schools & Education')}", "best-sentence": _in("article"), "unchanged": "true", "faith": _has("Churches & Religion"),
}
_F = f"""o AS ({OBJECTS_SQL}), ot AS ({OBJECT_TOPICS_SQL}), t AS ({TOPICS_SQL}), e AS ({OBJECT_ENTITIES_SQL}), v AS ({OBJECT_EVENTS_SQL}),
  tn AS (SELECT object_id, list(DISTINCT name) AS topics FROM ot JOIN t USING (topic_id) GROUP BY 1),
  en AS (SELECT object_id, count(*) FILTER (WHERE entity_type = 'person') AS people, count(*) FILTER (WHERE entity_type = 'organization') AS orgs FROM e GROUP BY 1),
  vn AS (SELECT source_object_id, count(*) AS events, bool_or(price_text IS NOT NULL) AS event_price FROM v GROUP BY 1),
  f AS (SELECT o.id, issue_id, object_class, is_advertorial, text, o.id % 8 AS page, coalesce(topics, []) AS topics, coalesce(people, 0) AS people, coalesce(orgs, 0) AS orgs, coalesce(events, 0) AS events, coalesce(event_price, false) AS event_price
    FROM o LEFT JOIN tn ON tn.object_id = o.id LEFT JOIN en ON en.object_id = o.id LEFT JOIN vn ON vn.source_object_id = o.id WHERE is_published)"""
_rows = lambda preds: " UNION ALL ".join(f"SELECT issue_id, id, '{n}' AS card FROM f WHERE {p}" for n, p in preds.items())
_META = ", ".join(f"('{n}', {list(c[0]) if c[0] else '[]::VARCHAR[]'}, {not c[1] or 'curious' in c[1]}, {int('curious' in c[1])}, {int(c[2])}, {c[3]})" for n, c in CARDS.items())
_DEAL = f"""WITH {_F}, m AS ({_rows(_CARD_SQL)}), meta(card, serves, ok, for_role, odd, least) AS (VALUES {_META}),
  g AS (SELECT issue_id, card, count(*) AS n, count(*) FILTER (WHERE id % 4 <> 0) AS fresh FROM m GROUP BY 1, 2),
  c AS (SELECT g.*, serves, for_role, odd FROM g JOIN meta USING (card) WHERE n >= least AND ok AND fresh > 0 AND card <> 'ads-best')"""
_DEALT = "SELECT issue_id, CAST(place AS INTEGER) AS place, card, fresh FROM (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY {0}) AS place FROM {1}) WHERE place <= 3"
_BEST = "row_number() OVER (PARTITION BY issue_id, list_contains(serves, '{0}') ORDER BY for_role DESC, fresh DESC, card) = 1 AND list_contains(serves, '{0}')"

ORACLE_SQL = {
    "interests": f"""WITH {_F}, m AS ({_rows(_INTEREST_SQL)}), g AS (SELECT issue_id, card AS interest, count(*) AS n FROM m GROUP BY 1, 2)
      SELECT * FROM g WHERE n >= CASE interest WHEN 'ads' THEN 3 WHEN 'people' THEN 5 WHEN 'week' THEN 3 ELSE 2 END""",
    "topic_interests": rf"""WITH {_F}, u AS (SELECT issue_id, id, unnest(topics) AS topic FROM f), g AS (SELECT issue_id, topic, count(DISTINCT id) AS n FROM u GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY n DESC, topic) AS place FROM g)
      SELECT issue_id, 'topic:' || regexp_replace(regexp_replace(replace(lower(topic), '&', 'and'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS interest, n FROM r WHERE place <= 2 AND n >= 4""",
    "card_material": f"""WITH {_F}, m AS ({_rows(_CARD_SQL)}), meta(card, serves, ok, for_role, odd, least) AS (VALUES {_META}), g AS (SELECT issue_id, card, count(*) AS n, min(id) AS first_id FROM m GROUP BY 1, 2)
      SELECT issue_id, card, n, first_id FROM g JOIN meta USING (card) WHERE n >= least""",
    "deal_r1": f"""{_DEAL}, b AS (SELECT *, {_BEST.format('money')} AS b0, {_BEST.format('ads')} AS b1, {_BEST.format('week')} AS b2 FROM c),
        w AS (SELECT *, CASE WHEN b0 THEN 0 WHEN b1 THEN 1 WHEN b2 THEN 2 WHEN list_has_any(serves, ['money', 'ads', 'week']) THEN 3 ELSE 4 END AS lead_by FROM b) """
    + _DEALT.format("lead_by, for_role DESC, fresh DESC, card", "w"),
    "deal_r3": f"{_DEAL} " + _DEALT.format("odd DESC, for_role DESC, fresh DESC, card", "c"),
    "deal_r4": f"{_DEAL} " + _DEALT.format("fresh DESC, card", "c"),
    "deep_topic": f"""WITH {_F}, u AS (SELECT issue_id, id, unnest(topics) AS topic FROM f WHERE id % 6 = 0), g AS (SELECT issue_id, topic, count(*) AS n, min(id) AS seen FROM u GROUP BY 1, 2)
      SELECT issue_id, topic, n FROM g QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY n DESC, seen, topic) = 1""",
}
