"""An edition dealt over four rounds: each round's cards taken and objects cited feed the next one.

A reader (role "curious"; interests money, ads, week) takes the first card of every deal; its section cites
the first eight objects of the card's material that no section cited before. Round one leads with
the reader's interests, round two goes deeper into what the last section cited, then to a topic not
covered yet and an interest not served yet, round three has the odd cards first, round four what has most
material left. Every round is topped up to three cards by rank. All issues are dealt for at once.

The material (issue, card, object) is written once, and so are the rounds' results, so that a round reads
them instead of repeating all earlier ones. Edge cases: an issue without candidates left gets no
rows for that round and its history stays; ties go to the smaller card name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.plans.details import _SLUG
from vellum.plans.edition import _CARD_SQL, _F, CARDS, _features, _rows
from vellum.sources.folders import staged

ROLE, WANTED = "curious", ("money", "ads", "week")
#: Rounds of an edition, cards of a deal, references of a section. Fixed values.
ROUNDS, DEAL, REFS = 4, 3, 8


def _of_card(value, kind: str, default: Column) -> Column:
    """A property of a library card; topic cards have the default."""
    known = F.create_map(*[x for n, c in CARDS.items() for x in (F.lit(n), F.lit(value(c)).cast(kind) if not isinstance(value(c), tuple) else F.array(*[F.lit(s) for s in value(c)]).cast(kind))])
    return F.coalesce(F.try_element_at(known, F.col("card")), default)


def _material(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(issue_id, card, id) of library and topic cards, and (issue_id, id, topic) with topics as slugs."""
    f = staged(_features(spark, sf_dir).select("issue_id", "id", "topics", F.filter(F.array(*[F.when(c[4](), F.lit(n)) for n, c in CARDS.items()]), lambda c: c.isNotNull()).alias("cards")), "features")
    about = f.select("issue_id", "id", F.explode("topics").alias("t")).select("issue_id", "id", T.slug(F.col("t"), spaced_and=False).alias("topic")).distinct()
    cards = f.select("issue_id", F.explode("cards").alias("card"), "id")
    named = [about.select("issue_id", F.concat(F.lit(kind), "topic").alias("card"), "id") for kind in ("topic:", "more:")]
    return staged(reduce(DataFrame.unionByName, named, cards), "material"), staged(about, "about")


def _candidates(material: DataFrame, cited: DataFrame | None, taken: DataFrame | None) -> DataFrame:
    """Cards that an issue may be dealt: enough material, some not cited, not taken, for this role."""
    rows = material.withColumn("old", F.lit(None).cast("int")) if cited is None else material.join(cited.select("issue_id", "id", F.lit(1).alias("old")), ["issue_id", "id"], "left")
    g = rows.groupBy("issue_id", "card").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("old").isNull()).alias("fresh"))
    topic = F.startswith("card", F.lit("topic:"))
    least = _of_card(lambda c: c[3], "int", F.when(topic, 3).otherwise(1))
    role = lambda c: ROLE in c[1]
    c = g.where((F.col("n") >= least) & (F.col("fresh") > 0) & _of_card(lambda c: not c[1] or role(c), "boolean", F.lit(True)))
    c = c.withColumns(
        {
            "for_role": _of_card(lambda c: int(role(c)), "int", F.lit(0)),
            "odd": _of_card(lambda c: int(c[2]), "int", F.lit(0)),
            "serves": _of_card(lambda c: c[0], "array<string>", F.array("card")),
        }
    )
    return c if taken is None else c.join(taken, ["issue_id", "card"], "left_anti")


def _rank(*first: Column) -> list[Column]:
    return [*first, F.desc("for_role"), F.desc("fresh"), F.asc("card")]


def _best_of_interests(c: DataFrame, skip: Column | None = None) -> Column:
    """The place among the reader's interests of the first one that a card is best for; else null."""
    best = []
    for n, i in enumerate(WANTED):
        serves = F.array_contains("serves", i)
        place = F.row_number().over(Window.partitionBy("issue_id", serves).orderBy(*_rank()))
        free = F.lit(True) if skip is None else ~F.array_contains(skip, i)
        best.append(F.when(serves & (place == 1) & free, n))
    return F.coalesce(*best)


def _lead(n: int, c: DataFrame, about: DataFrame, sections: list[DataFrame]) -> DataFrame:
    """Candidates with `lead`: what is dealt first in round n."""
    library = c.where(~F.startswith("card", F.lit("more:")))
    if n == 1:
        serving = F.coalesce(*[F.when(F.array_contains("serves", i), len(WANTED) + k) for k, i in enumerate(WANTED)])
        return library.withColumn("lead", F.coalesce(_best_of_interests(library), serving, F.lit(9)))
    if n == 3:
        return library.withColumn("lead", 1 - F.col("odd"))
    if n == 4:
        return library.withColumns({"lead": F.lit(0), "for_role": F.lit(0)})
    last = sections[-1]
    told = last.join(about, ["issue_id", "id"]).groupBy("issue_id", "topic").agg(F.count(F.lit(1)).alias("times"), F.min("id").alias("seen"))
    deep = told.groupBy("issue_id").agg(F.min_by("topic", F.struct(-F.col("times"), "seen", "topic")).alias("deep"))
    covered = reduce(DataFrame.unionByName, sections).join(about, ["issue_id", "id"]).select("issue_id", F.concat(F.lit("topic:"), "topic").alias("card")).distinct().withColumn("covered", F.lit(True))
    of_card = F.create_map(*[x for name, card in CARDS.items() for x in (F.lit(name), F.array(*[F.lit(s) for s in card[0]]).cast("array<string>"))])
    served = reduce(DataFrame.unionByName, [s.select("issue_id", "chosen").distinct() for s in sections])
    served = served.groupBy("issue_id").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.try_element_at(of_card, F.col("chosen")), F.array().cast("array<string>"))))).alias("served"))  # a card a round
    own = c.join(deep, "issue_id", "left").join(served, "issue_id", "left").withColumn("served", F.coalesce("served", F.array().cast("array<string>")))
    own = own.join(covered, ["issue_id", "card"], "left")
    more = F.startswith("card", F.lit("more:"))
    own = own.where(~more | (F.col("card") == F.concat(F.lit("more:"), "deep")))
    side = F.startswith("card", F.lit("topic:")) & F.col("covered").isNull()
    sideways = side & (F.row_number().over(Window.partitionBy("issue_id", side).orderBy(*_rank())) == 1)
    unserved = _best_of_interests(own, F.col("served"))
    return own.withColumn("lead", F.when(more, 0).when(sideways, 1).otherwise(F.coalesce(unserved + 2, F.lit(9)))).drop("deep", "served", "covered")


def edition_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards of every round of every issue: place, fresh material, and what the section of the card taken cites."""
    material, about = _material(spark, sf_dir)
    deals: list[DataFrame] = []
    sections: list[DataFrame] = []
    for n in range(1, ROUNDS + 1):
        union = (lambda dfs, *cols: reduce(DataFrame.unionByName, [d.select(*cols) for d in dfs])) if sections else (lambda dfs, *cols: None)
        cited, taken = union(sections, "issue_id", "id"), union(deals, "issue_id", "card", "place")
        c = _candidates(material, cited, None if taken is None else taken.where("place = 1").select("issue_id", "card"))
        place = F.row_number().over(Window.partitionBy("issue_id").orderBy(*_rank(F.asc("lead"))))
        dealt = _lead(n, c, about, sections).withColumn("place", place).where(F.col("place") <= DEAL).select("issue_id", F.lit(n).alias("round"), "place", "card", "fresh")
        deals.append(staged(dealt, f"deal_{n}"))
        first = deals[-1].where("place = 1").select("issue_id", "card")
        fresh = material.join(first, ["issue_id", "card"], "left_semi")
        fresh = fresh if cited is None else fresh.join(cited, ["issue_id", "id"], "left_anti")
        told = fresh.withColumn("k", F.row_number().over(Window.partitionBy("issue_id").orderBy("id"))).where(F.col("k") <= REFS)
        sections.append(staged(told.select("issue_id", "id", F.col("card").alias("chosen")), f"section_{n}"))
    refs = reduce(DataFrame.unionByName, sections).groupBy("issue_id", F.col("chosen").alias("card")).agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("refs"))  # eight a section
    dealt = reduce(DataFrame.unionByName, deals)
    return dealt.join(refs.withColumn("place", F.lit(1)), ["issue_id", "card", "place"], "left").select("issue_id", "round", "place", "card", "fresh", F.coalesce("refs", F.lit("")).alias("refs"))


QUERIES = {"edition_rounds": edition_rounds}


def _sql() -> str:
    """Round by round, as chained tables."""
    meta = ", ".join(f"('{n}', {list(c[0]) if c[0] else '[]::VARCHAR[]'}, {not c[1] or ROLE in c[1]}, {int(ROLE in c[1])}, {int(c[2])}, {c[3]})" for n, c in CARDS.items())
    out = f"""WITH {_F}, meta(card, serves, ok, for_role, odd, least) AS (VALUES {meta}),
      ab AS MATERIALIZED (SELECT DISTINCT issue_id, id, {_SLUG} AS topic FROM (SELECT issue_id, id, unnest(topics) AS topic FROM f)),
      m AS MATERIALIZED ({_rows(_CARD_SQL)} UNION ALL SELECT issue_id, id, 'topic:' || topic FROM ab UNION ALL SELECT issue_id, id, 'more:' || topic FROM ab)"""
    best = lambda t, i: f"(list_contains(serves, '{i}') AND row_number() OVER (PARTITION BY issue_id, list_contains(serves, '{i}') ORDER BY for_role DESC, fresh DESC, card) = 1{t})"
    a, b, w = WANTED
    for n in range(1, ROUNDS + 1):
        earlier = range(1, n)
        cited = " UNION ALL ".join(f"SELECT issue_id, id FROM s{k}" for k in earlier) or "SELECT issue_id, id FROM f WHERE false"
        taken = " UNION ALL ".join(f"SELECT issue_id, card FROM d{k} WHERE place = 1" for k in earlier) or "SELECT issue_id, card FROM m WHERE false"
        out += f""", cited{n} AS MATERIALIZED ({cited}), taken{n} AS MATERIALIZED ({taken}),
      g{n} AS (SELECT m.issue_id, m.card, count(*) AS n, count(*) FILTER (WHERE ci.id IS NULL) AS fresh FROM m LEFT JOIN cited{n} ci ON ci.issue_id = m.issue_id AND ci.id = m.id GROUP BY 1, 2),
      c{n} AS MATERIALIZED (SELECT g.issue_id, g.card, fresh, coalesce(for_role, 0) AS for_role, coalesce(odd, 0) AS odd, coalesce(serves, [g.card]) AS serves FROM g{n} g LEFT JOIN meta ON meta.card = g.card
        WHERE n >= coalesce(least, CASE WHEN starts_with(g.card, 'topic:') THEN 3 ELSE 1 END) AND coalesce(ok, true) AND fresh > 0
          AND NOT EXISTS (SELECT 1 FROM taken{n} t WHERE t.issue_id = g.issue_id AND t.card = g.card))"""
        if n == 2:
            out += f""", deep AS (SELECT issue_id, topic FROM s1 JOIN ab USING (issue_id, id) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY count(*) DESC, min(id), topic) = 1),
      cov AS (SELECT DISTINCT issue_id, topic FROM s1 JOIN ab USING (issue_id, id)), sv AS (SELECT t.issue_id, coalesce(meta.serves, []) AS served FROM taken2 t LEFT JOIN meta USING (card)),
      x2 AS (SELECT c.*, coalesce(served, []) AS served, starts_with(c.card, 'more:') AS more, starts_with(c.card, 'topic:') AND cov.topic IS NULL AS side FROM c2 c LEFT JOIN deep ON deep.issue_id = c.issue_id LEFT JOIN sv ON sv.issue_id = c.issue_id
        LEFT JOIN cov ON cov.issue_id = c.issue_id AND 'topic:' || cov.topic = c.card WHERE NOT starts_with(c.card, 'more:') OR c.card = 'more:' || deep.topic),
      l2 AS (SELECT *, CASE WHEN more THEN 0 WHEN side AND row_number() OVER (PARTITION BY issue_id, side ORDER BY for_role DESC, fresh DESC, card) = 1 THEN 1
        {" ".join(f"WHEN {best(f" AND NOT list_contains(served, '{i}')", i)} THEN {k}" for k, i in enumerate(WANTED, 2))} ELSE 9 END AS lead_by FROM x2)"""
        else:
            by = {
                1: f"CASE {' '.join(f'WHEN {best("", i)} THEN {k}' for k, i in enumerate(WANTED))} WHEN list_contains(serves, '{a}') THEN 3 WHEN list_contains(serves, '{b}') THEN 4 WHEN list_contains(serves, '{w}') THEN 5 ELSE 9 END",
                3: "1 - odd",
                4: "0",
            }[n]
            role = "0 AS for_role" if n == 4 else "for_role"
            out += f", l{n} AS (SELECT issue_id, card, fresh, {role}, {by} AS lead_by FROM c{n} WHERE NOT starts_with(card, 'more:'))"
        out += f""", d{n} AS MATERIALIZED (SELECT issue_id, {n} AS round, card, fresh, row_number() OVER (PARTITION BY issue_id ORDER BY lead_by, for_role DESC, fresh DESC, card) AS place FROM l{n} QUALIFY place <= {DEAL}),
      s{n} AS MATERIALIZED (SELECT m.issue_id, m.card, m.id FROM m JOIN d{n} d ON d.issue_id = m.issue_id AND d.card = m.card AND place = 1
        WHERE NOT EXISTS (SELECT 1 FROM cited{n} ci WHERE ci.issue_id = m.issue_id AND ci.id = m.id) QUALIFY row_number() OVER (PARTITION BY m.issue_id ORDER BY m.id) <= {REFS})"""
    every = " UNION ALL ".join(f"SELECT d.*, CASE WHEN place = 1 THEN (SELECT string_agg(s.id, ',' ORDER BY s.id) FROM s{n} s WHERE s.issue_id = d.issue_id) END AS refs FROM d{n} d" for n in range(1, ROUNDS + 1))
    return out + f" SELECT issue_id, CAST(round AS INTEGER) AS round, CAST(place AS INTEGER) AS place, card, fresh, coalesce(refs, '') AS refs FROM ({every})"


ORACLE_SQL = {"edition_rounds": _sql()}
